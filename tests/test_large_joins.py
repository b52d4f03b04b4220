"""Joins whose work must not be a product of their inputs, and what they find."""

import random
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from docloom.functions import md5 as M
from docloom.operators import dedup as D
from docloom.operators import fewshot as X2
from docloom.operators import inference as I
from docloom.operators import records as R
from docloom.operators import tables as X
from docloom.operators import vector_index as V
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cheapest(spark):
    instances = spark.createDataFrame([("a", 2, 4, 1.0), ("b", 2, 4, 1.0), ("c", 4, 8, 3.0), ("d", 4, 8, 2.5), ("e", 1, 1, 9.0), ("f", None, 8, 0.1)], "instance string, cores int, memory int, price double")
    wants = spark.createDataFrame([(1, 2, 3), (2, 2, 3), (3, 3, 3), (4, 9, 9), (5, None, 1), (6, 1, 1)], "k int, want_cores int, want_memory int")
    df = X.cheapest(instances, wants, "k")
    assert dict(df.collect()) == {1: "a", 2: "a", 3: "d", 4: "e", 5: "e", 6: "a"}
    # equal needs are one before they meet the instances
    text = plan(df)
    assert text.index("want_cores") >= 0 and text.count("Aggregate [_c") >= 2


def test_minhash_pairs_carry_no_signatures(spark):
    rng = random.Random(3)
    sets = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(12)]
    sets += [s[: 60 - i % 6] for i, s in enumerate(sets)] + [sets[0], [], []]
    signed = D.minhash(spark.createDataFrame(list(enumerate(sets)), "k long, words array<string>"), "k", "words")
    brute = {r.k: r.signature for r in signed.collect()}
    share = lambda a, b: sum(x == y for x, y in zip(brute[a], brute[b], strict=True)) / 128
    some = [k for k, s in brute.items() if s]
    first = {k: min(o for o in some if brute[o] == brute[k]) for k in some}
    reps = [k for k in some if first[k] == k]
    want = {(a, b, share(a, b)) for a in reps for b in reps if a < b and share(a, b) >= 0.85} | {(first[k], k, 1.0) for k in some if first[k] != k}
    assert len(want) > 5 and {tuple(r) for r in D.minhash_pairs(signed, "k").collect()} == want
    packed = D.packed(signed, "k")
    index = D.banded(packed, "k")
    assert index.columns == ["k", "t", "band"]  # what is shuffled for each band
    asked = {tuple(r) for r in D.minhash_query(index, packed.filter("k % 2 = 0"), packed, "k").collect()}
    assert asked == {(a, b, share(a, b)) for a in some for b in some if a != b and a % 2 == 0 and share(a, b) >= 0.85}


def test_crowded_fingerprints_meet_in_a_grid(spark):
    """Where many share blocks, no pair is lost or doubled, and first-seen order writes no pairs."""
    rng = random.Random(5)
    fps = {}
    for k in range(300):
        fps[k * 3] = rng.getrandbits(14) | (rng.getrandbits(1) << 63)
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in fps.items()] + [(901, None)], "k long, fp long")
    least = {x: min(k for k, y in fps.items() if y == x) for x in fps.values()}
    fps = {k: x for k, x in fps.items() if least[x] == k}
    for threshold, radius in ((0.95, 3), (0.85, 9)):
        reps = df.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("k").alias("k"))
        assert D.grid_is_less(reps, radius)
        want = {(a, b, (fps[a] ^ fps[b]).bit_count()) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius}
        got = [tuple(r) for r in D.near_pairs(df, "k", threshold).collect()]
        assert len(got) == len(want) and set(got) == want
        kept, duplicate = [], {}
        for k in sorted(fps):
            duplicate[k] = next((o for o in kept if (fps[o] ^ fps[k]).bit_count() <= radius), None)
            kept += [k] if duplicate[k] is None else []
        assert {r.k: r.duplicate_of for r in D.first_seen_near(df, "k", threshold).collect()} == duplicate
    sparse = spark.createDataFrame([(k, rng.getrandbits(62)) for k in range(300)], "k long, fp long")
    assert not D.grid_is_less(sparse, 9) and D.first_seen_near(sparse, "k").filter("duplicate_of IS NOT NULL").count() == 0


def test_matches_are_not_added_up(spark):
    rng = random.Random(9)
    row = lambda i: (i, rng.choice(["p", "q", None]), rng.choice(["h", "g", "f", None]))
    for ids in (range(60), [i // 2 for i in range(60)]):
        w, e = [row(i) for i in ids], [row(i) for i in ids]
        want = {}
        for a in w:
            for b in e:
                s = 0.5 * (a[1] is not None and a[1] == b[1]) + 0.5 * (a[2] is not None and a[2] == b[2])
                if s:
                    want[a[0], b[0]] = want.get((a[0], b[0]), 0) + s
        wanted = spark.createDataFrame(w, "wanted_id int, pattern string, dom_hash string")
        df = I.match_examples(wanted, spark.createDataFrame(e, "example_id int, example_pattern string, example_hash string"))
        got = df.collect()
        assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)
        assert ("Aggregate" in plan(df)) == (len(set(ids)) < len(ids))


def test_nearest_vectors(spark):
    """As many as asked for, however far, and not those beyond a high likeness alone."""
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    rows += [(k + 200, v) for k, v in rows[:20]]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = {}
    for k, q in rows[::50]:
        near = sorted((-round(cosine(q, v), 12), o) for o, v in rows if o != k and cosine(q, v) >= 0.1)[:5]
        want |= {(k, i): o for i, (_, o) in enumerate(near, 1)}
    got = {(r.query, r["rank"]): r.key for r in V.nearest(V.indexed(df, "k", "v"), df.filter("k % 50 = 0"), "k", "v", 0.1, 5).collect()}
    assert got == want


def test_rows_are_not_sorted_for_a_vote(spark):
    rows = spark.createDataFrame([(1, "a", None, "null"), (2, "a", "12", "string"), (3, "a", "http://x", "string"), (4, "b", "7", "integer"), (4, "a1", "x", "string"), (5, "c", None, "null")], "id long, field string, value string, kind string")
    types = I.first_types(rows, "id")
    assert dict(types.collect()) == {"a": "number", "b": "number", "a1": "text"}
    schema = I.json_schema(rows, "id")
    assert {r.field: (r.type, r.nullable, r.example) for r in schema.collect()} == {"a": ("string", True, "12"), "b": ("integer", False, "7"), "a1": ("string", False, "x"), "c": ("null", True, None)}
    groups = R.name_groups(rows)
    assert [tuple(r) for r in groups.collect()] == [("a", 2, True)]
    for df in (types, schema, groups):
        # an aggregate that sorts reads what one in a hash table left
        steps = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Aggregate" in x]
        for i, step in enumerate(steps):
            assert "SortAggregate" not in step or ("min(value" not in step and any("HashAggregate" in x for x in steps[i:])), steps


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Copies in several blocks are equally near, in the order of their keys; pairs are no rows of a join."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "QUERIES", 3)
    rng = random.Random(5)
    kinds = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(6)]
    rows = [(k, kinds[rng.randrange(6)] if k % 3 else [rng.gauss(0, 1) for _ in range(7)]) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    queries = df.filter("k % 10 = 0")
    index = V.indexed(df, "k", "v")
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want, wide = {}, set()
    for k, q in rows[::10]:
        near = sorted((-round(cosine(q, v), 12), o) for o, v in rows if o != k and cosine(q, v) >= 0.1)
        wide |= {(k, o) for _, o in near}
        want |= {(k, i): o for i, (_, o) in enumerate(near[:5], 1)}
    found = V.search(index, queries, "k", "v", 0.1)
    got = [(r.query, r.key) for r in found.collect()]
    assert len(got) == len(wide) and set(got) == wide
    assert {(r.query, r["rank"]): r.key for r in V.nearest(index, queries, "k", "v", 0.1, 5).collect()} == want
    assert "zip_with" not in plan(found)


def test_fingerprints_shuffle_no_words(spark):
    """A row for each key is shuffled, not one for each word of it; equal words weigh as their count."""
    df = spark.createDataFrame([(1, "one one one two three, four"), (2, "two two of one"), (2, "again one"), (3, "a"), (4, None)], "k long, text string")
    fps = D.simhash(D.weighty_tokens(df, "k", "text"), "k", "token")
    counted = D.simhash(D.weighted_tokens(df, "k", "text"), "k", "token", F.col("w"))
    assert Counter(tuple(r) for r in fps.collect()) == Counter(tuple(r) for r in counted.collect()) and fps.count() == 2
    assert plan(fps).count("Aggregate") == 1
    members = D.membership(fps, "k")
    assert {(r.k, r.representative) for r in members.collect()} == {(1, 1), (2, 2)} and "Generate" not in plan(members)


def test_nearest_examples_meet_in_a_grid(spark, monkeypatch):
    """The nearest example by brute force, ties included, and no pair is written out with its vectors."""
    rng = random.Random(11)
    hosts, notes = [f"www.h{i}ab.example.com" for i in range(9)], ["all rights reserved", "terms and privacy", "read more about us"]
    say = lambda place: f"tag:footer text:{rng.choice(hosts)} {rng.choice(notes)} parent:body position:{place}/5"
    examples = [(say(3), i, f"s{i}") for i in range(60)] + [("tag:li text:one parent:ul", 60, "li"), ("parent:ul text:one tag:li", 61, "later")]
    targets = sorted({say(4) for _ in range(40)} | {"tag:li text:one parent:ul", "nothing like it", "", examples[5][0]})
    e = spark.createDataFrame(examples, "line string, order long, selector string")
    vocabulary = {r.gram: r.idf for r in X2.fit(e).collect()}

    def vector(line):
        made = Counter(g for w in line.lower().split() for n in (2, 3, 4) for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)))
        v = {g: n * vocabulary[g] for g, n in made.items() if g in vocabulary}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {g: x / norm for g, x in v.items()}

    want = {}
    for t in targets:
        q = vector(t)
        s = [(-round(sum(x * v.get(g, 0.0) for g, x in q.items()), 12), order, selector) for line, order, selector in examples for v in [vector(line)]]
        if -min(s)[0] >= 0.75:
            want[t] = (min(s)[2], round(-min(s)[0], 9))
    assert want["tag:li text:one parent:ul"][0] == "li" and 10 < len(want) < len(targets)
    monkeypatch.setattr(X2, "SIDE", 16)  # several cells on both sides
    df = X2.nearest(spark.createDataFrame([(t,) for t in targets], "line string"), e)
    assert "FlatMapCoGroupsInArrow" in plan(df) and "map_from_entries" not in plan(df)
    assert {r.line: (r.selector, round(r.similarity, 9)) for r in df.collect()} == want


def test_a_token_of_many_rows_is_hashed_once(spark, monkeypatch):
    """Minima by hashlib, of words and of shingles, salts before and after, of rows that are cut and of long words; rows share their tokens."""
    rng = random.Random(17)
    rows = [[rng.choice(["a", "é", "w" * rng.randrange(1, 80), f"t{rng.randrange(30)}"]) for _ in range(n)] for n in (0, 1, 2, 3, 40, 5, 1, 90, 0, 7)] + [None]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, words array<string>").coalesce(1)
    hashed = []
    monkeypatch.setattr(D, "TOGETHER", 16)
    for k, form, salt in ((1, "suffix", "{t}_{i}"), (3, "prefix", "{i}:{t}")):
        want = {}
        for at, row in enumerate(rows):
            tokens = {" ".join(row[i : i + k]) for i in range(len(row) - k + 1)} if row else ()
            want[at] = [min(md5(salt.format(t=t, i=i).encode()).hexdigest() for t in tokens) for i in range(12)] if tokens else None
        assert {r.k: r.signature for r in D.minhash(df, "k", "words", 12, form, k).collect()} == want
    words = pa.array(["x", "y", "z"] * 500)
    begin = np.arange(0, 1500, 3)
    texts, text, ends = M.shingled(words, begin, begin + 3, 1)
    monkeypatch.setattr(M, "digests", lambda words, run=M.digests: hashed.append(len(words[14])) or run(words))
    high, _ = M.minima(texts, text, ends, [b"_0", b"_1"], before=False)
    assert high.shape == (500, 2) and sum(hashed) == 2 * 3  # not 2 * 1500


def test_shingles_are_hashed_where_they_are(spark, monkeypatch):
    """The fingerprints of ``simhash`` over rows of shingles, without such rows: no text is shuffled."""
    rng = random.Random(19)
    texts = [" ".join(rng.choice(["A", "é", "b" * rng.randrange(1, 70), f"t{rng.randrange(9)}"]) for _ in range(n)) for n in (0, 1, 2, 3, 60, 4, 90, 12)] + [None, "one two three " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    monkeypatch.setattr(D, "TOGETHER", 32)
    got = D.shingle_simhash(df, "k", "text")
    want = D.simhash(D.shingle_tokens(df.filter("text IS NOT NULL"), "k", "text"), "k", "token")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 6
    # fingerprints are worked out once, however often near ones are looked for
    runs = spark.sparkContext.accumulator(0)
    counted = got.mapInArrow(lambda batches: (runs.add(b.num_rows) or b for b in batches), got.schema)
    D.nearest_before(counted, "k").collect()
    assert runs.value == 6
