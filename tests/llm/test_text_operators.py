"""Operators on texts against the libraries, brute force and edge rows."""

import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import pytest
import xxhash
from docloom.llm import bpe, decontamination, fingerprints, language_id, line_dedup, simhash, token_counts, toxicity

from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_tokens string, fp string, k1 string, row string"
LONG = "the quick brown fox jumps over the lazy dog near the old stone bridge " * 3000
EDGES = [None, "", " \n\t ", "word", "Word", "don't I'LL <|endoftext|>  x", "İstanbul ΣΑΣ éa 日本語", "a\x1cb\x85c ​d", LONG, "same text here", "same text here"]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows.append((None, "no id", None, None, None, None))
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(3)
    kinds = ((32, 127), (160, 0x500), (0x900, 0x3000), (0x1F300, 0x1FAFF))
    return EDGES + ["".join(chr(rnd.choice([rnd.randrange(*rnd.choice(kinds)), 9, 10, 32, 39, 0x301])) for _ in range(50)) for _ in range(150)]


@pytest.mark.parametrize("bound", [10**6, 30])
def test_token_counts_are_the_librarys(spark, odd_texts, bound):
    t = library("byte_bpe_50k.json")
    df = frame(spark, odd_texts)
    got = token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), bound=bound).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bound", [10**6, 30])
def test_bpe_round_trip(spark, odd_texts, bound):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = library("word_bpe_49k.json")
    df = frame(spark, odd_texts)
    got = bpe.decode(bpe.encode(df, path, bound=bound), path).collect()
    want = []
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, t.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    at_once = bpe.encode(df, path, bound=bound, decoded=True).collect()
    assert sorted(map(str, map(tuple, at_once))) == sorted(map(str, want))


def test_fingerprints(spark):
    texts = ["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "x y z " * 40, *EDGES, "last one of all"]
    df = frame(spark, texts)
    rows = fingerprints.fingerprints(df).collect()
    assert len(rows) == len(texts) + 2
    order = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    by_id = {r.doc_id: r for r in rows}
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        if a.doc_id == 3:  # repeated
            continue
        t, u = a.text or "", b.text or ""
        k = len(t) // 4
        r = by_id[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - k] + u[:k]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[0].fingerprint == by_id[1].fingerprint and by_id[0].near_next == 1.0
    assert by_id[1].near_next < 0.2
    assert by_id[3].near_next == 1.0  # null and empty


def brute_signature(text):
    """Consistent weighted sampling in plain Python, without skipping words out of reach."""
    ws = Counter(w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", text) if w)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    unit = lambda bits, width: ((bits & (1 << width) - 1) + 1) / (1 << width)
    out = []
    for i in range(fingerprints.SAMPLES):
        least = None
        for w, n in ws.items():
            h = struct.pack("<q", signed(xxhash.xxh64_intdigest(w.encode(), 42)))
            x, y = (xxhash.xxh64_intdigest(struct.pack("<i", 2 * i + k), xxhash.xxh64_intdigest(h, 42)) for k in (0, 1))
            r = -math.log(unit(x, 32) * unit(x >> 32, 32))
            c = -math.log(unit(y, 20) * unit(y >> 20, 20))
            t = math.floor(math.log(n) / r + unit(y >> 40, 24))
            a = math.log(c) - r * (t - unit(y >> 40, 24) + 1)
            least = a if least is None else min(least, a)
        # the last bits of a logarithm may differ
        near = [struct.pack("<d", least + k * math.ulp(least)) for k in range(-8, 9)] if ws else []
        out.append({"%04x" % (xxhash.xxh64_intdigest(x, 42) & 0xFFFF) for x in near} or {"...."})
    return out


def test_fingerprints_against_plain_python(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["one", "two", "É", "x1", "long-word", "Z"]) + rnd.choice(["", "s"]) for _ in range(n)) for n in (1, 2, 5, 40, 200) for _ in range(4)]
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate([*texts, ""])), "doc_id long, text string")).collect()
    same = total = 0
    cut = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
    own = {r.doc_id: cut(r.fingerprint) for r in rows}
    for r in rows:
        text = [*texts, ""][r.doc_id]
        following = [*texts, ""][(r.doc_id + 1) % len(rows)]
        k = len(text) // 4
        for got, of in ((own[r.doc_id], text), (cut(r.edited_fingerprint), text[: len(text) - k] + following[:k])):
            want = brute_signature(of)
            same += sum(a in b for a, b in zip(got, want, strict=True))
            total += len(want)
        like = lambda a, b: sum(x == y != "...." for x, y in zip(a, b, strict=True)) / fingerprints.SAMPLES if a[0] != "...." or b[0] != "...." else 1.0
        assert r.near_edited == like(own[r.doc_id], cut(r.edited_fingerprint))
        assert r.near_next == like(own[r.doc_id], own[(r.doc_id + 1) % len(rows)])
    assert same >= 0.99 * total  # a difference of logarithms near 0 may be further off


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_every_fingerprint_meets_the_next_document(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ids = random.Random(parts).sample(range(-500, 5000), 300)
        rows = fingerprints.with_next(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")).filter("NOT guard").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(ids)
    assert {r.doc_id: r.next for r in rows} == {a: f"text {b}" for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert len(rows) == len(ids)


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    a = " ".join(f"w{i}" for i in range(100) for _ in range(1 + i % 5))
    b = " ".join(f"w{i}" for i in range(30, 130) for _ in range(1 + i % 3))
    rows = spark.createDataFrame([(2 * i + j, f"{t} z{i}") for i in range(40) for j, t in enumerate((a, b))], "doc_id long, text string")
    got = [r.near_next for r in fingerprints.fingerprints(rows).collect() if r.doc_id % 2 == 0]
    x, y = Counter(a.split()), Counter(b.split())
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs(sum(got) / len(got) - want) < 0.1


def brute_components(fps, radius):
    ids = list(fps)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_simhash_components(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(8)]
    near = [t + " tail" for t in texts] + [t + " tail end" for t in texts[:4]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, *near, None, "", "A b", "a B"])], "doc_id long, text string, fp int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: r.fp & (1 << 64) - 1 for i, r in got.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 2)
    assert got[20].fp == got[21].fp == 0 and got[22].fp == got[23].fp


def test_simhash_fingerprint_bit_by_bit():
    ws = simhash.words("One two THREE four five four five four five six")
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(simhash.shingle_hashes(ws, 3)) == want


def test_keep_one_near_copy(spark):
    rnd = random.Random(2)
    base = [[f"v{rnd.randrange(400)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for i, ws in enumerate(base):
        rows.append((i, " ".join(ws), "a"))
        copy = list(ws)
        copy[150] = "changed"
        rows.append((100 + i, " ".join(copy), "b"))
        rows.append((200 + i, " ".join(ws), "c"))
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "d")], "doc_id long, text string, k1 string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def test_decontamination_is_exact(spark):
    rnd = random.Random(4)
    ws = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(ws) for _ in range(n))) for i, n in enumerate((25, 14, 10, 4, 1, 30, 30))] + [(None, "t1 t2"), (50, None), (51, "")]
    docs = [(i, " ".join(rnd.choice(ws[10:]) for _ in range(60))) for i in range(20)]
    docs += [(30 + i, "Xé " + t.upper() + ", tail") for i, (_, t) in enumerate(items) if t] + [(90, None), (91, ""), (None, items[0][1]), docs[0], (92, items[0][1][:-8])]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, n_words int, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontamination.brute_force(docs, items)))
    assert sorted(str(tuple(r)) for r in decontamination.digests(decontamination.find(df, bench)).collect()) == want
    assert sorted(str(tuple(r)) for r in decontamination.digests(decontamination.find(df, bench, block_windows=5)).collect()) == want
    clean = decontamination.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(x.endswith("False)") for x in want)
    assert decontamination.find(df, bench.limit(0)).filter("size(spans) > 0").count() == 0


def brute_lines(docs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    low = float("-inf")
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and d != max(held[key(x)], key=lambda i: low if i is None else i) for x in lines]
        out.append((d, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("hot_share", [1, line_dedup.HOT, 10**9], ids=["none hot", "as it is", "all hot"])
def test_line_dedup_is_exact(spark, hot_share):
    rnd = random.Random(5)
    common = ["A line that is long enough, number %d" % i for i in range(12)] + ["short", "", "É" * 20, "é" * 20, "  padded to twenty c  ", "padded to twenty c", "X" * 5000]
    docs = [(i, "\n".join(rnd.choice(common) + rnd.choice(["", " ", "\t", "\r"]) for _ in range(rnd.randrange(12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, common[0] + "\n" + common[1]), docs[0], docs[0]]
    df = spark.createDataFrame([(d, t, 0, "r") for d, t in docs], "doc_id long, text string, runs int, h1 string").repartition(4)
    want = sorted(map(str, brute_lines(docs)))
    assert sorted(str(tuple(r)) for r in line_dedup.digests(df, hot_share=hot_share).collect()) == want
    kept = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    assert kept.columns == [*df.columns, "_kept", "_dropped"]


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    """32,000 lines of which every other one is dropped; in quadratic time this takes about a minute."""
    repeated = "\n".join(f"own line {i} of this document" if i % 2 else f"line {i} that the documents share" for i in range(32_000))
    docs = [(d, repeated.replace("own line", f"own line {d} no")) for d in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    started = time.time()
    got = line_dedup.digests(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_lines(docs)))
    assert time.time() - started < 20


def test_toxicity_learns_and_scores(spark):
    rnd = random.Random(6)
    plain = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        ws = [rnd.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            ws[10] = ws[40] = rnd.choice(["dreadfulword", "vile", "nastyone"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (1000, ""), (1001, "vile")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels if (got[i] >= toxicity.REJECT) != bool(y)]
    assert len(wrong) <= 4
    assert got[None] == got[1000] < 0.3 <= got[1001]
    both = spark.createDataFrame([*labels, *((i, 1 - y) for i, y in labels if y)], "doc_id long, toxic int")  # toxic either way
    assert toxicity.fit(docs, both).__getstate__() == model.__getstate__() == toxicity.fit(docs.unionByName(docs), both).__getstate__()
    odd = docs.limit(3).unionByName(docs.limit(3)).withColumns({"_score": F.lit(1), "a b": F.lit(2)})
    assert toxicity.reject(odd, model).columns == odd.columns
    long = [("vile " + "plainaa " * 400_000,), ("plainaa " * 400_000 + "vile",)]
    assert len({r.score for r in toxicity.score(spark.createDataFrame(long, "text string"), model).collect()}) == 1
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language_id.fit(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, learned).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(found[i].lang_pred == truth[i] for i in truth) >= 0.97 * len(truth)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "\u00b2 \u00bd \u2167"), (None, "the and of"), (6, "the and of"), (6, "the and of")], "doc_id long, text string")
    got = language_id.identify(odd.withColumn("lang_pred", F.lit("x")), learned).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][1:5] == ["und"] * 4 and got[-1] == got[-2]
    assert got[0].lang_pred == got[-1].lang_pred
    assert language_id.fit(docs.limit(0)) == {}
    assert language_id.identify(odd.limit(0), learned).count() == 0


def test_language_reads_all_of_a_text():
    learned = language_id.dictionaries([("aa", b"orange lemon cherry apple " * 9), ("bb", b"hammer chisel anvil pliers " * 9)])
    coders = language_id.Coders(learned)
    assert coders.classify("orange " * 100 + "hammer chisel anvil pliers " * 4000)[0] == "bb"
    assert coders.classify("hammer " * 100 + "orange lemon cherry apple " * 4000)[0] == "aa"
    assert language_id.folded("\u0939\u093f\u0928\u094d\u0926\u0940, 2 x") == " \u0939\u093f\u0928\u094d\u0926\u0940 x "  # marks stay with their letters
    assert language_id.Coders({"b": learned["aa"], "a": learned["aa"]}).classify("lemon") == ("a", 0.0, True)  # a tie
    assert len(language_id.stretches("word " * 10_000, 240)) < 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(none, path).count() == 0
    assert bpe.digests(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert line_dedup.digests(none).count() == 0
    assert decontamination.find(none, items).count() == 0
    assert toxicity.score(none, toxicity.Model()).count() == 0
