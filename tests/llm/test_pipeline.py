"""The pipeline, stage by stage, against plain Python."""

import hashlib
import random

import corpus_pipeline
import pytest
from docloom.llm import decontamination, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "er", "ol", "im") for c in ("ta", "ro", "ne")]
    shared = "A long line that many of the documents repeat word for word"
    item = " ".join(rnd.choice(vocabulary) for _ in range(24))
    docs = []
    for i in range(240):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 60))) for _ in range(3)]
        if i % 6 == 0:
            lines[1] += " dreadful vileword"
        if i % 5 == 0:
            lines.insert(1, shared)
        if i % 40 == 7:
            lines.append(item)
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    docs += [(300 + i, docs[i][1], "en", "copy") for i in range(1, 30)]
    near = []
    for i in range(31, 60):
        ws = docs[i][1].split(" ")
        ws[len(ws) // 2] = "changed"
        near.append((400 + i, " ".join(ws), "en", "near"))
    docs += near + [(500, None, None, None), (501, "", "en", None), (None, "a text without an id", "en", None), docs[3]]
    rows = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def brute_near(docs):
    """Groups of (id, text) rows by plain comparison of all pairs that have a shingle in common; the least of each stays, rows that repeat once."""
    rows = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    hashes = [simhash.shingle_hashes(simhash.words(t), simhash.COPY_SHINGLE) for _, t in rows]
    fps = [simhash.fingerprint(h) for h in hashes]
    shingles = [set(h.tolist()) for h in hashes]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.COPY_RADIUS and (shingles[i] & shingles[j] or not shingles[i] | shingles[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage(spark, tables):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    start = pairs(docs)

    kept = stages["toxicity"](spark, docs, tables)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    after = pairs(kept)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(after, key=key) == sorted((r for r in start if model.score(r[1]) < toxicity.REJECT), key=key)
    assert not any(labels.get(d) for d, t in after if t and "dreadful" in t)

    lines = stages["line_dedup"](spark, kept, tables)
    assert lines.columns == docs.columns
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  ASCII here
    held = {}
    for d, t in after:
        for x in (t or "").split("\n"):
            held.setdefault(fold(x), set()).add(-1 if d is None else d)
    stays = lambda d, x: len(fold(x)) < 20 or len(held[fold(x)]) < 3 or (-1 if d is None else d) == max(held[fold(x)])
    want = [(d, None if t is None else "\n".join(x for x in t.split("\n") if stays(d, x))) for d, t in after]
    thinned = pairs(lines)
    assert sorted(thinned, key=key) == sorted(want, key=key) and thinned != after
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    once = stages["simhash_near_dedup"](spark, lines, tables)
    assert once.columns == docs.columns
    single = pairs(once)
    assert sorted(single, key=key) == brute_near(thinned) and len(single) < len(thinned) - 29

    clean = stages["decontamination"](spark, once, tables)
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    hit = {r[0] for r in decontamination.brute_force(single, items) if r[-1]}
    left = pairs(clean)
    assert hit and sorted(left, key=key) == sorted((r for r in single if r[0] not in hit), key=key)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = []
    for d, text in left:
        ids = t.encode(text or "", add_special_tokens=False).ids
        rows.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in stages["bpe"](spark, clean, tables).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, tables).collect()))) == sorted(map(str, got))


CLASHING = ["_score", "_kept", "_dropped", "row", "k1", "k2", "node", "fp", "spans", "items", "a column", "Text 2", "group", "doc", "runs", "pos"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, tables, stage):
    from pyspark.sql import functions as F

    work = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    plain, kept = work(spark, docs, tables), work(spark, more, tables)
    if stage != "bpe":
        assert kept.columns == more.columns and kept.select(*(F.col(f"`{c}`") for c in CLASHING)).distinct().collect() == [tuple(range(len(CLASHING)))]
        kept = kept.select(*docs.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_tables_of_nulls(spark, tables, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    schema = spark.read.parquet(f"{tables}/documents.parquet").schema
    assert work(spark, spark.createDataFrame([], schema), tables).count() == 0
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, None, None, None, None)], schema)
    assert work(spark, nulls, tables).count() == {"simhash_near_dedup": 1}.get(stage, 3)
