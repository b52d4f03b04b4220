r"""Queries of text, URL and dedup operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import dedup as D
from docloom.operators.state import written
from docloom.plans import base


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dealt evenly to twice as many tasks as a shuffle has: a token's hashes cost far more than moving its text."""
    return _docs(spark, sf_dir).select("doc_id", "text").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def txt_clean(spark, sf_dir):
    x = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean(x)).alias("clean_md5"), F.md5(T.clean_spaces(x)).alias("spaces_md5"), F.length(T.clean(x)).cast("long").alias("n"))


def txt_regex(spark, sf_dir):
    x = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.find_all(x, r"\b(th[a-z]+)", case_sensitive=False)).cast("long").alias("n_th"), T.find_first(x, r"([A-Z][a-z]{6,})", "none").alias("first_long"), x.rlike(r"\d").alias("has_digit"))


def txt_case_pad(spark, sf_dir):
    n = F.col("p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.upper(n).alias("u"), F.lower("p_brand").alias("l"), F.initcap(n).alias("title"), T.swap_case(F.col("p_brand")).alias("swapped"), T.sort_chars(n).alias("sorted"),
        T.pad(n, 12).alias("ljust"), T.pad(n, 12, ".", "left").alias("rjust"), T.zero_fill(F.col("p_size").cast("string"), 5).alias("z"), F.btrim(n, F.lit("rsed")).alias("stripped"),
        F.replace(n, F.lit("red"), F.lit("blue")).alias("replaced"), F.array_join(F.split(n, " "), "_").alias("joined"), F.translate(n, "aeiou", "12345").alias("tr"), F.format_string("%s:%d", n, F.col("p_size")).alias("fmt"),
    )


def txt_hashes(spark, sf_dir):
    x = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.text_hash(x).alias("text_hash"), F.sha2(x, 256).alias("sha256"), F.sha1(x).alias("sha1"), F.md5(x).alias("md5"), T.identifier_hash(F.col("source")).alias("identifier"))


def txt_dynamic(spark, sf_dir):
    v = F.array(F.col("url"), F.md5("url"), F.concat(F.lit("session-"), F.col("page_id")), F.col("page_id").cast("string"), F.lit("bcdfghjk1"), F.lit("content-main"))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(v).alias("pos", "v")).select("page_id", F.col("pos").cast("long").alias("pos"), T.is_dynamic(F.col("v")).alias("is_dynamic"), T.looks_dynamic(F.col("v")).alias("looks_dynamic"))


def txt_tokens(spark, sf_dir):
    tok = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tok).cast("long").alias("n"), F.size(F.array_distinct(tok)).cast("long").alias("n_distinct"), F.get(tok, F.lit(0)).alias("first"))


def txt_weighted_tokens(spark, sf_dir):
    return D.weighted_tokens(_docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("w").alias("total"), F.max("w").alias("most"))


def txt_shingles(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("words"))
    sets = words.select("doc_id", T.shingles(F.col("words")).alias("s"))
    s = F.col("s")
    return sets.select("doc_id", F.size(s).cast("long").alias("n_shingles"), F.md5(F.array_join(F.sort_array(s), "|")).alias("set_md5"))


def txt_record_text(spark, sf_dir):
    r = base.derived(spark, sf_dir, base.RECORDS)
    return r.select("id", F.md5(T.record_text(["url", "name", "currency", "brand"])).alias("keyed"), F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))).alias("joined"))


def txt_common_affix(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.concat(F.lit("item-"), "p_type", F.lit("-"), "p_brand", F.lit(".html")).alias("s"))
    g = p.groupBy("p_brand").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(F.reverse("s")).alias("rlo"), F.max(F.reverse("s")).alias("rhi"))
    return g.select("p_brand", T.common_prefix(F.col("lo"), F.col("hi")).alias("prefix"), F.reverse(T.common_prefix(F.col("rlo"), F.col("rhi"))).alias("suffix"))


def txt_unescape(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(T.unescape_all(F.col("html"))).alias("decoded_md5"))


def txt_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"), U.url_hash(F.col("url")).alias("url_hash"), U.host(F.col("url")).alias("host"), U.url_pattern(F.col("url")).alias("pattern"))


def url_allowed(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("allowed", U.domain_allowed(F.col("url"), ["example.com", "therin.example.net"]))
    return p.groupBy("allowed").agg(F.count("*").alias("n"))


def d1_exact(spark, sf_dir):
    return D.exact_duplicates(_docs(spark, sf_dir).select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "content_hash", "is_duplicate", "duplicate_of")


def _fp(fps):
    return fps.select("doc_id", T.hex64(F.col("fp")).alias("fp"))


def d2_simhash(spark, sf_dir):
    return _fp(D.simhash(D.word_tokens(_docs(spark, sf_dir), "doc_id", "text"), "doc_id", "token", digest="sha256"))


def d3_simhash(spark, sf_dir):
    return _fp(_d3(spark, sf_dir))


def d4_simhash(spark, sf_dir):
    return _fp(D.shingle_simhash(_spread(spark, sf_dir), "doc_id", "text"))


def _d3(spark, sf_dir):
    return D.word_simhash(_docs(spark, sf_dir), "doc_id", "text")


def d6_near_duplicate_pairs(spark, sf_dir):
    return D.near_pairs(_d3(spark, sf_dir), "doc_id").withColumn("distance", F.col("distance").cast("long"))


def d6_membership(spark, sf_dir):
    return D.membership(_d3(spark, sf_dir), "doc_id").select("doc_id", "representative")


def d7_first_seen(spark, sf_dir):
    return D.first_seen_near(_d3(spark, sf_dir), "doc_id")


def _shingled(spark, sf_dir):
    """Signatures of the three-word shingles."""
    return D.minhash(_spread(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("words")), "doc_id", "words", form="prefix", k=3)


def _signed(words):
    return D.minhash(words, "doc_id", "words")


def _word_sets(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))


def d8_minhash(spark, sf_dir):
    return _signed(_word_sets(spark, sf_dir)).select("doc_id", F.md5(F.array_join("signature", "")).alias("signature_md5"))


def d9_minhash(spark, sf_dir):
    return _shingled(spark, sf_dir).select("doc_id", F.md5(F.array_join("signature", "")).alias("signature_md5"))


def d10_d11_minhash_pairs(spark, sf_dir):
    return D.minhash_pairs(_shingled(spark, sf_dir), "doc_id").withColumn("similarity", F.round("similarity", 6))


def d11_index(spark, sf_dir):
    """An index of all documents, without every seventh, asked for every fiftieth."""
    signed = written(D.packed(_shingled(spark, sf_dir), "doc_id"))
    index = D.banded(signed.filter("doc_id % 2 = 0"), "doc_id").unionByName(D.banded(signed.filter("doc_id % 2 <> 0"), "doc_id"))
    left = index.join(signed.filter("doc_id % 7 = 0").select("doc_id"), "doc_id", "left_anti")
    return D.minhash_query(left, signed.filter("doc_id % 50 = 0"), signed, "doc_id").withColumn("similarity", F.round("similarity", 6))


def d12_word_minhash(spark, sf_dir):
    return D.minhash_pairs(_signed(_word_sets(spark, sf_dir)), "doc_id").withColumn("similarity", F.round("similarity", 6))


def d16_d17_pick(spark, sf_dir):
    r = base.derived(spark, sf_dir, base.RECORDS)
    content = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("name"), F.lit("")))
    sim = F.col("rating") / 10
    return r.select("id", content.alias("content"), F.coalesce(F.col("url"), F.col("sku")).alias("identifier"), D.confidence(sim).alias("batch"), F.round(D.confidence(sim, sim > 0.5), 6).alias("single"))


def d18_unseen(spark, sf_dir):
    t = base.derived(spark, sf_dir, base.TASKS).withColumn("url_hash", U.url_hash(F.col("url")))
    return D.unseen(t.filter("task_id % 2 = 0").select("url_hash"), t.filter("task_id % 2 = 1 AND priority = 0"))


_DOC = "FROM documents"
_SPACED = "regexp_replace(translate(text, chr(9) || chr(13) || chr(10), {to}), ' +', ' ', 'g')"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_CANON = "CASE WHEN q = '' THEN b ELSE b || '?' || array_to_string(list_sort(string_split(q, '&')), '&') END"
_SPLIT = r"(SELECT *, regexp_extract(lower(trim(url)), '^([^?#]*)(?:\?([^#]*))?(#.*)?$', 1) AS b, regexp_extract(lower(trim(url)), '^([^?#]*)(?:\?([^#]*))?(#.*)?$', 2) AS q FROM {t})"
_BITS = """SELECT doc_id, printf('%016x', bit_or(CASE WHEN v > 0 THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END)) AS fp
FROM (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN w ELSE -w END) AS v FROM (SELECT doc_id, w, ('0x' || right({digest}, 16))::UBIGINT AS h, unnest(range(64))::UBIGINT AS i FROM ({tokens})) GROUP BY doc_id, i) GROUP BY doc_id"""
_WEIGHTED = r"SELECT doc_id, token, count(*) AS w FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) AS token FROM documents) WHERE length(token) > 2 GROUP BY ALL"
_WORDS = f"SELECT doc_id, unnest({_TOK}) AS token, 1 AS w {_DOC}"
_SHINGLES = f"SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS token, 1 AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT doc_id, {_TOK} AS t {_DOC}) WHERE len(t) >= 3)"
_D3 = _BITS.format(digest="md5(token)", tokens=_WEIGHTED)
_REPS = f"SELECT fp, min(doc_id) AS k FROM ({_D3}) GROUP BY fp"
_HASHED = "SELECT doc_id, list_transform(range(128), lambda i: list_min(list_transform(t, lambda x: md5({salted})))) AS s FROM ({sets}) WHERE len(t) > 0"
_WORD_SETS = f"SELECT doc_id, list_distinct({_TOK}) AS t FROM documents"
_SHINGLE_SETS = f"SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i + 2], ' '))) AS t FROM (SELECT doc_id, {_TOK} AS t FROM documents)"
_SUFFIXED = _HASHED.format(salted="x || '_' || i", sets=_WORD_SETS)
_PREFIXED = _HASHED.format(salted="i || ':' || x", sets=_SHINGLE_SETS)
_SAME = "len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / 128"
_MINPAIRS = "WITH m AS MATERIALIZED ({signed}), c AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY s) AS r FROM m), p AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM c WHERE doc_id = r) SELECT x.doc_id AS a, y.doc_id AS b, round(" + _SAME + ", 6) AS similarity FROM p x JOIN p y ON x.doc_id < y.doc_id WHERE " + _SAME + " >= 0.85 UNION ALL SELECT r, doc_id, 1.0 FROM c WHERE doc_id > r"
_RECORDS = f"({base.RECORDS})"
_TASKS_U = f"(SELECT task_id, priority, sha256({_CANON}) AS url_hash FROM {_SPLIT.format(t='(' + base.TASKS + ')')})"

SQL: dict[str, str | None] = {
    "txt_clean": f"SELECT doc_id, md5(trim({_SPACED.format(to=chr(39) + '   ' + chr(39))}, ' ')) AS clean_md5, md5(regexp_replace(replace(replace(replace(text, chr(9), ' '), chr(13), ''), chr(10), ''), ' +', ' ', 'g')) AS spaces_md5, length(trim({_SPACED.format(to=chr(39) + '   ' + chr(39))}, ' ')) AS n {_DOC}",
    "txt_regex": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(th[a-z]+)', 1)) AS BIGINT) AS n_th, coalesce(nullif(regexp_extract(text, '([A-Z][a-z]{6,})', 1), ''), 'none') AS first_long, regexp_matches(text, '\d') AS has_digit FROM documents",
    "txt_case_pad": """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') AS title,
      array_to_string(list_transform(string_split(p_brand, ''), lambda c: CASE WHEN c = upper(c) THEN lower(c) ELSE upper(c) END), '') AS swapped, array_to_string(list_sort(string_split(p_name, '')), '') AS sorted,
      p_name || repeat(' ', greatest(12 - length(p_name), 0)) AS ljust, repeat('.', greatest(12 - length(p_name), 0)) || p_name AS rjust, lpad(CAST(p_size AS VARCHAR), 5, '0') AS z, trim(p_name, 'rsed') AS stripped,
      replace(p_name, 'red', 'blue') AS replaced, replace(p_name, ' ', '_') AS joined, translate(p_name, 'aeiou', '12345') AS tr, p_name || ':' || p_size AS fmt FROM part""",
    "txt_hashes": r"SELECT doc_id, CASE WHEN text = '' THEN '' ELSE substr(md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 1, 16) END AS text_hash, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5, sha256(lower(trim(source))) || '_' || strlen(lower(trim(source))) AS identifier FROM documents",
    "txt_dynamic": r"""SELECT page_id, CAST(pos AS BIGINT) AS pos, regexp_matches(v, '(?i)^[a-f0-9]{8,}$|^\d{10,}$|^[A-Za-z0-9+/]{20,}={0,2}$|^session|^temp|^generated') AS is_dynamic,
      length(v) > 20 OR (regexp_matches(v, '[A-Za-z0-9]{8,}') AND length(regexp_replace(lower(v), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(v) > 0.6) AS looks_dynamic
      FROM (SELECT page_id, unnest([url, md5(url), 'session-' || page_id, CAST(page_id AS VARCHAR), 'bcdfghjk1', 'content-main']) AS v, unnest(range(6)) AS pos FROM pages)""",
    "txt_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first FROM (SELECT doc_id, {_TOK} AS t {_DOC})",
    "txt_weighted_tokens": f"SELECT doc_id, count(*) AS n_tokens, CAST(sum(w) AS BIGINT) AS total, max(w) AS most FROM ({_WEIGHTED}) GROUP BY doc_id",
    "txt_shingles": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS set_md5 FROM (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i + 2], ' '))) AS s FROM (SELECT doc_id, {_TOK} AS t {_DOC}))",
    "txt_record_text": f"SELECT id, md5(concat_ws(' ', 'brand:' || brand, 'currency:' || currency, 'name:' || name, 'url:' || url)) AS keyed, concat_ws(' ', coalesce(name, ''), coalesce(description, '')) AS joined FROM {_RECORDS}",
    "txt_common_affix": """WITH s AS (SELECT p_brand, 'item-' || p_type || '-' || p_brand || '.html' AS s FROM part), g AS (SELECT p_brand, min(s) AS lo, max(s) AS hi, min(reverse(s)) AS rlo, max(reverse(s)) AS rhi FROM s GROUP BY p_brand)
      SELECT p_brand, lo[1:(SELECT coalesce(max(i), 0) FROM range(1, 200) r(i) WHERE i <= least(length(lo), length(hi)) AND lo[1:i] = hi[1:i])] AS prefix, reverse(rlo[1:(SELECT coalesce(max(i), 0) FROM range(1, 200) r(i) WHERE i <= least(length(rlo), length(rhi)) AND rlo[1:i] = rhi[1:i])]) AS suffix FROM g""",
    "txt_unescape": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&')) AS decoded_md5 FROM pages",
    "txt_json": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "url_canonical": f"SELECT page_id, {_CANON} AS canonical, sha256({_CANON}) AS url_hash, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) = '' THEN '' ELSE '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1) END AS pattern FROM {_SPLIT.format(t='pages')}",
    "url_allowed": "SELECT h = 'example.com' OR h = 'therin.example.net' OR suffix(h, '.example.com') OR suffix(h, '.therin.example.net') AS allowed, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages) GROUP BY 1",
    "d1_exact": "SELECT doc_id, sha256(text) AS content_hash, doc_id <> f AS is_duplicate, CASE WHEN doc_id <> f THEN f END AS duplicate_of FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)",
    "d2_simhash": _BITS.format(digest="sha256(token)", tokens=_WORDS),
    "d3_simhash": _D3,
    "d4_simhash": _BITS.format(digest="md5(token)", tokens=_SHINGLES),
    "d6_near_duplicate_pairs": f"WITH r AS MATERIALIZED (SELECT k, ('0x' || fp)::UBIGINT AS h FROM ({_REPS})) SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.h, y.h)) AS BIGINT) AS distance FROM r x JOIN r y ON x.k < y.k WHERE bit_count(xor(x.h, y.h)) <= 9",
    "d6_membership": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS representative FROM ({_D3})",
    "d7_first_seen": f"WITH RECURSIVE r AS MATERIALIZED (SELECT k, ('0x' || fp)::UBIGINT AS h, row_number() OVER (ORDER BY k) AS i FROM ({_REPS})), w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k BIGINT, h UBIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS duplicate_of UNION ALL SELECT i, CASE WHEN d IS NULL THEN list_append(kept, {{'k': k, 'h': h}}) ELSE kept END, k, d FROM (SELECT r.i, r.k, r.h, w.kept, list_filter(w.kept, lambda x: bit_count(xor(x.h, r.h)) <= 9)[1].k AS d FROM w JOIN r ON r.i = w.i + 1)) SELECT k, duplicate_of FROM w WHERE k IS NOT NULL",
    "d8_minhash": f"SELECT doc_id, md5(array_to_string(s, '')) AS signature_md5 FROM ({_SUFFIXED}) UNION ALL SELECT doc_id, NULL FROM ({_WORD_SETS}) WHERE len(t) = 0",
    "d9_minhash": f"SELECT doc_id, md5(array_to_string(s, '')) AS signature_md5 FROM ({_PREFIXED}) UNION ALL SELECT doc_id, NULL FROM ({_SHINGLE_SETS}) WHERE len(t) = 0",
    "d10_d11_minhash_pairs": _MINPAIRS.format(signed=_PREFIXED),
    "d11_index": f"WITH m AS MATERIALIZED ({_PREFIXED}) SELECT x.doc_id AS a, y.doc_id AS b, round({_SAME}, 6) AS similarity FROM m x JOIN m y ON x.doc_id <> y.doc_id AND x.doc_id % 50 = 0 AND y.doc_id % 7 <> 0 WHERE {_SAME} >= 0.85",
    "d12_word_minhash": _MINPAIRS.format(signed=_SUFFIXED),
    "d16_d17_pick": f"SELECT id, coalesce(nullif(description, ''), nullif(name, '')) AS content, coalesce(url, sku) AS identifier, CASE WHEN rating / 10 > 0.9 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS batch, round(CASE WHEN rating / 10 > 0.5 THEN least(1.0, 1.2 * (rating / 10)) ELSE 1 - rating / 10 END, 6) AS single FROM {_RECORDS}",
    "d18_unseen": f"SELECT DISTINCT url_hash FROM {_TASKS_U} WHERE task_id % 2 = 0 AND url_hash NOT IN (SELECT url_hash FROM {_TASKS_U} WHERE task_id % 2 = 1 AND priority = 0)",
}
QUERIES = {name: globals()[name] for name in SQL}
