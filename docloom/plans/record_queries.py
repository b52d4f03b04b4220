"""Queries of record operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import dedup as D
from docloom.operators import records as R
from docloom.plans import base

def _as_of():
    return F.expr(base.AS_OF)

FIELDS = ["id", "url", "name", "price", "currency", "description", "brand", "sku", "rating", "review_count", "contact_email", "scraped_date", "stamp"]
REQUIRED, IMPORTANT = ["name", "price"], ["description", "currency"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.derived(spark, sf_dir, base.RECORDS)


def val_product(spark, sf_dir):
    v = R.validate(_records(spark, sf_dir), R.product_rules())
    return v.select("id", "is_valid", F.array_join(F.transform("issues", lambda x: F.concat(x["field"], F.lit(":"), x["code"])), ",").alias("issues"), R.count_severity("issues", "error").cast("long").alias("errors"))


def val_article(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    v = R.validate(d, R.json_schema_rules(R.ARTICLE))
    return v.select("doc_id", "is_valid", R.word_count(F.col("content")).cast("long").alias("word_count"))


def enr_geo_sentiment(spark, sf_dir):
    r = R.enrich(_records(spark, sf_dir), [R.geolocation, lambda df: R.sentiment(df, "description")])
    s = F.col("description_sentiment")
    return r.select("id", "country", F.round(s["score"], 6).alias("score"), s["positive_words"].alias("positive_words"), s["negative_words"].alias("negative_words"), s["label"].alias("label"))


def enr_merge(spark, sf_dir):
    own = F.create_map(F.lit("brand"), F.col("brand"), F.lit("currency"), F.coalesce("currency", F.lit("none")))
    new = F.create_map(F.lit("currency"), F.lit("EUR"), F.lit("k"), F.col("sku"))
    m = R.merge_maps(own, new)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _records(spark, sf_dir).select("id", pairs.alias("merged"))


def scored(spark, sf_dir) -> DataFrame:
    """The whole record pipeline: validate, find duplicates, enrich, score."""
    r = _records(spark, sf_dir)
    r = D.exact_duplicates(r, F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("brand", F.lit(""))), "id")
    names = r.select(*FIELDS)
    v = R.validate(r, R.product_rules())
    s = {
        "completeness": R.completeness_a(REQUIRED, IMPORTANT, FIELDS),
        "accuracy": R.accuracy_a(names, F.col("is_valid")),
        "consistency": R.consistency_a(names),
        "uniqueness": R.uniqueness(F.col("is_duplicate")),
        "timeliness": R.timeliness(F.col("stamp"), _as_of()),
    }
    v = v.withColumns(s)
    v = v.withColumn("overall", R.overall({k: F.col(k) for k in s}, R.WEIGHTS_A))
    return v.withColumn("level", R.level(F.round("overall", 9)))


def qs_pipeline(spark, sf_dir):
    cols = ["completeness", "accuracy", "consistency", "uniqueness", "timeliness", "overall"]
    return scored(spark, sf_dir).select("id", "is_valid", "is_duplicate", *(F.round(c, 6).alias(c) for c in cols), "level")


def qs_heuristics(spark, sf_dir):
    r = _records(spark, sf_dir)
    v = R.validate(r, R.product_rules())
    errors = R.count_severity("issues", "error")
    s = {"completeness": R.completeness_b(FIELDS), "accuracy": R.accuracy_b(r), "validity": R.validity_b(errors), "timeliness": R.timeliness(F.col("stamp"), _as_of(), 0.5)}
    return v.select("id", *(F.round(c, 6).alias(k) for k, c in s.items()), F.round(R.accuracy_c(), 6).alias("accuracy_c"), F.round(R.validity_ladder(), 6).alias("ladder"), F.round(R.timeliness_linear(F.col("stamp"), _as_of()), 6).alias("linear"), F.round(R.completeness_c(FIELDS), 6).alias("completeness_c"), R.grade(F.round(R.completeness_b(FIELDS), 9)).alias("grade"))


def qs_summary(spark, sf_dir):
    return R.summary(scored(spark, sf_dir)).select("n", *(F.round(c, 6).alias(c) for c in ("avg_score", "min_score", "max_score", "duplicate_rate")))


def qs_levels(spark, sf_dir):
    return R.level_distribution(scored(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def qs_issues(spark, sf_dir):
    return R.issue_report(scored(spark, sf_dir)).select("code", "n", "sample", F.array_join("fields", ",").alias("fields"))


def snk_good_and_unique(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.filter((F.round("overall", 9) >= 0.7) & ~F.col("is_duplicate")).select("id", F.coalesce("url", F.col("id").cast("string"), "content_hash").alias("sink_key"))


_R = f"({base.RECORDS})"
_ERR = [
    ("name:required", "name IS NULL"), ("price:required", "price IS NULL"), ("name:minLength", "length(name) < 1"), ("name:maxLength", "length(name) > 500"), ("price:minimum", "price < 0"),
    ("currency:pattern", "NOT regexp_matches(currency, '^(?:[A-Z]{3}$)')"), ("rating:minimum", "rating < 0"), ("rating:maximum", "rating > 5"), ("review_count:minimum", "review_count < 0"),
    ("url:pattern", "NOT regexp_matches(url, '^(?:https?://)')"), ("description:maxLength", "length(description) > 5000"), ("currency:currency_with_price", "price IS NOT NULL AND currency IS NULL"),
]
_ISSUES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _ERR) + "], lambda x: x IS NOT NULL)"
_MESSAGES = ", ".join(
    [f"('{f}', 'required', 'Missing required field: {f}')" for f in R.PRODUCT["required"]]
    + [f"('{f}', 'pattern', '{f} does not match its pattern')" for f, p in R.PRODUCT["properties"].items() if "pattern" in p]
    + [f"('{f}', '{k}', '{f} breaks {k} {v}')" for f, p in R.PRODUCT["properties"].items() for k, v in p.items() if k != "pattern"]
    + ["('currency', 'currency_with_price', 'A price needs a currency')"]
)
_FILLED = "(" + " + ".join(f"CASE WHEN {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> '' THEN 1 ELSE 0 END" for f in FIELDS) + ")"
_NOTNULL = "(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in FIELDS) + ")"
_DAYS = f"floor((epoch({base.AS_OF}) - epoch(stamp)) / 86400)"
_AGE = f"CASE WHEN {_DAYS} <= 1 THEN 1.0 WHEN {_DAYS} <= 7 THEN 0.9 WHEN {_DAYS} <= 30 THEN 0.7 WHEN {_DAYS} <= 365 THEN 0.5 ELSE 0.3 END"
_PLACE = "CASE WHEN " + " OR ".join("contains(lower({f}), '%s')" % p for p in ("lorem ipsum", "test", "example", "placeholder")) + " THEN 0.1 ELSE 0 END"
_STR = ["url", "name", "currency", "description", "brand", "sku", "contact_email", "scraped_date"]
_ACC_B = "greatest(0.0, 1.0 - " + " - ".join(_PLACE.format(f=f) + f" - CASE WHEN contains({f}, '<') AND contains({f}, '>') THEN 0.05 ELSE 0 END" for f in _STR) + ")"
_SCORED = f"""(SELECT *, completeness * 0.25 + accuracy * 0.30 + consistency * 0.20 + uniqueness * 0.15 + timeliness * 0.10 AS overall FROM (
  SELECT *, len(issues) = 0 AS is_valid, id <> f AS is_duplicate,
    0.6 * ((CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) / 2.0) + 0.3 * ((CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN currency IS NOT NULL THEN 1 ELSE 0 END) / 2.0) + 0.1 * ({_FILLED} / {len(FIELDS)}.0)::DOUBLE AS completeness,
    (CASE WHEN len(issues) = 0 THEN 1.0 ELSE 0.7 END * CASE WHEN NOT starts_with(url, 'http://') AND NOT starts_with(url, 'https://') THEN 0.9 ELSE 1.0 END * CASE WHEN NOT contains(contact_email, '@') OR NOT contains(contact_email, '.') THEN 0.9 ELSE 1.0 END * CASE WHEN price < 0 THEN 0.8 ELSE 1.0 END)::DOUBLE AS accuracy,
    (CASE WHEN price IS NOT NULL AND coalesce(currency, '') = '' THEN 0.9 ELSE 1.0 END * CASE WHEN scraped_date <> '' AND NOT regexp_matches(scraped_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 0.95 ELSE 1.0 END)::DOUBLE AS consistency,
    CASE WHEN id <> f THEN 0.3 ELSE 1.0 END::DOUBLE AS uniqueness, CASE WHEN stamp IS NULL THEN 1.0 ELSE {_AGE} END::DOUBLE AS timeliness
  FROM (SELECT *, {_ISSUES} AS issues, min(id) OVER (PARTITION BY coalesce(name, '') || '|' || coalesce(brand, '')) AS f FROM {_R})))"""
_LEVEL = "CASE WHEN round(overall, 9) >= 0.9 THEN 'excellent' WHEN round(overall, 9) >= 0.7 THEN 'good' WHEN round(overall, 9) >= 0.5 THEN 'acceptable' WHEN round(overall, 9) >= 0.3 THEN 'poor' ELSE 'invalid' END"
_GRADE = "CASE WHEN round(c, 9) >= 0.9 THEN 'A' WHEN round(c, 9) >= 0.8 THEN 'B' WHEN round(c, 9) >= 0.7 THEN 'C' WHEN round(c, 9) >= 0.6 THEN 'D' ELSE 'F' END"
_WORDS = r"list_distinct(regexp_extract_all(lower(description), '[\p{L}\p{N}_]+'))"
_LEX = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"

SQL: dict[str, str | None] = {
    "val_product": f"SELECT id, len(i) = 0 AS is_valid, array_to_string(i, ',') AS issues, CAST(len(i) AS BIGINT) AS errors FROM (SELECT id, {_ISSUES} AS i FROM {_R})",
    "val_article": r"SELECT doc_id, source IS NOT NULL AND text IS NOT NULL AND length(source) BETWEEN 1 AND 1000 AND length(text) >= 10 AS is_valid, CAST(CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(string_split_regex(trim(text, ' '), '\s+')) END AS BIGINT) AS word_count FROM documents",
    "enr_geo_sentiment": f"""SELECT id, CASE lower(regexp_extract(url, '^[a-z]+://[^/?#]*\\.([^./?#]*)', 1)) WHEN 'uk' THEN 'United Kingdom' WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' END AS country,
      round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) END, 6) AS score, CASE WHEN p + n > 0 THEN p END AS positive_words, CASE WHEN p + n > 0 THEN n END AS negative_words,
      CASE WHEN p + n > 0 THEN CASE WHEN (p - n) / (p + n) > 0.1 THEN 'positive' WHEN (p - n) / (p + n) < -0.1 THEN 'negative' ELSE 'neutral' END END AS label
      FROM (SELECT id, url, CAST(len(list_intersect({_WORDS}, {_LEX(R.POSITIVE)})) AS BIGINT) AS p, CAST(len(list_intersect({_WORDS}, {_LEX(R.NEGATIVE)})) AS BIGINT) AS n FROM {_R})""",
    "enr_merge": f"SELECT id, 'brand=' || brand || ';currency=EUR;k=' || sku AS merged FROM {_R}",
    "qs_pipeline": f"SELECT id, is_valid, is_duplicate, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency, round(uniqueness, 6) AS uniqueness, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall, {_LEVEL} AS level FROM {_SCORED}",
    "qs_heuristics": f"""SELECT id, round(c, 6) AS completeness, round(({_ACC_B})::DOUBLE, 6) AS accuracy, round(greatest(0.0, 1 - e * 0.2)::DOUBLE, 6) AS validity, round(CASE WHEN stamp IS NULL THEN 0.5 ELSE {_AGE} END::DOUBLE, 6) AS timeliness,
      CASE WHEN e = 0 THEN 1.0 ELSE round(greatest(0.0, 1 - 0.8), 6) END::DOUBLE AS accuracy_c, round(CASE WHEN e = 0 THEN 1.0 ELSE greatest(0.0, 0.5 - e * 0.1) END::DOUBLE, 6) AS ladder, round(CASE WHEN stamp IS NULL THEN 0.5 ELSE greatest(0.0, 1 - {_DAYS} / 365) END::DOUBLE, 6) AS linear, round({_NOTNULL} / {len(FIELDS)}, 6) AS completeness_c, {_GRADE} AS grade
      FROM (SELECT *, {_FILLED} / {len(FIELDS)} AS c, len({_ISSUES}) AS e FROM {_R})""",
    "qs_summary": f"SELECT count(*) AS n, round(avg(overall), 6) AS avg_score, round(min(overall), 6) AS min_score, round(max(overall), 6) AS max_score, round(avg(CASE WHEN is_duplicate THEN 1.0 ELSE 0.0 END), 6) AS duplicate_rate FROM {_SCORED}",
    "qs_levels": f"SELECT l AS level, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM part), 6) AS percent FROM (SELECT unnest(['excellent', 'good', 'acceptable', 'poor', 'invalid']) AS l) LEFT JOIN (SELECT {_LEVEL} AS level, count(*) AS n FROM {_SCORED} GROUP BY 1) ON l = level",
    "qs_issues": "SELECT code, count(*) AS n, min(message) AS sample, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM (SELECT string_split(unnest(" + _ISSUES + "), ':') AS x FROM " + _R + ") JOIN (VALUES " + _MESSAGES + ") m(field, code, message) ON m.field = x[1] AND m.code = x[2] GROUP BY code",
    "snk_good_and_unique": f"SELECT id, coalesce(url, CAST(id AS VARCHAR)) AS sink_key FROM {_SCORED} WHERE round(overall, 9) >= 0.7 AND NOT is_duplicate",
}
QUERIES = {name: globals()[name] for name in SQL}
