"""Validation, enrichment and quality scores of records.

Rules are data: each is a condition that must not hold, with field, code,
severity and message.  A rule set compiles to one array column of issues, so any
number of rules is one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U

#: Sentiment lexicons.
POSITIVE = ("good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like", "best", "awesome", "perfect", "happy", "pleased")
NEGATIVE = ("bad", "terrible", "awful", "horrible", "poor", "worst", "hate", "dislike", "disappointing", "broken", "useless", "angry")
#: Weights of severities, score dimensions, placeholders and ladders.
SEVERITY = {"critical": 1.0, "error": 0.8, "warning": 0.3, "info": 0.1}
WEIGHTS_A = {"completeness": 0.25, "accuracy": 0.30, "consistency": 0.20, "uniqueness": 0.15, "timeliness": 0.10}
WEIGHTS_C = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "timeliness": 0.15, "uniqueness": 0.10, "validity": 0.05}
PLACEHOLDERS = ("lorem ipsum", "test", "example", "placeholder")
LEVELS = ((0.9, "excellent"), (0.7, "good"), (0.5, "acceptable"), (0.3, "poor"))
GRADES = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))
AGES = ((1, 1.0), (7, 0.9), (30, 0.7), (365, 0.5))


@dataclass(frozen=True)
class Rule:
    field: str
    code: str
    severity: str
    message: str
    broken: Column


def issues(rules: list[Rule]) -> Column:
    """The issues of a row; a condition that is null is no issue."""
    made = [F.when(r.broken, F.struct(F.lit(r.field).alias("field"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    return F.array_compact(F.array(*made))


def count_severity(column: str, severity: str) -> Column:
    return F.size(F.filter(column, lambda x: x["severity"] == severity))


def json_schema_rules(schema: dict) -> list[Rule]:
    """Rules of a JSON-Schema subset: required, type, pattern (a prefix match), enum, minimum, maximum, minLength, maxLength."""
    out = []
    for name in schema.get("required", []):
        out.append(Rule(name, "required", "error", f"Missing required field: {name}", F.col(name).isNull()))
    for name, p in schema.get("properties", {}).items():
        c = F.col(name)
        if "pattern" in p:
            out.append(Rule(name, "pattern", "error", f"{name} does not match its pattern", ~c.rlike("^(?:" + p["pattern"] + ")")))
        if "enum" in p:
            out.append(Rule(name, "enum", "error", f"{name} is none of its values", ~c.isin(*p["enum"])))
        for key, bad in (("minimum", lambda v, c=c: c < v), ("maximum", lambda v, c=c: c > v), ("minLength", lambda v, c=c: F.length(c) < v), ("maxLength", lambda v, c=c: F.length(c) > v)):
            if key in p:
                out.append(Rule(name, key, "error", f"{name} breaks {key} {p[key]}", bad(p[key])))
    return out


PRODUCT = {
    "required": ["name", "price"],
    "properties": {
        "name": {"minLength": 1, "maxLength": 500},
        "price": {"minimum": 0},
        "currency": {"pattern": "[A-Z]{3}$"},
        "rating": {"minimum": 0, "maximum": 5},
        "review_count": {"minimum": 0},
        "url": {"pattern": "https?://"},
        "description": {"maxLength": 5000},
    },
}
ARTICLE = {"required": ["title", "content"], "properties": {"title": {"minLength": 1, "maxLength": 1000}, "content": {"minLength": 10}}}
SCHEMAS = {"product": PRODUCT, "article": ARTICLE}


def product_rules() -> list[Rule]:
    """The product schema, and a currency wherever there is a price."""
    return [*json_schema_rules(PRODUCT), Rule("currency", "currency_with_price", "error", "A price needs a currency", F.col("price").isNotNull() & F.col("currency").isNull())]


def word_count(x: Column) -> Column:
    """Words between white space; none in empty text."""
    return F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("issues", issues(rules)).withColumn("is_valid", ~F.exists("issues", lambda x: x["severity"].isin("error", "critical")))


# enrichment


def geolocation(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("country", U.country(F.col(url)))


def sentiment(df: DataFrame, field: str) -> DataFrame:
    """Add ``<field>_sentiment``: score, counts of distinct words and label; null where no lexicon word occurs."""
    words = F.array_distinct(T.tokens(F.col(field)))
    p = F.size(F.array_intersect(words, F.array(*map(F.lit, POSITIVE))))
    n = F.size(F.array_intersect(words, F.array(*map(F.lit, NEGATIVE))))
    score = (p - n) / (p + n).cast("double")
    label = F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
    made = F.struct(score.alias("score"), p.cast("long").alias("positive_words"), n.cast("long").alias("negative_words"), label.alias("label"))
    return df.withColumn(f"{field}_sentiment", F.when(p + n > 0, made))


def merge_maps(own: Column, new: Column) -> Column:
    """The new map's values win; for maps of strings."""
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def enrich(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(DataFrame.transform, steps, df)


# scores


def _share(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0)) / float(max(1, len(conditions)))


def _filled(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & (c.cast("string") != "")


def completeness_a(required: list[str], important: list[str], fields: list[str]) -> Column:
    parts = [(0.6, _share([F.col(c).isNotNull() for c in required]) if required else F.lit(1.0)), (0.3, _share([F.col(c).isNotNull() for c in important]) if important else F.lit(1.0)), (0.1, _share([_filled(c) for c in fields]))]
    return sum((x * w for w, x in parts), F.lit(0.0))


def completeness_b(fields: list[str]) -> Column:
    return _share([_filled(c) for c in fields])


def completeness_c(fields: list[str], required: list[str] | None = None) -> Column:
    return _share([F.col(c).isNotNull() for c in (required or fields)])


def _product(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, parts, F.lit(1.0))


def accuracy_a(df: DataFrame, is_valid: Column) -> Column:
    """0.7 if invalid, 0.9 for every bad URL or e-mail field, 0.8 for every negative price, by field name."""
    parts = [F.when(is_valid, 1.0).otherwise(0.7)]
    for name, kind in df.dtypes:
        c, low = F.col(name), name.lower()
        if "url" in low and kind == "string":
            parts.append(F.when(~c.startswith("http://") & ~c.startswith("https://"), 0.9).otherwise(1.0))
        elif "email" in low and kind == "string":
            parts.append(F.when(~c.contains("@") | ~c.contains("."), 0.9).otherwise(1.0))
        elif "price" in low and kind in ("double", "float", "int", "bigint"):
            parts.append(F.when(c < 0, 0.8).otherwise(1.0))
    return _product(parts)


def accuracy_b(df: DataFrame) -> Column:
    """0.1 off for every placeholder, 0.05 for every field with tags and every huge number."""
    out = F.lit(1.0)
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "string":
            hit = reduce(lambda a, b: a | b, (F.lower(c).contains(p) for p in PLACEHOLDERS))
            out = out - F.when(hit, 0.1).otherwise(0.0)
            if "html" not in name.lower():
                out = out - F.when(c.contains("<") & c.contains(">"), 0.05).otherwise(0.0)
        elif kind in ("double", "float", "int", "bigint"):
            out = out - F.when(F.abs(c) > 1e10, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def accuracy_c(column: str = "issues") -> Column:
    """One less the mean severity of the issues."""
    weight = F.lit(0.5)
    total = F.aggregate(column, F.lit(0.0), lambda s, x: s + reduce(lambda e, kv: F.when(x["severity"] == kv[0], kv[1]).otherwise(e), SEVERITY.items(), weight))
    return F.when(F.size(column) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - total / F.size(column)))


def consistency_a(df: DataFrame) -> Column:
    """0.9 for every price without any currency, 0.95 for every date that isn't YYYY-MM-DD."""
    prices = [c for c, _ in df.dtypes if "price" in c.lower()]
    currencies = [c for c, _ in df.dtypes if "currency" in c.lower()]
    parts = []
    if currencies:
        some = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")) != "" for c in currencies))
        parts += [F.when(F.col(p).isNotNull() & ~some, 0.9).otherwise(1.0) for p in prices]
    for name, kind in df.dtypes:
        if kind == "string" and ("date" in name.lower() or "time" in name.lower()):
            c = F.col(name)
            parts.append(F.when((c != "") & ~c.rlike(r"^\d{4}-\d{2}-\d{2}"), 0.95).otherwise(1.0))
    return _product(parts)


def consistency_groups(names: list[str], kinds: dict[str, str]) -> float:
    """The share of groups of like-named fields with one type; known from the schema alone."""
    import re

    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(re.sub("_(id|key|code)$", "", re.sub(r"\d+$", "", n)), []).append(n)
    several = [g for g in groups.values() if len(g) > 1]
    return sum(len({kinds[n] for n in g}) == 1 for g in several) / len(several) if several else 1.0


def uniqueness(is_duplicate: Column, has_id: bool = True) -> Column:
    return F.when(is_duplicate, 0.3).otherwise(1.0 if has_id else 0.7)


def age_days(stamp: Column, as_of: Column) -> Column:
    """Whole days, floored."""
    return F.floor((as_of.cast("long") - stamp.cast("long")) / 86400)


def timeliness(stamp: Column, as_of: Column, missing: float = 1.0) -> Column:
    days = age_days(stamp, as_of)
    out = F.lit(0.3)
    for most, value in reversed(AGES):
        out = F.when(days <= most, value).otherwise(out)
    return F.when(stamp.isNull(), missing).otherwise(out)


def timeliness_linear(stamp: Column, as_of: Column, max_age_days: int | None = None) -> Column:
    days = age_days(stamp, as_of)
    score = F.greatest(F.lit(0.0), 1 - days / 365) if max_age_days is None else F.when(days <= max_age_days, 1.0).otherwise(0.0)
    return F.when(stamp.isNull(), 0.5).otherwise(score)


def validity_ladder(column: str = "issues") -> Column:
    errors = F.size(F.filter(column, lambda x: x["severity"].isin("error", "critical")))
    return F.when(F.size(column) == 0, 1.0).when(errors == 0, 0.8).otherwise(F.greatest(F.lit(0.0), 0.5 - errors * 0.1))


def validity_b(errors: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - errors * 0.2)


def overall(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the dimensions that are there."""
    used = {k: w for k, w in weights.items() if k in scores}
    total = sum(used.values())
    return sum((scores[k] * (w / total) for k, w in used.items()), F.lit(0.0))


def boosted(score: Column, enrichments: Column) -> Column:
    return F.least(F.lit(1.0), score + F.least(F.lit(0.1), enrichments * 0.02))


def ladder(score: Column, steps: tuple, low: str) -> Column:
    out = F.lit(low)
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def level(score: Column) -> Column:
    return ladder(score, LEVELS, "invalid")


def grade(score: Column) -> Column:
    return ladder(score, GRADES, "F")


def report_text(score: str = "overall", name: str = "id") -> Column:
    return F.format_string("%s: %.3f (%s)", F.col(name).cast("string"), F.col(score), grade(F.col(score)))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.avg("overall").alias("avg_score"), F.min("overall").alias("min_score"), F.max("overall").alias("max_score"), F.avg(F.when(F.col("is_duplicate"), 1.0).otherwise(0.0)).alias("duplicate_rate"))


def level_distribution(scored: DataFrame) -> DataFrame:
    """Every level with its count and percentage, those without rows too."""
    names = [n for _, n in LEVELS] + ["invalid"]
    levels = scored.sparkSession.createDataFrame([(n,) for n in names], "level string")
    counts = scored.groupBy("level").agg(F.count("*").alias("n"))
    total = scored.agg(F.count("*").alias("total"))  # one row
    return F.broadcast(levels).join(counts, "level", "left").crossJoin(F.broadcast(total)).select("level", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("percent"))


def issue_report(scored: DataFrame) -> DataFrame:
    x = scored.select(F.explode("issues").alias("x"))
    return x.groupBy(F.col("x.code").alias("code")).agg(F.count("*").alias("n"), F.min("x.message").alias("sample"), F.sort_array(F.collect_set("x.field")).alias("fields"))


def recommendations(report: DataFrame) -> DataFrame:
    """Rule-based advice on a summary row."""
    rules = ((F.col("avg_score") < 0.7, "Improve data quality at the source"), (F.col("duplicate_rate") > 0.1, "Tighten deduplication"), (F.col("min_score") < 0.3, "Reject records of the lowest level"))
    return report.select(F.array_compact(F.array(*(F.when(c, m) for c, m in rules))).alias("recommendations"))


def consistency_b(lists: list[str], dates: list[str]) -> Column:
    """1, less a tenth for each JSON list of mixed types, and, with several date fields, for each that can't be read; 0 at least."""
    kinds = lambda c: F.expr(f"size(array_distinct(transform(cast(try_parse_json(`{c}`) as array<variant>), v -> schema_of_variant(v)))) > 1")
    out = F.lit(1.0)
    for c in lists:
        out = out - F.when(kinds(c), 0.1).otherwise(0.0)
    if len(dates) > 1:
        for c in dates:
            read = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.col(c).try_cast("timestamp")))
            out = out - F.when(F.col(c).isNotNull() & read.isNull(), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def name_groups(rows: DataFrame) -> DataFrame:
    """(base, fields, one_type) of (field, kind) rows: fields that differ by digits or an _id, _key or _code at the end, several of a kind or not."""
    stem = F.regexp_replace(F.regexp_replace("field", r"\d+$", ""), "_(id|key|code)$", "")
    # a set of a few kinds, in a hash table: the least text of a group would be found by sorting all rows
    one = rows.filter("kind <> 'null'").groupBy("field").agg(F.array_min(F.collect_set("kind")).alias("kind"))
    g = one.groupBy(stem.alias("base")).agg(F.count("*").alias("fields"), F.count_distinct("kind").alias("kinds"))
    return g.filter("fields > 1").select("base", "fields", (F.col("kinds") == 1).alias("one_type"))


def consistency_reference(records: DataFrame, reference: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Records with ``consistency``: the mean over fields of the share of reference rows that have a value's form.

    ``fields`` names for each a pattern that its well-formed values match; a
    value without it agrees with no reference value that has it.  The reference is
    ten rows, so its shares are one row.
    """
    has = {f: F.coalesce(F.col(f).rlike(p), F.lit(False)) for f, p in fields.items()}
    shares = reference.agg(F.count("*").alias("_n"), *(F.count_if(has[f]).alias(f"_{f}") for f in fields))
    j = records.crossJoin(F.broadcast(shares))
    each = [F.when(has[f], F.col(f"_{f}")).otherwise(F.col("_n") - F.col(f"_{f}")) / F.col("_n") for f in fields]
    return j.withColumn("consistency", sum(each[1:], each[0]) / len(each)).drop("_n", *(f"_{f}" for f in fields))
