"""Schema and type inference over (record, field, value) rows.

Inference is a query: values are rows, each field's type is a grouped vote.  All
steps are aggregates with partial sums; only the per-field results are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators.state import written

#: Formats of majority patterns, and date patterns of the learner.
FORMATS = {"email": "email", "url": "uri", "date": "date"}
DATES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{2}\.\d{4}", r"\w+ \d{1,2}, \d{4}")


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value, kind): a row for each field; values as text, kinds as JSON types."""
    kinds = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "float": "number", "boolean": "boolean"}
    types = dict(df.dtypes)
    made = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.when(F.col(f).isNull(), "null").otherwise(kinds.get(types[f], "string")).alias("kind")) for f in fields]
    return df.select(key, F.explode(F.array(*made)).alias("x")).select(key, "x.*")


def json_schema(rows: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """A row for each field: type, nullable, required, format, up to ``examples`` examples."""
    total = rows.agg(F.count_distinct(key).alias("total"))
    pattern = F.when((F.col("kind") == "string"), T.first_semantic_type(F.col("value")))
    marked = rows.withColumn("pattern", pattern)
    votes = marked.groupBy("field", "pattern").agg(F.count("*").alias("n")).filter("pattern IS NOT NULL")
    best = votes.groupBy("field").agg(F.max(F.struct("n", "pattern")).alias("b"), F.sum("n").alias("strings"))
    # a set of at most six kinds; with it the least text is kept in a hash table too, not by sorting all rows
    agg = rows.groupBy("field").agg(F.array_min(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("type"), F.count_if(F.col("kind") == "null").alias("nulls"), F.count("*").alias("seen"), F.min("value").alias("least"))
    out = agg.join(best, "field", "left").crossJoin(F.broadcast(total))
    major = F.when(F.col("b.n") * 2 > F.col("strings"), F.col("b.pattern"))
    formats = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return out.select("field", F.coalesce("type", F.lit("null")).alias("type"), (F.col("nulls") > 0).alias("nullable"), ((F.col("nulls") == 0) & (F.col("seen") >= F.col("total"))).alias("required"), F.try_element_at(formats, major).alias("format"), F.col("least").alias("example"))


def majority_types(rows: DataFrame) -> DataFrame:
    """(field, type): the first-match pattern with most votes; on a tie the earlier pattern, string last."""
    order = {n: i for i, n in enumerate([*T.PATTERNS, "string"])}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    named = rows.filter("value IS NOT NULL").withColumn("p", T.first_semantic_type(F.col("value")))
    votes = named.groupBy("field", "p").agg(F.count("*").alias("n"))
    return votes.groupBy("field").agg(F.max_by("p", F.struct("n", -rank[F.col("p")])).alias("type"))


def first_types(rows: DataFrame, key: str) -> DataFrame:
    """(field, type) by the first value that matches any pattern, else all numbers, all dates, text."""
    v = F.col("value")
    first = F.when(v.rlike("^https?://"), "url").when(v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email").when(v.rlike(DATES[0]), "date").when(v.rlike(r"^[+-]?[\d,]+(\.\d+)?$"), "number")
    x = rows.filter("value IS NOT NULL").withColumn("p", first)
    # the first row of each pattern in a hash table; ``min_by`` of a text would sort all rows
    each = x.groupBy("field", "p").agg(F.min(key).alias("first"), F.every(is_number(v)).alias("numbers"), F.every(is_date(v)).alias("dates"))
    g = each.groupBy("field").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("first"))).alias("p"), F.every("numbers").alias("numbers"), F.every("dates").alias("dates"))
    return g.select("field", F.coalesce("p", F.when(F.col("numbers"), "number"), F.when(F.col("dates"), "date"), F.lit("text")).alias("type"))


def is_number(v: Column) -> Column:
    return F.replace(v, F.lit(","), F.lit("")).try_cast("double").isNotNull()


def is_date(v: Column) -> Column:
    out = F.lit(False)
    for p in DATES:
        out = out | v.rlike(p)
    return out


def presence(rows: DataFrame, key: str) -> DataFrame:
    """(field, share, required): the share of records with a value."""
    total = F.broadcast(rows.agg(F.count_distinct(key).alias("total")))
    g = rows.groupBy("field").agg(F.count("value").alias("n")).crossJoin(total)
    return g.select("field", (F.col("n") / F.col("total")).alias("share"), (F.col("n") == F.col("total")).alias("required"))


def transformations(rows: DataFrame) -> DataFrame:
    """(field, steps): what the values seem to need."""
    v = F.col("value")
    g = rows.filter("value IS NOT NULL").groupBy("field").agg(
        F.bool_or((v != F.trim(v)) | v.contains("  ")).alias("spaces"), F.bool_or(v.rlike("&(amp|lt|gt|quot|#\\d+);")).alias("entities"), F.bool_or(v.contains(",") & is_number(v)).alias("commas"), F.every(is_date(v)).alias("dates")
    )
    steps = F.array_compact(F.array(F.when(F.col("spaces"), "normalize_whitespace"), F.when(F.col("entities"), "unescape_html"), F.when(F.col("commas"), "remove_commas"), F.when(F.col("dates"), "date_parse")))
    return g.select("field", steps.alias("steps"))


def confidence(rows: DataFrame, key: str) -> DataFrame:
    """min(1, records / 10) times the mean presence of the fields."""
    p = presence(rows, key).agg(F.avg("share").alias("mean"))
    n = rows.agg(F.count_distinct(key).alias("n"))
    return p.crossJoin(F.broadcast(n)).select((F.least(F.lit(1.0), F.col("n") / 10.0) * F.col("mean")).alias("confidence"))


def top_votes(rows: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    votes = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return votes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def features(rows: DataFrame) -> DataFrame:
    """Mean feature vector of each field: length, digits, letters, spaces, punctuation, all as shares or over 100."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda p: F.length(F.regexp_replace(v, p, "")) / n
    return rows.filter("value IS NOT NULL").groupBy("field").agg(F.avg(F.length(v) / 100.0).alias("f0"), F.avg(share("[^0-9]")).alias("f1"), F.avg(share(r"[^\p{L}]")).alias("f2"), F.avg(share(r"[^\s]")).alias("f3"), F.avg(share(r"[\p{L}0-9\s]")).alias("f4"))


#: Dimensions that the grid is laid over; a point looks into 3 cells for each.
GRID = 3


def _near(points: DataFrame, dims: list[str], eps: float) -> DataFrame:
    """(a, b) of different points at most ``eps`` apart, both ways.

    A point meets those of its own and the bordering cells of a grid of width
    ``eps`` over the first ``GRID`` dimensions, which leaves no pair out.
    """
    cells = [F.floor(F.col(d) / eps).alias(f"c{i}") for i, d in enumerate(dims[:GRID])]
    own = points.select("id", *dims, *cells)
    around = own
    for i in range(len(cells)):
        around = around.withColumn(f"c{i}", F.explode(F.array(*(F.col(f"c{i}") + step for step in (-1, 0, 1)))))
    x, y = own.alias("x"), around.alias("y")
    same = F.col("x.id") != F.col("y.id")
    for i in range(len(cells)):
        same = same & (F.col(f"x.c{i}") == F.col(f"y.c{i}"))
    apart = F.sqrt(sum((F.pow(F.col(f"x.{d}") - F.col(f"y.{d}"), 2) for d in dims), F.lit(0.0)))
    return x.join(y, same).filter(apart <= eps).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def clusters(vectors: DataFrame, key: str, dims: list[str], eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """(key, cluster) by density: the least core key of a cluster, null for noise.

    Rows at the same place are one point with a weight.  A point is core if it and
    those at most ``eps`` away weigh ``min_samples``; core points that near are one
    cluster, and others join the first cluster of a core point near them.  Labels
    spread by the least neighbour and by jumping to the label's own label, each
    round written to the shared folder.  Rows with a null or NaN coordinate, or a
    null key, are noise.
    """
    fine = F.col(key).isNotNull()
    for d in dims:
        fine = fine & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    placed = vectors.select(F.col(key).alias("key"), *(F.col(d).cast("double").alias(f"x{i}") for i, d in enumerate(dims)), F.coalesce(fine, F.lit(False)).alias("fine"))
    dims = [f"x{i}" for i in range(len(dims))]
    at = placed.filter("fine").select(F.col("key").alias("id"), *dims)
    points = written(at.groupBy(*dims).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    near = written(_near(points, dims, eps))
    around = near.join(points.select(F.col("id").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.sum("m").alias("m"))
    core = written(points.join(around, F.col("id") == F.col("a"), "left").filter(F.col("n") + F.coalesce("m", F.lit(0)) >= min_samples).select("id"))
    links = written(near.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi"))
    label = core.select(F.col("id").alias("k"), F.col("id").alias("c"))
    while True:
        low = links.join(label, F.col("b") == F.col("k")).groupBy("a").agg(F.min("c").alias("m"))
        least = written(label.join(low, F.col("k") == F.col("a"), "left").select("k", F.least("c", F.coalesce("m", "c")).alias("n"), "c"))
        onward = least.select(F.col("k").alias("n"), F.col("n").alias("q"))
        label = written(least.join(onward, "n", "left").select("k", F.least("n", F.coalesce("q", "n")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        if not label.filter("moved").limit(1).count():
            break
        label = label.select("k", "c")
    border = near.join(label.select(F.col("k").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("d"))
    of_point = points.join(label.select("k", "c"), F.col("id") == F.col("k"), "left").join(border, F.col("id") == F.col("a"), "left").select(*dims, F.coalesce("c", "d").alias("cluster"))
    same = F.col("fine")
    o = of_point.select(*(F.col(d).alias(f"_{d}") for d in dims), "cluster")
    for d in dims:
        same = same & (F.col(d) == F.col(f"_{d}"))
    return placed.join(o, same, "left").select(F.col("key").alias(key), "cluster")


def page_type(html: Column) -> Column:
    """By counts of telling tags."""
    n = lambda tag: F.regexp_count(html, F.lit(f"(?i)<{tag}[\\s>]"))
    return F.when(n("article") > 0, "article").when(html.rlike("(?i)class=\"[^\"]*price"), "product").when(n("table") > 0, "table").when(n("form") > 0, "form").when(n("li") > 5, "list").otherwise("generic")


def example_scores(examples: DataFrame, url: Column, domain: str = "url") -> DataFrame:
    """Stored examples ranked: 0.5 for the same domain, 0.3 for a DOM hash, 0.2 times the success rate."""
    s = F.when(U.host(F.col(domain)) == U.host(url), 0.5).otherwise(0.0) + F.when(F.col("dom_hash").isNotNull(), 0.3).otherwise(0.0) + 0.2 * F.coalesce("success_rate", F.lit(0.0))
    return examples.withColumn("score", s)


#: Parts that each side of a match is dealt into, so that a pattern or hash that very many share lies in many tasks.
SIDE = 8


def match_examples(wanted: DataFrame, examples: DataFrame, least: float = 0.3) -> DataFrame:
    """(wanted_id, example_id, score): 0.5 for the URL pattern and 0.5 for the DOM hash; two equi-joins, not one with OR.

    A pair that agrees in both is found by its hash, so pairs are neither shuffled nor
    added up; only where ids repeat, the scores of their rows are.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SIDE))
    others = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    tasks = 4 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = wanted.select("wanted_id", "pattern", "dom_hash", part("wanted_id").alias("i"), others.alias("j"))
    e = examples.select("example_id", "example_pattern", "example_hash", part("example_id").alias("j"), others.alias("i"))
    same_pattern, same_hash = F.col("pattern") == F.col("example_pattern"), F.col("dom_hash") == F.col("example_hash")

    def met(a: str, b: str) -> DataFrame:
        x, y = w.filter(F.col(a).isNotNull()).repartition(tasks, a, "i", "j"), e.filter(F.col(b).isNotNull()).repartition(tasks, b, "i", "j")
        return x.join(y.hint("shuffle_hash"), (x["i"] == y["i"]) & (x["j"] == y["j"]) & (F.col(a) == F.col(b)))

    by_hash = met("dom_hash", "example_hash").select("wanted_id", "example_id", F.when(same_pattern, 1.0).otherwise(0.5).alias("score"))
    by_pattern = met("pattern", "example_pattern").filter(~F.coalesce(same_hash, F.lit(False))).select("wanted_id", "example_id", F.lit(0.5).alias("score"))
    scored = by_hash.unionByName(by_pattern)
    if any(d.groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() for d, k in ((wanted, "wanted_id"), (examples, "example_id"))):
        scored = scored.groupBy("wanted_id", "example_id").agg(F.sum("score").alias("score"))
    return scored.filter(F.col("score") > least)


def struct_type(schema: dict) -> StructType:
    """A JSON Schema object as Spark's type; objects without properties are maps of text, unknown types text."""

    def kind(s: dict) -> DataType:
        t = s.get("type", "string")
        if t == "object":
            return struct_type(s) if s.get("properties") else MapType(StringType(), StringType())
        if t == "array":
            return ArrayType(kind(s.get("items", {})))
        return {"integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}.get(t, StringType())

    required = set(schema.get("required", []))
    return StructType([StructField(name, kind(s), name not in required) for name, s in schema.get("properties", {}).items()])


def examples(rows: DataFrame, most: int = 5) -> DataFrame:
    """(field, examples): the least distinct values of each field, ``most`` of them at most."""
    distinct = rows.filter("value IS NOT NULL").select("field", "value").distinct()
    w = Window.partitionBy("field").orderBy("value")
    first = distinct.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most)
    return first.groupBy("field").agg(F.sort_array(F.collect_list("value")).alias("examples"))


def value_types(rows: DataFrame) -> DataFrame:
    """Rows (field, value, kind) with the JSON type of every value."""
    return rows.withColumn("type", F.col("kind"))


def applied(value: Column, steps: list[str]) -> Column:
    """strip, lower, upper, remove_commas and date_parse in turn; a date that can't be read stays as it is."""
    known = {
        "strip": F.trim, "lower": F.lower, "upper": F.upper, "remove_commas": lambda v: F.replace(v, F.lit(","), F.lit("")),
        "date_parse": lambda v: F.coalesce(*(F.date_format(F.try_to_timestamp(v, F.lit(f)), "yyyy-MM-dd") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")), v),
    }
    for s in steps:
        value = known[s](value)
    return value


def schema_by(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, field, samples, type, required, confidence): the schema of each group's records; confidence as in ``confidence``."""
    filled = F.count_if(F.col("value") != "")
    g = rows.groupBy(group, "field").agg(F.count("*").alias("samples"), F.min(F.when(F.col("kind") != "null", F.col("kind"))).alias("type"), filled.alias("n"))
    share = g.withColumn("share", F.col("n") / F.col("samples"))
    mean = F.avg("share").over(Window.partitionBy(group))  # as many rows as a schema has fields
    return share.select(group, "field", "samples", F.coalesce("type", F.lit("null")).alias("type"), (F.col("n") == F.col("samples")).alias("required"), (F.least(F.lit(1.0), F.col("samples") / 10.0) * mean).alias("confidence"))
