"""Selector learning and repair on the node table: ranking, similarity, grouping.

Pairs of nodes are formed inside a page and by an equal key (tag, text hash) where
there is one; the best is an aggregate of structs, not a sort.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import html as H
from docloom.operators import trees as R

#: Groups of tags that may stand for each other.
COMPATIBLE = (("div", "section", "article", "main"), ("span", "em", "strong", "b", "i"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"))


def tags_compatible(a: Column, b: Column) -> Column:
    out = a == b
    for group in COMPATIBLE:
        out = out | (a.isin(*group) & b.isin(*group))
    return out


def similar_class(wanted: Column, classes: Column) -> Column:
    """Of an element's classes: the same, else one of the same prefix before -, else one that contains or is contained."""
    prefix = lambda c: F.split(c, "-")[0]
    pick = lambda test: F.get(F.filter(classes, test), F.lit(0))
    return F.coalesce(pick(lambda c: c == wanted), pick(lambda c: prefix(c) == prefix(wanted)), pick(lambda c: c.contains(wanted) | F.contains(wanted, c)))


def unique_selector(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selectors (rows of ``html.select``) that match exactly one element of their page."""
    return found.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("is_unique", F.col("n") == 1)


def classes(attrs: Column) -> Column:
    return F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda c: c != "")


def features(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """What similarity needs of each node."""
    return tree.select(key, "node_id", "tag", classes(F.col("attrs")).alias("classes"), F.col("attrs")["id"].alias("id"), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 100).alias("text"), F.array_sort(F.map_keys("attrs")).alias("names"), "depth", "nth")


def find_similar(tree: DataFrame, first: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, found): nodes of the same depth, tag and attribute names as the given nodes (key, node_id)."""
    names = F.array_sort(F.map_keys("attrs"))
    like = tree.join(first.select(key, "node_id"), [key, "node_id"]).select(key, "depth", "tag", names.alias("names"), F.col("node_id").alias("found"))
    return tree.withColumn("names", names).join(like, [key, "depth", "tag", "names"]).filter("node_id <> found").select(key, "node_id", "found")


def with_text(tree: DataFrame, text: Column, key: str = "page_id") -> DataFrame:
    """(key, node_id): the first node of each page whose own text is ``text``."""
    return tree.filter(F.trim("text") == text).groupBy(key).agg(F.min("node_id").alias("node_id"))


def describe_score(tree: DataFrame, description: str) -> DataFrame:
    """Nodes with a word of the description: 1 for text, 0.5 each for attributes, a semantic tag, being non-empty."""
    words = sorted({w for w in description.lower().split() if len(w) > 2})
    has = lambda x: F.lit(False) if not words else x.rlike("|".join(words))
    text, attrs = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.concat_ws(" ", F.map_values("attrs")))
    score = F.when(has(text), 1.0).otherwise(0.0) + F.when(has(attrs), 0.5).otherwise(0.0) + F.when(F.col("tag").isin(*H.SEMANTIC), 0.5).otherwise(0.0) + F.when(T.trim(text) != "", 0.5).otherwise(0.0)
    return tree.withColumn("score", score).filter(has(text) | has(attrs))


def typed_value(tag: Column, attrs: Column, text: Column, kind: str) -> Column:
    """The value of an element as link, image, number or text."""
    if kind == "url":
        return F.coalesce(attrs["href"], attrs["src"], T.trim(text))
    if kind == "image":
        return F.coalesce(attrs["src"], attrs["data-src"])
    if kind == "number":
        return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+\.?\d*)", 1), F.lit(""))
    return T.trim(text)


def selector_confidence(css: Column, unique: Column) -> Column:
    s = F.lit(0.5) + F.when(css.contains("#"), 0.3).otherwise(0.0) + F.when(css.contains("."), 0.1).otherwise(0.0) - F.when(css.contains("nth-"), 0.2).otherwise(0.0) + F.when(unique, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


#: Patterns of values whose type says enough.
TYPE_PATTERNS = {"url": r"^https?://[^\s]+$", "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "number": r"^-?\d+(\.\d+)?$"}


def validation_regex(rows: DataFrame, group: str, value: str, kind: str | None = None) -> DataFrame:
    """(group, regex): the pattern of the group's type (column ``kind``) if it has one, else common prefix and suffix of three values or more, the middle free."""
    fixed = F.create_map(*(F.lit(x) for kv in TYPE_PATTERNS.items() for x in kv))
    own = F.min(kind) if kind else F.lit(None).cast("string")
    g = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(own.alias("kind"), F.count_distinct(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(F.reverse(value)).alias("rlo"), F.max(F.reverse(value)).alias("rhi"))
    prefix, suffix = T.common_prefix(F.col("lo"), F.col("hi")), F.reverse(T.common_prefix(F.col("rlo"), F.col("rhi")))
    literal = lambda c: F.regexp_replace(c, r"([.+*?^${}()|\[\]\\-])", r"\\$1")
    return g.select(group, F.coalesce(F.try_element_at(fixed, F.col("kind")), F.when(F.col("n") >= 3, F.concat(F.lit("^"), literal(prefix), F.lit(".*"), literal(suffix), F.lit("$")))).alias("regex"))


def fuzzy_ratio(df: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Add the Ratcliff-Obershelp ratio of two text columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            i, j = x.schema.get_field_index(a), x.schema.get_field_index(b)
            made = [None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x.column(i).to_pylist(), x.column(j).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(made, pa.float64())], [*x.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` double")


def fuzzy_pairs(rows: DataFrame, key: str, text: str, least: float = 0.9) -> DataFrame:
    """(a, b, ratio): all pairs of different texts with a ratio of ``least`` or more, by their least keys, a < b.

    The ratio is at most twice the characters that both texts have, over their
    lengths.  So texts are sets of (character, its number so far), and of each the
    rarest ones, so many that a pair over the bound must share one, are joined;
    what meets is held against the bounds of length and of common characters, and
    only then compared.
    """
    reps = rows.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias("k")).select("k", F.col(text).alias("t"))
    letters = reps.select("k", F.posexplode(F.split("t", "")).alias("i", "c")).filter("c <> ''")
    nth = F.row_number().over(Window.partitionBy("k", "c").orderBy("i"))
    marks = letters.select("k", F.concat("c", nth.cast("string")).alias("m"))
    rare = marks.groupBy("m").agg(F.count("*").alias("df"))
    held = marks.join(rare, "m").groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "m"))), lambda x: x["m"]).alias("ms")).join(reps, "k")
    n = F.size("ms")
    prefix = F.slice("ms", F.lit(1), F.greatest(n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1, F.lit(1)))
    dealt = held.select("k", "t", "ms", F.explode(prefix).alias("m"))
    x, y = dealt.alias("x"), dealt.alias("y")
    total = F.size("x.ms") + F.size("y.ms")
    near = (F.col("x.m") == F.col("y.m")) & (F.col("x.k") < F.col("y.k")) & (2 * F.least(F.size("x.ms"), F.size("y.ms")) >= least * total)
    met = x.join(y, near).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.t").alias("ta"), F.col("y.t").alias("tb"), F.col("x.ms").alias("ma"), F.col("y.ms").alias("mb")).dropDuplicates(["a", "b"])
    close = met.filter(2 * F.size(F.array_intersect("ma", "mb")) >= least * (F.size("ma") + F.size("mb"))).drop("ma", "mb")
    return fuzzy_ratio(close, "ta", "tb").filter(F.col("ratio") >= least).select("a", "b", "ratio")


def fuzzy_unique(rows: DataFrame, key: str, text: str, order: Sequence[str], least: float = 0.9) -> DataFrame:
    """The rows of ``key`` groups whose text is over ``least`` like no earlier kept one, by the stated order.

    A group's texts are candidates for one field, some dozens, and are compared in one pass.
    """
    kind = rows.schema[key].dataType.simpleString()
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("xs")).select(key, F.transform("xs", lambda x: x["t"]).alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, kept = [], []
            for k, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: list[str] = []
                for t in (" ".join(t.split()) for t in ts):
                    if all(difflib.SequenceMatcher(None, t, o).ratio() <= least for o in own):
                        own.append(t)
                keys += [k] * len(own)
                kept += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(kept, pa.string())], [b.schema.names[0], text])

    return packed.mapInArrow(run, f"`{key}` {kind}, `{text}` string")


def tfidf(rows: DataFrame, key: str, text: str, features: int | None = None) -> DataFrame:
    """(key, token, weight): term frequency by inverse document frequency, each key's vector of length one.

    With ``features`` only so many tokens of the greatest counts, ties by name.
    """
    tf = rows.select(key, F.explode(T.tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if features:
        df = df.orderBy(F.desc("total"), "token").limit(features)
    n = F.broadcast(rows.agg(F.count_distinct(key).alias("n")))
    w = tf.join(df, "token").crossJoin(n).select(key, "token", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(vectors: DataFrame, key: str, over: float) -> DataFrame:
    """(a, b, similarity): pairs of keys with a cosine over ``over``, a < b.

    Vectors have length one and no negative weight.  The last weights of a vector,
    by rarity of their tokens, whose squares stay under ``over`` squared, cannot
    make a pair on their own, so only the other tokens are joined; pairs that meet
    are summed over all tokens in common.
    """
    df = vectors.groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy(key).orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)
    held = vectors.join(df, "token").withColumn("upto", F.sum(F.col("weight") * F.col("weight")).over(w))
    keys = held.filter(F.col("upto") >= over * over - 1e-9).select(key, "token")
    x, y = keys.alias("x"), keys.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col(f"x.{key}") < F.col(f"y.{key}"))).select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).distinct()
    v = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("v"))
    both = met.join(v.select(F.col(key).alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col(key).alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at(F.col("vb"), e["key"]), F.lit(0.0)))
    return both.select("a", "b", dot.alias("similarity")).filter(F.col("similarity") > over)


def nearest_example(queries: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """(query, example, similarity): the example with the greatest cosine for each query, over tokens in common."""
    q, e = queries.select(F.col(key).alias("query"), "token", F.col("weight").alias("qw")), examples.select(F.col(key).alias("example"), "token", F.col("weight").alias("ew"))
    dots = q.join(e, "token").filter("query <> example").groupBy("query", "example").agg(F.sum(F.col("qw") * F.col("ew")).alias("s"))
    return dots.groupBy("query").agg(F.max(F.struct("s", (-F.col("example")).alias("neg"))).alias("x")).select("query", (-F.col("x.neg")).alias("example"), F.col("x.s").alias("similarity"))



# selectors of a node table


def context_selectors(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, selector): of each node, by its parent and the parent's class, and by the sibling before it."""
    parent = tree.select(key, F.col("node_id").alias("parent_id"), F.col("tag").alias("ptag"), F.col("attrs")["class"].alias("pclass"))
    w = Window.partitionBy(key, "parent_id").orderBy("node_id")
    j = tree.withColumn("before", F.lag("tag").over(w)).join(parent, [key, "parent_id"])
    by_parent = F.concat("ptag", F.coalesce(F.concat(F.lit("."), "pclass"), F.lit("")), F.lit(" > "), "tag")
    made = F.array_compact(F.array(by_parent, F.when(F.col("before").isNotNull(), F.concat("before", F.lit(" + "), "tag"))))
    return j.select(key, "node_id", F.explode(made).alias("selector"))


def scored_selectors(pages: DataFrame, selectors: dict[str, str], key: str = "page_id") -> DataFrame:
    """(name, css, coverage, precision, stability, score): shares of pages with a match, of these with exactly one, and their product; selectors without a match are left out."""
    found = R.select(pages, selectors, key).groupBy("name", key).agg(F.count("*").alias("n"))
    total = pages.agg(F.count("*").alias("total"))
    css = F.create_map(*(F.lit(x) for kv in selectors.items() for x in kv))[F.col("name")]
    g = found.groupBy("name").agg(F.count("*").alias("pages"), F.count_if(F.col("n") == 1).alias("single")).crossJoin(F.broadcast(total))
    made = g.select("name", css.alias("css"), (F.col("pages") / F.col("total")).alias("coverage"), (F.col("single") / F.col("pages")).alias("precision"), H.stability(css).alias("stability"))
    return made.withColumn("score", F.col("coverage") * F.col("precision") * F.col("stability"))


def counted_candidates(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """(tag, selector, confidence, n): candidates of all pages with how often they were made."""
    c = H.candidates(tree, key).join(tree.select(key, "node_id", "tag"), [key, "node_id"])
    return c.groupBy("tag", "selector", "confidence").agg(F.count("*").alias("n"))


def fallbacks(counted: DataFrame, k: int) -> DataFrame:
    """(tag, fallbacks): each tag's ``k`` best candidates, joined by bars."""
    w = Window.partitionBy("tag").orderBy(F.desc("confidence"), F.desc("n"), "selector")
    best = counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return best.groupBy("tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "selector"))), lambda x: x["selector"]), " | ").alias("fallbacks"))


def reranked(candidates: DataFrame) -> DataFrame:
    """Scores of repairs (score, hit): a fifth more where they match, three tenths of it elsewhere."""
    return candidates.withColumn("score", F.when(F.col("hit"), F.col("score") * 1.2).otherwise(F.col("score") * 0.3))


def selectors_for(pages: DataFrame, description: str, k: int, key: str = "page_id") -> DataFrame:
    """(key, place, node_id, score, css): selectors of the ``k`` elements of a page that a description fits best."""
    scored = describe_score(H.nodes(pages, key), description)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "node_id")
    best = scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(key, "node_id", "place", "score")
    return best.join(R.selector_paths(pages, key=key), [key, "node_id"]).select(key, "place", "node_id", "score", "css")


def first_schema(pages: DataFrame, schemas: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Pages with the first schema (pattern, schema_id) that their URL pattern has; null without one."""
    first = schemas.groupBy(pattern).agg(F.min("schema_id").alias("schema_id"))
    return pages.join(first, pattern, "left")


def base_selectors(examples: DataFrame, group: str, selectors: str, order: str) -> DataFrame:
    """(group, selectors): those of a group's first example that has any."""
    return examples.groupBy(group).agg(F.min_by(selectors, F.when(F.col(selectors).isNotNull(), F.col(order))).alias("selectors"))


def example_id(url: Column, html: Column) -> Column:
    return F.md5(F.concat_ws("|", url, F.md5(html)))
