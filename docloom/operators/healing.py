r"""Selectors healed by examples, and repairs from an older page, as columns over ``trees``.

An element's vector holds the structure below it (shares of tags, depths, shares of
attribute names, as ``html.structure`` has them) and hashed tags, attributes, classes
and words.  A broken selector is healed by the element nearest to the mean of a few
examples, among those that may hold the field; its stable path is the new selector.

Examples are a few pieces of HTML for a field; their mean is worked out once and is a
literal of the plan.  Pages are looked at where they are, nothing is shuffled but the
scores of repairs.  Null and empty pages have no elements: nothing is healed there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import html as H
from docloom.operators import repair as P
from docloom.operators import trees as R

#: Hashed places of tags, attributes, classes and words in an element's vector.
HASHED = 64
#: Examples whose vectors are averaged.
SHOWN = 3


def _unit(x: Column) -> Column:
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return R.let(x, lambda v: R.let(norm(v), lambda n: F.transform(v, lambda e: F.when(n > 0, e / n).otherwise(e))))


def vector(tree: Column, n: Column) -> Column:
    """Structure below the node and hashed words; of length one."""

    def made(inner: Column) -> Column:
        share = lambda k, of: k / F.greatest(of, F.lit(1)).cast("double")
        count = lambda test: F.size(F.filter(inner, test))
        tag = lambda t: share(count(lambda x: x["tag"] == t), F.size(inner))
        names = F.flatten(F.transform(inner, lambda x: F.map_keys(x["attrs"])))
        has = lambda part: share(F.size(F.filter(names, lambda a: a.contains(part))), F.size(names))
        depths = F.concat(F.array(F.lit(0)), F.transform(inner, lambda x: x["depth"] - n["depth"]))
        mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, d: s + d) / F.size(xs)
        spread = R.let(mean(depths), lambda m: F.array(m, F.sqrt(mean(F.transform(depths, lambda d: (d - m) * (d - m))))))
        return F.concat(F.array(*(tag(t) for t in H.VECTOR_TAGS)), spread, F.array(F.array_max(depths).cast("double")), F.array(*(has(a) for a in H.VECTOR_ATTRS)))

    word = lambda w, weight: F.struct(F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(HASHED)).alias("at"), F.lit(weight).alias("weight"))
    words = F.concat(
        F.array(word(F.concat(F.lit("<"), n["tag"], F.lit(">")), 3.0)),
        F.transform(F.map_keys(n["attrs"]), lambda a: word(F.concat(F.lit("@"), a), 2.0)),
        F.transform(R.classes(n), lambda c: word(F.concat(F.lit("."), c), 2.0)),
        F.transform(F.regexp_extract_all(F.lower(R.whole(tree, n)), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: word(w, 0.1)),
    )
    places = F.array(*(F.lit(i) for i in range(HASHED)))
    hashed = R.let(words, lambda ws: F.transform(places, lambda i: F.aggregate(F.filter(ws, lambda w: w["at"] == i), F.lit(0.0), lambda s, w: s + w["weight"])))
    inner = F.slice(tree, n["id"] + 2, n["last"] - n["id"])
    return _unit(F.concat(R.let(inner, made), _unit(hashed)))


class Field(NamedTuple):
    """A field's broken selector, pieces of HTML that showed it, and its data type (text, link, image, number)."""

    broken: str
    examples: Sequence[str] = ()
    kind: str = "text"


def _targets(pages: DataFrame, fields: Mapping[str, Field]) -> dict[str, tuple[list[str], list[float]]]:
    """Of each field with examples: the tags of their first elements, and the mean of the first vectors."""
    rows = [(f"{name}\x1f{i}", x) for name, f in fields.items() for i, x in enumerate(f.examples[:5])]
    if not rows:
        return {}
    tree = F.col("tree")
    shown = R.trees(pages.sparkSession.createDataFrame(rows, "k string, html string"), "k", "html").filter(F.size("tree") > 0)
    found: dict[str, list[tuple[int, str, list[float]]]] = {}
    for r in shown.select("key", F.get(tree, F.lit(0))["tag"].alias("tag"), vector(tree, F.get(tree, F.lit(0))).alias("v")).collect():
        name, i = r.key.split("\x1f")
        found.setdefault(name, []).append((int(i), r.tag, r.v))
    out = {}
    for name, own in found.items():
        own.sort()
        first = [v for _, _, v in own[:SHOWN]]
        out[name] = ([t for _, t, _ in own], [sum(x) / len(first) for x in zip(*first, strict=True)])
    return out


def heal(pages: DataFrame, fields: Mapping[str, Field], key: str = "page_id", html: str = "html", least: float = 0.3) -> DataFrame:
    """(key, name, css, similarity, confidence) of every field on every page.

    A selector that matches stays, with 1; else ``css`` is that of the element
    nearest to the field's examples, null below ``least`` or without examples.
    """
    tree = F.col("tree")
    targets = _targets(pages, fields)
    row = lambda css, like, sure: F.struct(css.cast("string").alias("css"), like.cast("double").alias("similarity"), sure.cast("double").alias("confidence"))
    none = row(F.lit(None), F.lit(0.0), F.lit(0.0))

    def nearest(tags: list[str], mean: list[float], kind: str) -> Column:
        target = _unit(F.array(*(F.lit(float(x)) for x in mean)))
        dot = lambda t, v: F.aggregate(F.zip_with(t, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = R.let(target, lambda t: F.transform(R.fields_like(tree, tags, kind), lambda n: F.struct(dot(t, vector(tree, n)).alias("like"), (-n["id"]).alias("order"))))
        return F.array_max(scored)

    def sure(css: Column, like: Column) -> Column:
        one = F.size(R.chain(tree, css)) == 1
        own = F.lit(0.5) + F.when(css.contains("#"), 0.3).otherwise(0.0) + F.when(css.contains("."), 0.1).otherwise(0.0) - F.when(css.contains("nth-"), 0.2).otherwise(0.0) + F.when(one, 0.2).otherwise(0.0)
        return (like + F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))) / 2

    def healed(f: Field, name: str) -> Column:
        if name not in targets:
            return none
        tags, mean = targets[name]

        def found(best: Column) -> Column:
            css = R.stable_css(tree, F.get(tree, -best["order"]))
            return F.when(best.isNull(), none).when(best["like"] < least, row(F.lit(None), F.greatest(best["like"], F.lit(0.0)), F.greatest(best["like"], F.lit(0.0)))).otherwise(R.let(css, lambda c: row(c, best["like"], sure(c, best["like"]))))

        return R.let(nearest(tags, mean, f.kind), found)

    rows = []
    for name, f in fields.items():
        kept = row(F.lit(f.broken), F.lit(1.0), F.lit(1.0))
        rows.append(F.struct(F.lit(name).alias("name"), F.when(F.size(R.matches(tree, f.broken)) > 0, kept).otherwise(healed(f, name)).alias("x")))
    return R.trees(pages, key, html).select(F.col("key").alias(key), F.explode(F.array(*rows)).alias("r")).select(key, "r.name", "r.x.*")


def repairs(pairs: DataFrame, broken: Sequence[str], *, key: str = "page_id", old: str = "old", new: str = "new", originals: int = 3, similar: int = 5, least: float = 0.6, keep: int = 2) -> DataFrame:
    """(key, broken, place, css, score): the best repairs of selectors that worked on the old page, on the new one.

    From the first matches on the old page, paths of their most similar elements
    on the new one at 0.8 of the likeness, and what is left of the broken selector
    when loosened, if it matches; each gains a fifth for matching.
    """
    was, tree = F.col("was"), F.col("tree")
    first = R.trees(pairs.select(F.struct(F.col(key).alias("key"), F.col(new).alias("new")).alias("k"), F.col(old).alias("old")), "k", "old").select("key.key", F.col("key.new").alias("new"), F.col("tree").alias("was"))
    looked = F.array(*(F.struct(F.lit(b).alias("broken"), F.transform(F.slice(R.matches(was, b), 1, originals), lambda n: P.features(was, n)).alias("old")) for b in broken))
    now = R.trees(first.select(F.struct("key", looked.alias("looked")).alias("k"), "new"), "k", "new").select("key.key", "tree", F.explode("key.looked").alias("x")).select("key", "tree", "x.*")
    features = F.transform(tree, lambda n: R.let(P.features(tree, n), P.split_words))

    def of_old(fs: Column) -> Column:
        def best(a: Column) -> Column:
            scored = F.transform(fs, lambda f, i: F.struct((-P.likeness(a["f"], f["f"], a["words"], f["words"])).alias("minus"), i.alias("id")))
            return F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"] <= -least)), 1, similar)

        return F.flatten(F.transform(F.transform("old", P.split_words), lambda a: best(a)))

    near = now.select("key", "broken", "tree", F.explode(R.let(features, of_old)).alias("s")).select("key", "broken", R.stable_css(tree, F.get(tree, F.col("s.id"))).alias("css"), (-0.8 * F.col("s.minus")).alias("like"), F.lit(None).cast("double").alias("loose"))
    loose = now.select("key", "broken", "tree", F.explode(H.loosened(F.col("broken"))).alias("l")).filter(F.size(R.chain(tree, F.col("l.css"))) > 0).select("key", "broken", F.col("l.css").alias("css"), F.lit(None).cast("double").alias("like"), F.col("l.confidence").alias("loose"))
    scored = near.unionByName(loose).groupBy("key", "broken", "css").agg((F.coalesce(F.max("like"), F.max("loose")) * 1.2).alias("score"))
    w = Window.partitionBy("key", "broken").orderBy(F.desc("score"), "css")
    return scored.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < keep).select(F.col("key").alias(key), "broken", "place", "css", "score")
