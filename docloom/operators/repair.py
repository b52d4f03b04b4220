r"""Extraction that repairs its misses: likeness of elements, stored signatures, healing.

Elements are nodes of ``trees``.  A signature is what is known of the element that
filled a field when its selectors last worked: tag, hash of its whole text, stable
attributes, and what likeness compares.  Signatures are a table of one row for each
(page, field), kept between crawls.

``extract_healing`` first tries the selectors of each field on every page.  Only what
they miss goes on: an anti join leaves the missing (page, field) pairs, which meet
their signatures by an equal key, and only pages among them are parsed again.  A miss
looks for the element of the same tag and text with half of the signature's
attributes, then for the most similar element; the path of the element found is its
new selector.

A page without the field's signature, or without an element that is like it, has no
row for that field.  Null and empty pages have none.  Pages with the same key are one
another's repeats, and each is looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import trees as R

#: Least likeness of a repair, least share of equal attributes of a signature, old elements looked at.
LIKENESS, ATTRIBUTES, FIRST = 0.7, 0.5, 5


def features(tree: Column, n: Column) -> Column:
    """What likeness compares: tag, classes, id, other attributes, text, and the place among the parent's children (none for a root)."""
    parent = F.get(tree, n["parent"])
    root = n["parent"] < 0
    other = F.transform(F.filter(F.map_entries(n["attrs"]), lambda e: ~e["key"].isin("class", "id")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    text = F.substring(F.trim(F.regexp_replace(R.whole(tree, n), r"\s+", " ")), 1, 100)
    return F.struct(
        n["tag"].alias("tag"), F.array_distinct(R.classes(n)).alias("classes"), R.attr(n, "id").alias("id"), other.alias("attributes"), text.alias("text"),
        F.when(~root, parent["tag"]).alias("parent_tag"), F.when(root, 0).otherwise(n["all"]).alias("siblings"), F.when(root, 0).otherwise(n["index"] - 1).alias("position"),
    )


def split_words(f: Column) -> Column:
    """Features with the words of the text, split once for all that they are held against."""
    return F.struct(f.alias("f"), _words(f["text"]).alias("words"))


def _jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) | (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def likeness(a: Column, b: Column, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """Mean of the parts that can be told: tag; classes and attributes if either has any; ids and texts if both have; place if parents' tags and numbers of children are equal."""
    have = lambda x: F.coalesce(x, F.lit("")) != ""
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    within = F.contains(a["text"], b["text"]) | F.contains(b["text"], a["text"])
    most = F.greatest(a["position"], b["position"])
    parts = F.array(
        one(a["tag"] == b["tag"]),
        _jaccard(a["classes"], b["classes"]),
        F.when(have(a["id"]) & have(b["id"]), one(a["id"] == b["id"])),
        F.when(have(a["text"]) & have(b["text"]), F.when(within, 1.0).otherwise(_jaccard(_words(a["text"]) if a_words is None else a_words, _words(b["text"]) if b_words is None else b_words))),
        _jaccard(a["attributes"], b["attributes"]),
        F.when(a["parent_tag"].eqNullSafe(b["parent_tag"]) & (a["siblings"] == b["siblings"]) & (most > 0), 1.0 - F.abs(a["position"] - b["position"]) / most),
    )
    return R.let(F.array_compact(parts), lambda p: F.aggregate(p, F.lit(0.0), lambda t, x: t + x) / F.size(p))


def most_like(tree: Column, wanted: Column) -> Column:
    """(likeness, id) of the element that is most like one of ``wanted`` (an array of features); of equal ones the first in page order."""
    return F.get(most_like_each(tree, F.array(F.struct(wanted.alias("old")))), F.lit(0))["best"]


def most_like_each(tree: Column, wanted: Column) -> Column:
    """``wanted`` (structs with ``old``, an array of features), each with ``best``: the (likeness, order, id) of the element that is most like one of them; of equal ones the first in page order.

    The features of the page's elements are worked out once for all that is wanted.
    """

    def best(w: Column, elements: Column) -> Column:
        scored = lambda olds: F.array_max(F.transform(elements, lambda e: F.struct(F.array_max(F.transform(olds, lambda o: likeness(e["f"]["f"], o["f"], e["f"]["words"], o["words"]))).alias("likeness"), (-e["id"]).alias("order"), e["id"].alias("id"))))
        return R.let(F.transform(w["old"], split_words), scored)

    known = F.transform(tree, lambda n: F.struct(n["id"].alias("id"), R.let(features(tree, n), split_words).alias("f")))
    return R.let(known, lambda elements: F.transform(wanted, lambda w: F.struct(w.alias("w"), best(w, elements).alias("best"))))


def repaired(pairs: DataFrame, selectors: Mapping[str, str], *, old: str = "old", new: str = "new", key: str = "page_id", least: float = LIKENESS) -> DataFrame:
    """(key, name, node_id, similarity, css): for each selector, the element of the new page that is most like one of its first matches on the old one."""
    first = R.trees(pairs.select(F.struct(F.col(key).alias("key"), F.col(new).alias("new")).alias("k"), F.col(old).alias("old")), "k", "old")
    was = first.select("key.key", F.col("key.new").alias("new"), F.col("tree").alias("was"))
    found = {name: F.transform(F.slice(R.matches(F.col("was"), css), 1, FIRST), lambda n: features(F.col("was"), n)) for name, css in selectors.items()}
    wanted = was.select(F.struct("key", F.array(*(F.struct(F.lit(k).alias("name"), v.alias("old")) for k, v in found.items())).alias("wanted")).alias("k"), "new")
    tree = F.col("tree")
    some = F.filter("key.wanted", lambda w: F.size(w["old"]) > 0)
    now = R.trees(wanted, "k", "new").select("key.key", "tree", some.alias("wanted")).select("key", "tree", F.explode(most_like_each(tree, F.col("wanted"))).alias("x"))
    best = now.select("key", "tree", F.col("x.w.name").alias("name"), "x.best").filter(F.col("best.likeness") >= least)
    return best.select(F.col("key").alias(key), "name", F.col("best.id").alias("node_id"), F.col("best.likeness").alias("similarity"), R.stable_css(tree, F.get(tree, F.col("best.id"))).alias("css"))


# signatures


def stable_attributes(n: Column) -> Column:
    return F.map_filter(n["attrs"], lambda _, v: ~T.is_dynamic(v))


def signature(tree: Column, n: Column) -> Column:
    return F.struct(n["tag"].alias("tag"), T.text_hash(R.whole(tree, n)).alias("text_hash"), stable_attributes(n).alias("attributes"), features(tree, n).alias("features"))


def signatures(pages: DataFrame, schema: Mapping[str, Sequence[str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, name, signature) of the element that each field's selectors find first on each page."""
    tree = F.col("tree")
    first = {name: F.coalesce(*(F.get(R.matches(tree, css), F.lit(0)) for css in selectors)) for name, selectors in schema.items()}
    rows = F.array(*(F.struct(F.lit(name).alias("name"), n.alias("n")) for name, n in first.items()))
    found = R.trees(pages, key, html).select("key", "tree", F.explode(rows).alias("x")).filter("x.n IS NOT NULL")
    return found.select(F.col("key").alias(key), "x.name", signature(tree, F.col("x.n")).alias("signature"))


def by_signature(tree: Column, sig: Column, least: float = ATTRIBUTES) -> Column:
    """(share, order, id) of the element with the signature's tag and text and most of its attributes; null without one that has ``least`` of them."""
    n_attributes = F.size(sig["attributes"])

    def share(n: Column) -> Column:
        return F.size(F.map_filter(sig["attributes"], lambda k, v: F.coalesce(F.try_element_at(n["attrs"], k) == v, F.lit(False)))) / n_attributes

    same = F.filter(tree, lambda n: (n["tag"] == sig["tag"]) & (n_attributes > 0) & (T.text_hash(R.whole(tree, n)) == sig["text_hash"]))
    scored = F.transform(same, lambda n: F.struct(share(n).alias("share"), (-n["id"]).alias("order"), n["id"].alias("id")))
    return F.array_max(F.filter(scored, lambda x: x["share"] >= least))


def extract_healing(pages: DataFrame, schema: Mapping[str, Sequence[str]], stored: DataFrame, key: str = "page_id", html: str = "html", least: float = LIKENESS) -> DataFrame:
    """(key, name, value, used, selector, similarity): each field by its selectors, backups in order (``selector``), else by its stored signature, else by likeness."""
    flat = {f"{name}\x1f{i}": css for name, selectors in schema.items() for i, css in enumerate(selectors)}
    parts = F.split("name", "\x1f")
    hits = R.select(pages, flat, key, html).filter("value IS NOT NULL AND value <> ''").withColumns({"place": parts[1].cast("int"), "name": parts[0]})
    best = hits.groupBy(key, "name").agg(F.min(F.struct("place", "pos", "value")).alias("x"))
    chosen = F.create_map(*(F.lit(x) for name, selectors in schema.items() for x in (name, list(selectors))))
    found = best.select(key, "name", F.col("x.value").alias("value"), F.lit("selector").alias("used"), F.get(chosen[F.col("name")], F.col("x.place")).alias("selector"), F.lit(1.0).alias("similarity"))

    names = F.explode(F.array(*map(F.lit, schema))).alias("name")
    misses = pages.select(key).distinct().select(key, names).join(found.select(key, "name"), [key, "name"], "left_anti")
    known = misses.join(stored.select(key, "name", "signature"), [key, "name"]).groupBy(key).agg(F.collect_list(F.struct("name", "signature")).alias("missing"))
    again = pages.select(key, F.col(html).alias("html")).join(known, key).select(F.struct(F.col(key).alias("key"), "missing").alias("k"), "html")
    tree = F.col("tree")
    one = R.trees(again, "k", "html").select("key.key", "tree", F.explode("key.missing").alias("m")).select("key", "tree", "m.name", F.col("m.signature").alias("sig"))
    # generated, so that the filter on them does not have them worked out once more
    signed = one.select("*", F.explode(F.array(by_signature(tree, F.col("sig")))).alias("signed"))
    like = signed.select("*", F.explode(F.array(F.when(F.col("signed").isNull(), most_like(tree, F.array("sig.features"))))).alias("like"))
    at = F.get(tree, F.coalesce("signed.id", "like.id"))
    healed = like.filter(F.col("signed").isNotNull() | (F.col("like.likeness") >= least)).select(
        F.col("key").alias(key), "name", R.value(tree, at, None).alias("value"), F.when(F.col("signed").isNotNull(), "signature").otherwise("likeness").alias("used"), R.stable_css(tree, at).alias("selector"), F.coalesce("signed.share", "like.likeness").alias("similarity")
    )
    return found.unionByName(healed)
