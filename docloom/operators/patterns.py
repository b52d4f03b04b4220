r"""Elements of a page that repeat, and the selectors that name them as a whole.

Elements join the first group whose first element has their tag and over half of
their classes, or, where one of them has no class, over 0.7 of their attribute names.
A group's common parent is read off the numbers of ``trees``: it is the deepest
ancestor of the group's first element whose last element is not before the group's last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import trees as R

#: Overlap of classes and of attribute names that makes two elements alike.
CLASSES, NAMES = 0.5, 0.7


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def _group(tag: Column, classes: Column, names: Column, first: Column, last: Column, n: Column) -> Column:
    return F.struct(tag.alias("tag"), classes.alias("classes"), names.alias("names"), first.alias("first"), last.alias("last"), n.alias("n"))


def groups(tree: Column) -> Column:
    """Groups of two elements or more, by their first element: (tag, classes, names, first, last, n)."""
    of = lambda n: _group(n["tag"], F.array_distinct(R.classes(n)), F.map_keys(n["attrs"]), n["id"], n["id"], F.lit(1))

    def alike(g: Column, x: Column) -> Column:
        with_classes = (F.size(g["classes"]) > 0) & (F.size(x["classes"]) > 0)
        with_names = (F.size(g["names"]) > 0) & (F.size(x["names"]) > 0)
        return (g["tag"] == x["tag"]) & F.when(with_classes, _overlap(g["classes"], x["classes"]) > CLASSES).when(with_names, _overlap(g["names"], x["names"]) > NAMES).otherwise(True)

    def step(done: Column, n: Column) -> Column:
        def placed(x: Column) -> Column:
            hit = F.get(F.filter(F.transform(done, lambda g, i: F.when(alike(g, x), i)), lambda i: i.isNotNull()), F.lit(0))

            def put(at: Column) -> Column:
                grown = F.transform(done, lambda g, i: F.when(i == at, _group(g["tag"], g["classes"], g["names"], g["first"], x["last"], g["n"] + 1)).otherwise(g))
                return F.when(at.isNull(), F.concat(done, F.array(x))).otherwise(grown)

            return R.let(hit, put)

        return R.let(of(n), placed)

    start = F.transform(F.slice(tree, 1, 0), of)
    return F.filter(F.aggregate(tree, start, step), lambda g: g["n"] > 1)


def common_parent(tree: Column, g: Column) -> Column:
    """The deepest element above all of a group; null for groups of roots."""
    around = F.filter(R.ancestors(tree, F.get(tree, g["first"])), lambda a: F.get(tree, a)["last"] >= g["last"])
    return F.get(tree, F.array_max(around))


def grouped(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, first_id, tag, n, last_id) of every group."""
    found = R.trees(pages, key, html).select(F.col("key").alias(key), F.explode(groups(F.col("tree"))).alias("g"))
    return found.select(key, F.col("g.first").alias("first_id"), "g.tag", "g.n", F.col("g.last").alias("last_id"))


def patterns(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, selector, parent_id, n, coverage): a selector for each group whose common parent has a class, and the group's share of the page's elements of its tag."""
    tree = F.col("tree")
    found = R.trees(pages, key, html).select("key", "tree", F.explode(groups(tree)).alias("g"))
    held = found.withColumn("p", common_parent(tree, F.col("g"))).withColumn("c", F.get(R.classes(F.col("p")), F.lit(0))).filter("c IS NOT NULL")
    selector = F.concat(F.lit("."), "c", F.lit(" > "), "g.tag", F.lit(":nth-child(n)"))
    of_tag = F.size(F.filter(tree, lambda n: n["tag"] == F.col("g.tag")))
    return held.select(F.col("key").alias(key), selector.alias("selector"), F.col("p.id").alias("parent_id"), F.col("g.n").alias("n"), (F.col("g.n") / of_tag).alias("coverage"))
