"""Queries of selector generation, scoring and adaptation, with SQL where regular expressions can find the same elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import html as H
from docloom.operators import inference as I
from docloom.operators import learning as L
from docloom.operators import trees as R


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _nodes(spark, sf_dir):
    return H.nodes(_pages(spark, sf_dir))


def sel5_chain(spark, sf_dir):
    """CSS, then backups: the first of a chain that matches."""
    h = R.heal(_pages(spark, sf_dir), {"title": [".headline", "h1[itemprop=name]", "article h1", "title"]})
    return h.groupBy("used").agg(F.count("*").alias("n"))


def ext6_confidence(spark, sf_dir):
    e = R.extract(_pages(spark, sf_dir), {"title": "h1", "ad": "div.ad", "video": "video", "link": "nav a"})
    return e.groupBy(F.round(H.fill_rate(F.col("fields"), 4), 6).alias("confidence")).agg(F.count("*").alias("n"))


SQL: dict[str, str | None] = {
    "sel5_chain": "SELECT 2 AS used, count(*) AS n FROM pages WHERE trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) <> ''",
    "ext6_confidence": "SELECT round((CASE WHEN trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) <> '' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(html, '<div class=\"ad\">[^<]*[^<\\s]') THEN 1 ELSE 0 END + 1) / 4, 6) AS confidence, count(*) AS n FROM pages GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
