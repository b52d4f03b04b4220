r"""URL filters: rules, and for what no rule fits, link-graph propagation (operator 11).

A rule allows or blocks the urls of a host and its subdomains whose path starts
with the rule's; of several that fit, the longest (host and path together, then
the longer host) wins.  Pages with a rule make their hosts seeds: trusted by the
number of their allowed pages, distrusted by the number of blocked ones.  Trust
flows along links from host to host, distrust against them, as two personalised
PageRanks on one scale.  A host is blocked if its distrust is more than
``threshold`` of its trust and distrust together; its pages without a rule take
its verdict.  Hosts that neither reaches are allowed.

* Rules are a table.  The hosts are counted first, so that rules meet distinct
  hosts, not pages; a host brings the rules that fit it back to its pages in one
  array, longest first.
* A host with a third of all pages or links is a skewed key of joins whose other
  side has one row a host and is written before, which adaptive execution splits;
  everything else that is grouped by host is summed in each task first.
* PageRank is the sum over walks from the seeds: a round moves the mass of one
  more step.  Only hosts that hold mass take part, what is left after ``k`` rounds
  is at most ``damping ** k``, and rounds end when it is under ``tolerance``.  Each
  round is written to the shared checkpoint folder.
* A link is the address in ``href`` of an ``a`` or ``area`` element outside of
  comments, scripts and styles that names a host (a ``>`` before ``href`` ends the
  element, even in quotes).  A page gives each other host one
  vote; links within a host, and so all relative ones, are none.

A null url, or one without ``://``, has an empty host and path: no rule fits it,
it takes no part in the graph, and it is allowed.  Null html has no links.  Rules
with a null host or action are left out, a null path is ``''``; of equal rules that
differ in their action the blocking one holds.  Repeated pages count as often as
they are there and give repeated rows.  Without rules all are allowed; no pages
give no rows.  Columns that are not named are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, table, written

#: (action, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Share of the seeds' mass that may be left on its way.
TOLERANCE = 0.001
#: A host is blocked beyond this share of distrust.
THRESHOLD = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<!--(?:.*?-->|.*)|<(script|style)\b(?:.*?</\1|.*)"
_LINK = r"""(?is)<a(?:rea)?\s(?:[^<>]*?[\s"'/])?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://``, A-Z of the host lower-cased; both empty for a null or a text without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits) of each distinct host that a rule's host fits: fits is an array of (size, own, action, path, rule), longest first."""
    rules = rules.filter("host IS NOT NULL AND action IS NOT NULL").select("action", F.translate("host", UPPER, LOWER).alias("at"), F.coalesce("path", F.lit("")).alias("path"))
    labels = rules.agg(F.max(F.size(F.split("at", r"\.")))).first()[0] or 0
    if not labels:
        return hosts.limit(0).withColumn("fits", F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("own"), F.lit("").alias("action"), F.lit("").alias("path"), F.lit("").alias("rule"))))
    rules = rules.groupBy("at", "path").agg(F.max("action").alias("action"))
    endings = F.array_distinct(F.array(*(F.substring_index("host", ".", -i) for i in range(1, labels + 1))))
    own = F.struct((F.length("at") + F.length("path")).alias("size"), F.length("at").alias("own"), "action", "path", F.concat("at", "path").alias("rule"))
    return hosts.select("host", F.explode(endings).alias("at")).join(rules, "at").groupBy("host").agg(F.sort_array(F.collect_list(own), asc=False).alias("fits"))


def judged_by_rules(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, action) of every page; rule and action are null where no rule fits."""
    host, path = url_parts(F.col(url))
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    fits = written(fitting(urls.filter("host <> ''").select("host").distinct(), rules))
    best = F.get(F.filter("fits", lambda x: F.startswith("path", x["path"])), F.lit(0))
    return urls.join(fits, "host", "left").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def host_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, votes): pages of host src that link to another host dst."""
    named = F.regexp_extract_all(F.regexp_replace(F.col(html), F.lit(_HIDDEN), F.lit(" ")), F.lit(_LINK), F.lit(1))
    pairs = pages.filter(F.col(html).isNotNull()).select(url_parts(F.col(url))[0].alias("src"), F.explode(F.array_distinct(F.transform(named, lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    return pairs.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("votes"))


def steps_of(links: DataFrame) -> DataFrame:
    """(kind, host, to, share): trust walks from src to dst, distrust from dst to src, each in proportion to the votes."""
    ways = (("trust", "src", "dst"), ("distrust", "dst", "src"))
    return reduce(DataFrame.unionByName, (links.join(written(links.groupBy(a).agg(F.sum("votes").alias("all_votes"))), a).select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), (F.col("votes") / F.col("all_votes")).alias("share")) for kind, a, b in ways))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that mass of ``seeds`` (host, trust, distrust) reaches, over ``links`` (src, dst, votes)."""
    links = written(links)
    steps = written(steps_of(links))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass")).filter("mass > 0").select("kind", "host", "mass")
    fronts = [written(start)]
    while True:
        mass = Observation()
        moved = fronts[-1].join(steps, ["kind", "host"]).groupBy("kind", "to").agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass")).select("kind", F.col("to").alias("host"), "mass")
        fronts.append(written(moved.observe(mass, F.sum("mass").alias("left"))))
        if (mass.get["left"] or 0.0) <= tolerance:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)) * (1 - damping)
    scores = written(reduce(DataFrame.unionByName, fronts).groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")))
    for x in (links, steps, *fronts):
        discard(x)
    return scores


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; the last two are its host's scores, as shares of all seed pages."""
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    ruled = written(judged_by_rules(pages, rules))
    counts = ruled.filter("host <> '' AND action IS NOT NULL").groupBy("host").agg(F.count_if(F.col("action") == "allow").cast("double").alias("trust"), F.count_if(F.col("action") == "block").cast("double").alias("distrust"))
    counts = written(counts)
    n = counts.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 1.0
    seeds = counts.select("host", (F.col("trust") / n).alias("trust"), (F.col("distrust") / n).alias("distrust"))
    scores = propagate(host_links(pages), seeds, damping=damping, tolerance=tolerance)
    discard(counts)
    trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust"))
    of_host = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", of_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql(rounds: int = 43) -> str:
    """The same by plain steps: rules tried page by page, ``rounds`` rounds of propagation."""
    fits = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)"
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    ranks = "".join(
        f""", t{i} AS MATERIALIZED (
  SELECT f.kind, e.t AS host, sum(f.mass * e.share) * {DAMPING} AS mass FROM t{i - 1} f JOIN steps e ON e.kind = f.kind AND e.f = f.host GROUP BY ALL)"""
        for i in range(1, rounds + 1)
    )
    walks = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(rounds + 1))
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rn, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS MATERIALIZED (
  SELECT rn, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(a, h, p) AS (VALUES {rules}
), ruled AS MATERIALIZED (
  SELECT rn, page_id, host, path, (SELECT r.h || r.p FROM rules r WHERE {fits} ORDER BY length(r.h || r.p) DESC LIMIT 1) AS rule,
    (SELECT r.a FROM rules r WHERE {fits} ORDER BY length(r.h || r.p) DESC LIMIT 1) AS action FROM parts
), links AS MATERIALIZED (
  SELECT host AS src, dst, count(*) AS votes FROM (
    SELECT DISTINCT rn, host, translate(unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--(?:.*?-->|.*)', ' ', 'g'), '(?is)<script\b(?:.*?</script|.*)', ' ', 'g'), '(?is)<style\b(?:.*?</style|.*)', ' ', 'g'),
      '(?is)<a(?:rea)?\s(?:[^<>]*?[\s"''/])?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)), '{UPPER}', '{LOWER}') AS dst
    FROM parts WHERE html IS NOT NULL) WHERE host <> '' AND host <> dst GROUP BY ALL
), steps AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS f, dst AS t, votes / sum(votes) OVER (PARTITION BY src) AS share FROM links
  UNION ALL SELECT 'distrust', dst, src, votes / sum(votes) OVER (PARTITION BY dst) FROM links
), t0 AS MATERIALIZED (
  SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER () AS mass FROM ruled WHERE action IS NOT NULL GROUP BY ALL
){ranks}, scores AS (
  SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM ({walks}) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN distrust > {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


SQL = _sql()
