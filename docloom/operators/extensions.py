"""Extension points: item hooks, parsers with two outputs, scorers, validators, learned intervals, error backoff."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from docloom.operators import records as R
from docloom.operators import scan

#: Registries: name to function; a scorer or validator makes a column, an enricher a DataFrame.
SCORERS: dict[str, Callable[[DataFrame], Column]] = {}
VALIDATORS: dict[str, Callable[[], list]] = {}
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(registry: dict, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        registry[name] = f
        return f

    return add


def scored(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.withColumns({n: SCORERS[n](df) for n in (names or sorted(SCORERS))})


def item_hook(df: DataFrame, hook: Callable[[dict], dict | None]) -> DataFrame:
    """Map or drop each row by a Python function, in Arrow batches; the schema stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [x for x in map(hook, b.to_dict("records")) if x is not None]
            yield pd.DataFrame(kept, columns=b.columns)

    return df.mapInPandas(run, df.schema)


def parser(parse: Callable[[str | None, str], Iterator[tuple[str, str, str]]]) -> UserDefinedTableFunction:
    """A table function (url, html) -> (kind, key, value) of a function that yields ("item" or "request", key, value) for a page.

    Register it with ``spark.udtf.register`` to use it in SQL.  Null html is an empty page.
    """

    class Parser:
        def eval(self, url: str | None, html: str | None) -> Iterator[tuple[str, str, str]]:
            yield from parse(url, html or "")

    return F.udtf(Parser, returnType="kind string, key string, value string")


def parse_pages(pages: DataFrame, parse: Callable[[str | None, str], Iterator[tuple[str, str, str]]], url: str = "url", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (url, kind, key, value) that ``parse`` yields for each page, after the columns ``keep`` of the page."""
    given = pages.select(*keep, F.col(url).alias("url"), F.col(html).alias("html"))
    return given.lateralJoin(parser(parse)(F.col("url").outer(), F.col("html").outer())).select(*keep, "url", "kind", "key", "value")


def error_backoff(rows: DataFrame, key: str, order: list[str], status: str = "status_code", retry_after: str | None = None, *, size: int = scan.CHUNK) -> DataFrame:
    """State after ordered responses: 429 and 503 back off (by Retry-After if given), three errors of 500 on throttle for a minute.

    A stretch of rows leaves the backoff as it is, sets it to a number of seconds, or
    sets it by a count of errors that goes on from the rows before; a null status changes nothing.
    """
    wait = lambda n: F.least(F.lit(300.0), F.pow(F.lit(2.0), n))
    backoff = lambda kind, v: F.struct(kind.alias("kind"), v.cast("double").alias("v"))
    keep, fixed, counted = F.lit("keep"), F.lit("fixed"), F.lit("counted")

    def one(x: Column) -> Column:
        limited, fine = x["code"].isin(429, 503), x["code"] < 400
        kind = F.when(fine | (limited & x["after"].isNotNull()), fixed).when(limited, counted).otherwise(keep)
        return F.struct(scan.run_of(limited | (x["code"] >= 500), fine).alias("errors"), backoff(kind, F.when(fine, 0.0).when(limited, F.coalesce(x["after"], F.lit(1.0))).otherwise(0.0)).alias("backoff"))

    def then(p: Column, q: Column) -> Column:
        b = q["backoff"]
        total = F.when(b["kind"] == "counted", p["errors"]["n"] + b["v"])
        kind = F.when(b["kind"] == "keep", p["backoff"]["kind"]).when((b["kind"] == "counted") & ~p["errors"]["reset"], counted).otherwise(fixed)
        v = F.when(b["kind"] == "keep", p["backoff"]["v"]).when(b["kind"] == "fixed", b["v"]).when(p["errors"]["reset"], wait(total)).otherwise(total)
        return F.struct(scan.run_then(p["errors"], q["errors"]).alias("errors"), backoff(kind, v).alias("backoff"))

    nothing = F.struct(scan.run_of(F.lit(False), F.lit(False)).alias("errors"), backoff(keep, F.lit(0.0)).alias("backoff"))
    after = (F.col(retry_after) if retry_after else F.lit(None)).cast("double")
    cut = scan.chunks(rows.filter(F.col(status).isNotNull()), key, order, {"code": F.col(status), "after": after}, size=size)
    m = F.col("m")
    errors, b = scan.run_applied(m["errors"], F.lit(0)).cast("int"), m["backoff"]
    seconds = F.when(b["kind"] == "counted", wait(b["v"])).otherwise(b["v"])
    last = scan.composed(cut, scan.Fold(nothing, one, then, lambda m, s: s)).select(F.col("key").alias(key), errors.alias("errors"), seconds.alias("backoff"))
    return last.withColumn("throttled", F.when(F.col("errors") >= 3, 60.0).otherwise(0.0))


def learned_interval(rows: DataFrame, key: str, order: list[str], features: list[str], target: str, rate: float = 0.01, blend: float = 0.3) -> DataFrame:
    """(key, interval): an online linear model of the target over a key's rows in order, blended with the mean."""
    kind = rows.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.c_[np.ones(len(pdf)), pdf[features].to_numpy(float)]
        x /= np.maximum(1.0, np.abs(x).max(axis=0))
        y, w = pdf[target].to_numpy(float), np.zeros(x.shape[1])
        for row, t in zip(x, y, strict=True):
            w += rate * (t - row @ w) * row
        return pd.DataFrame({key: [pdf[key].iloc[0]], "interval": [float(blend * (x[-1] @ w) + (1 - blend) * y.mean())]})

    return rows.select(key, *order, *features, target).groupBy(key).applyInPandas(fit, f"{key} {kind}, interval double")


def validated(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add the issues of all registered validators' rules, and whether the row is valid."""
    return R.validate(df, [rule for n in (names or sorted(VALIDATORS)) for rule in VALIDATORS[n]()])


def enriched(df: DataFrame, enrichers: dict[str, Callable[[dict], dict]]) -> DataFrame:
    """Add ``enriched``, a map of what Python functions of a row return, in turn, and ``failed``, the names of those that raised on it.

    A function sees what those before it added; one that fails adds nothing and stops no other.
    """
    kinds = StructType([*df.schema.fields, StructField("enriched", MapType(StringType(), StringType())), StructField("failed", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, failed = [], []
            for row in b.to_pylist():
                new: dict = {}
                bad = []
                for name, f in enrichers.items():
                    try:
                        new |= f(row | new)
                    except Exception:  # whatever a user's function raises
                        bad.append(name)
                made.append(list(new.items()))
                failed.append(bad)
            columns = [*b.columns, pa.array(made, pa.map_(pa.string(), pa.string())), pa.array(failed, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "enriched", "failed"])

    return df.mapInArrow(run, kinds)
