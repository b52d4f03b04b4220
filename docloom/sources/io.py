"""Sources and sinks: response records, headers, cookies, curl commands, HAR archives, JSON, checked upserts."""

from __future__ import annotations

import contextlib
import re
import shlex
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions.status import reason
from docloom.operators import html as H
from docloom.operators.state import shared_folder


def responses(pages: DataFrame, content_type: Column, status: Column) -> DataFrame:
    """Pages as response records: status, reason, headers, body and encoding."""
    return pages.select(
        "url", status.alias("status"), reason(status).alias("reason"), F.create_map(F.lit("content-type"), content_type).alias("headers"), F.col("html").alias("body"), charset(content_type).alias("encoding")
    )


def charset(content_type: Column, default: str = "utf-8") -> Column:
    found = F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", default).otherwise(found)


def header_map(lines: Column) -> Column:
    """``Name: value`` lines to a map of lower-case names; later lines win."""
    parts = F.filter(F.split(lines, "\r?\n"), lambda x: x.contains(":"))
    names = F.transform(parts, lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))))
    entries = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), (F.array_position(F.reverse(names), e["k"]) == F.size(names) - i).alias("last"))), lambda e: e["last"])
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def cookie_map(text: Column) -> Column:
    """``a=b; c=d`` to a map; later pairs win."""
    pairs = F.filter(F.split(text, r";\s*"), lambda x: x.contains("="))
    names = F.transform(pairs, lambda x: F.trim(F.regexp_extract(x, "^([^=]*)=", 1)))
    kept = F.filter(F.transform(pairs, lambda x, i: F.struct(names[i].alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v"), (F.array_position(F.reverse(names), names[i]) == F.size(names) - i).alias("last"))), lambda e: e["last"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


CURL = "method string, url string, headers map<string,string>, cookies map<string,string>, body string"


def parse_curl(command: str | None) -> dict | None:
    """A curl command as a request; null for anything else."""
    try:
        words = shlex.split((command or "").replace("\\\n", " "))
    except ValueError:
        return None
    if not words or words[0] != "curl":
        return None
    out: dict = {"method": None, "url": None, "headers": {}, "cookies": {}, "body": None}
    rest = iter(words[1:])
    for w in rest:
        if w in ("-X", "--request"):
            out["method"] = next(rest, None)
        elif w in ("-H", "--header"):
            name, _, value = next(rest, "").partition(":")
            if name.lower() == "cookie":
                out["cookies"] |= dict(x.strip().split("=", 1) for x in value.split(";") if "=" in x)
            else:
                out["headers"][name.strip()] = value.strip()
        elif w in ("-b", "--cookie"):
            out["cookies"] |= dict(x.strip().split("=", 1) for x in next(rest, "").split(";") if "=" in x)
        elif w in ("-d", "--data", "--data-raw", "--data-binary", "--data-ascii"):
            data = next(rest, "")
            out["body"] = data if out["body"] is None else f"{out['body']}&{data}"
        elif w in ("-A", "--user-agent"):
            out["headers"]["User-Agent"] = next(rest, "")
        elif w in ("-e", "--referer"):
            out["headers"]["Referer"] = next(rest, "")
        elif w in ("-u", "--user", "-o", "--output", "--proxy", "-x", "--connect-timeout", "-m", "--max-time"):
            next(rest, None)
        elif not w.startswith("-") and out["url"] is None:
            out["url"] = w
    out["method"] = out["method"] or ("POST" if out["body"] is not None else "GET")
    return out


def curl_requests(df: DataFrame, command: str) -> DataFrame:
    """Add the parsed request as a struct column."""
    kind = pa.struct([("method", pa.string()), ("url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("cookies", pa.map_(pa.string(), pa.string())), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(command)
            rows = [r and r | {"headers": list(r["headers"].items()), "cookies": list(r["cookies"].items())} for r in map(parse_curl, b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "request"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, request struct<{CURL.replace(' ', ':').replace(',:', ',')}>")


HAR = "log struct<entries array<struct<request struct<url string>, response struct<headers array<struct<name string, value string>>>>>>"


def har_cookies(archives: DataFrame, text: str, key: str) -> DataFrame:
    """(key, name, value, domain): first cookie of each name and domain set by the responses of a HAR archive."""
    entries = archives.select(key, F.posexplode(F.from_json(text, HAR).getField("log").getField("entries")).alias("i", "e"))
    heads = entries.select(key, "i", F.col("e.request.url").alias("url"), F.posexplode("e.response.headers").alias("j", "h")).filter("lower(h.name) = 'set-cookie'")
    pair, rest = F.split(F.col("h.value"), ";", 2)[0], F.col("h.value")
    domain = F.regexp_extract(rest, r"(?i);\s*domain=([^;]+)", 1)
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1)
    rows = heads.select(key, F.trim(F.regexp_extract(pair, "^([^=]*)=", 1)).alias("name"), F.regexp_extract(pair, "^[^=]*=(.*)$", 1).alias("value"), F.when(domain == "", host).otherwise(domain).alias("domain"), "i", "j")
    return rows.groupBy(key, "name", "domain").agg(F.min_by("value", F.struct("i", "j")).alias("value")).select(key, "name", "value", "domain")


def har_export(sessions: DataFrame, key: str, cookies: str) -> DataFrame:
    """(key, har): each session's cookies as one HAR document."""
    made = F.transform(cookies, lambda c: F.struct(F.struct(F.concat(F.lit("http://"), c["domain"]).alias("url")).alias("request"), F.struct(F.array(F.struct(F.lit("Set-Cookie").alias("name"), F.concat(c["name"], F.lit("="), c["value"], F.lit("; Domain="), c["domain"]).alias("value"))).alias("headers")).alias("response")))
    return sessions.select(key, F.to_json(F.struct(F.struct(F.lit("1.2").alias("version"), F.coalesce(made, F.array().cast("array<struct<request:struct<url:string>,response:struct<headers:array<struct<name:string,value:string>>>>>")).alias("entries")).alias("log"))).alias("har"))


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each row as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_arrays(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, array): the rows of a key as a JSON array in order; a key's rows are one document, so keys should be small."""
    return df.groupBy(key).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row")))), lambda x: x["row"])).alias("array"))


def content(pages: DataFrame, extension: str) -> DataFrame:
    """(url, content): pages as .md, .html or .txt want them."""
    forms = {".md": H.to_markdown, ".html": lambda c: c, ".txt": H.to_text}
    return pages.select("url", forms[extension](F.col("html")).alias("content"))


def write_content(pages: DataFrame, path: str, extension: str) -> None:
    content(pages, extension).select("content").write.text(path, lineSep="\n\n")


def save_knowledge(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_knowledge(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def snapshot(frontier: DataFrame, path: str) -> None:
    """A queue in its order, for ``restore``; Parquet's commit makes it all or nothing."""
    frontier.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/out-{uuid.uuid4()}"
