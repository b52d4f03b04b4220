r"""WARC derivatives (operator 3): responses to linked metadata and conversion records.

``responses`` makes response records of fetched pages.  ``derive`` makes, for each
response, a ``metadata`` record (application/warc-fields: what the source was, its
headers and digests) and a ``conversion`` record (text/plain).  Both name their
source in WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date, and
carry their own block digests.  ``write`` stores records as WARC files with Spark's
text writer: the line separator is the blank lines that end a record.  A file is
compressed as one member, so it is read from its beginning.  ``read`` and ``parse``
read files back.

Record ids are name-based UUIDs of what a record holds, so a lost task that runs
again makes the same records.  Null html is an empty payload, a null url an empty
target.  Header values are kept on one line.  Null ids stay null, repeated rows
give repeated records, an empty table none; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table
from docloom.llm.html_blocks import plain_text

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "docloom"
SCHEMA = (
    "page_id {}, record_type string, record_id string, target_uri string, date string, content_type string, "
    "refers_to string, refers_to_target_uri string, refers_to_date string, block_digest string, payload_digest string, content_length long, headers string, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def _line(value: object) -> str:
    return " ".join(str(value or "").split())


def record(page_id, kind: str, own_id: str, uri: str, date: str, content_type: str, block: str, source: dict | None = None, payload_digest: str | None = None) -> dict:
    raw = block.encode()
    row = {
        "page_id": page_id, "record_type": kind, "record_id": own_id, "target_uri": uri, "date": date, "content_type": content_type,
        "refers_to": source and source["record_id"], "refers_to_target_uri": source and source["target_uri"], "refers_to_date": source and source["date"],
        "block_digest": digest(raw), "payload_digest": payload_digest, "content_length": len(raw), "block": block,
    }
    named = (
        ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Refers-To-Target-URI", row["refers_to_target_uri"]), ("WARC-Refers-To-Date", row["refers_to_date"]), ("WARC-Block-Digest", row["block_digest"]),
        ("WARC-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", len(raw)),
    )
    row["headers"] = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in named if v not in (None, ""))
    return row


def response(page_id, url: str | None, html: str | None, date: str = DATE) -> dict:
    uri, payload = _line(url), html or ""
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload.encode())}{CRLF}{CRLF}"
    return record(page_id, "response", record_id("response", page_id, uri, date, digest(payload.encode())), uri, date, "application/http; msgtype=response", head + payload, payload_digest=digest(payload.encode()))


def split_response(block: str) -> tuple[list[str], str]:
    """Status and header lines of an HTTP message, and its payload."""
    head, _, payload = block.partition(CRLF * 2)
    return head.split(CRLF), payload


def derived(source: dict) -> list[dict]:
    """Metadata and conversion records of one response record."""
    head, payload = split_response(source["block"] or "")
    text = plain_text(payload)
    fields = [("software", SOFTWARE), ("source-content-type", source["content_type"]), ("source-content-length", source["content_length"]), ("source-block-digest", source["block_digest"]), ("source-payload-digest", source["payload_digest"] or ""), ("source-status", head[0])]
    fields += [(f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in head[1:]) if k.strip()]
    fields += [("text-length", len(text)), ("text-digest", digest(text.encode()))]
    meta = "".join(f"{k}: {_line(v)}{CRLF}" for k, v in fields)
    return [
        record(source["page_id"], kind, record_id(kind, source["record_id"], block), source["target_uri"], source["date"], content_type, block, source, own)
        for kind, content_type, block, own in (("metadata", "application/warc-fields", meta, None), ("conversion", "text/plain; charset=utf-8", text, digest(text.encode())))
    ]


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.schema([(n, id_type if n == "page_id" else pa.int64() if n == "content_length" else pa.string()) for n in names])


def responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([response(*x, date) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], _arrow(b.schema.field(0).type))

    return pages.mapInArrow(run, SCHEMA.format(pages.schema["page_id"].dataType.simpleString()))


def derive(sources: DataFrame) -> DataFrame:
    """Two records for each response record; records of other types have no derivatives."""
    small_batches(sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([d for r in b.to_pylist() for d in derived(r)], _arrow(b.schema.field(0).type))

    kind = sources.schema["page_id"].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return sources.filter("record_type = 'response'").select(*names).mapInArrow(run, SCHEMA.format(kind))


def write(records: DataFrame, path: str) -> None:
    """WARC files, compressed as a whole; records of one source stay in one file."""
    records.select(F.concat("headers", F.lit(CRLF), F.coalesce("block", F.lit("")))).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file, in time proportional to its size."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no end of headers after byte {at}")
        named = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
        start = end + 4
        stop = start + int(named["Content-Length"])
        out.append((named, data[start:stop]))
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {stop}")
        at = stop + 4
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, target_uri, refers_to, block) of the records of written files, a file to a task at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                records = parse(gzip.decompress(content.as_py()))
                columns = [pa.array([h.get(n) for h, _ in records], pa.string()) for n in names.values()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.decode() for _, x in records], pa.string())], [*names, "block"])

    return files.mapInArrow(run, ", ".join(f"{n} string" for n in (*names, "block")))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))
