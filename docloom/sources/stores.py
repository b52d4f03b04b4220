r"""Storage behind one interface, on a data source of SQLite shards.

``SqliteShards`` is a Spark data source (format ``docloom_sqlite``).  A table is a folder
of SQLite files and a manifest that names those that count.  A write has two phases: each
task fills a file of its own, and the driver puts the files of a job that ended well
into the manifest by one atomic rename; those of a failed job or attempt are never
named.  A read makes ``splits`` partitions of each file, by ranges of its row numbers,
which the tasks work out themselves.  A single SQLite file can be read as well.

``Storage`` is what a user extends: ``save`` adds rows, ``load`` gives all of them, and
``retrieve`` the newest row of each wanted key.  ``CheckedStorage`` puts a checksum on
every row: what isn't a key is packed as JSON, compressed and hashed, and rows that no
longer match are told apart when they are loaded.

SQLite needs a file system path that all executors see, such as a folder under
``spark.checkpoint.dir``.  Columns are numbers, strings, booleans, binaries, dates and
timestamps; nulls are kept.  An empty table has a manifest and no rows.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import sqlite3
import uuid
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DateType, StringType, StructField, StructType, TimestampType

FORMAT = "docloom_sqlite"
MANIFEST = "_manifest.json"
#: Rows that a task hands to SQLite at once.
BATCH = 5_000
#: SQLite's own type names and what they are read as; other names are Spark's.
_KINDS = {"INTEGER": "bigint", "INT": "bigint", "TEXT": "string", "VARCHAR": "string", "REAL": "double", "FLOAT": "double", "NUMERIC": "double", "BLOB": "binary", "": "string"}
_SPARK = re.compile(r"tinyint|smallint|int|bigint|float|double|string|boolean|binary|date|timestamp")


def local_path(path: str) -> str:
    """A path of the file system from a path or a file: address."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _name(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"no table name: {name!r}")
    return f'"{name}"'


def shards(path: str) -> list[str]:
    """The SQLite files of a table."""
    path = local_path(path)
    if os.path.isfile(path):
        return [path]
    with open(os.path.join(path, MANIFEST)) as f:
        return [os.path.join(path, x) for x in json.load(f)["files"]]


def _declared(path: str, table: str) -> str:
    """The columns of a table as Spark's DDL."""
    path = local_path(path)
    if os.path.isdir(path):
        with open(os.path.join(path, MANIFEST)) as f:
            return json.load(f)["schema"]
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
        columns = c.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    kind = lambda k: k.lower() if _SPARK.fullmatch(k.lower()) and k.upper() not in _KINDS else _KINDS.get(k.upper().split("(")[0].strip(), "string")
    return ", ".join(f"`{name}` {kind(k)}" for _, name, k, *_ in columns)


_EPOCH = datetime.datetime(1970, 1, 1)


def _stored(v: object) -> object:
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        naive = v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
        return (naive - _EPOCH) // datetime.timedelta(microseconds=1)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return bytes(v) if isinstance(v, bytearray) else v


def _loaded(kind: object) -> object:
    if isinstance(kind, BooleanType):
        return bool
    if isinstance(kind, TimestampType):
        return lambda v: datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=v)
    if isinstance(kind, DateType):
        return datetime.date.fromisoformat
    if isinstance(kind, BinaryType):
        return bytes
    return lambda v: v


class _Range(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("splits", 4)), schema

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(p, i, self.parts) for p in shards(self.path) for i in range(self.parts)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # a table without files
            return
        table, names = _name(self.table), ", ".join(f'"{f.name}"' for f in self.schema)
        makers = [_loaded(f.dataType) for f in self.schema]
        with contextlib.closing(sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            if low is None:
                return
            step = (high - low) // partition.parts + 1
            first = low + partition.part * step
            for row in c.execute(f"SELECT {names} FROM {table} WHERE rowid >= ? AND rowid < ?", (first, first + step)):
                yield tuple(None if v is None else f(v) for f, v in zip(makers, row, strict=True))


class _Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = local_path(options["path"]), options["table"], schema, overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        name = f"part-{uuid.uuid4()}.db"
        columns = ", ".join(f'"{f.name}" {f.dataType.simpleString()}' for f in self.schema)
        marks = ", ".join("?" * len(self.schema))
        first = next(rows, None)
        if first is None:
            return _Written("")
        with contextlib.closing(sqlite3.connect(os.path.join(self.path, name))) as c:
            c.execute(f"CREATE TABLE {_name(self.table)} ({columns})")
            held: list[tuple] = []
            for row in chain([first], rows):
                held.append(tuple(map(_stored, row)))
                if len(held) >= BATCH:
                    c.executemany(f"INSERT INTO {_name(self.table)} VALUES ({marks})", held)
                    held = []
            c.executemany(f"INSERT INTO {_name(self.table)} VALUES ({marks})", held)
            c.commit()
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        manifest = os.path.join(self.path, MANIFEST)
        before: list[str] = []
        if not self.overwrite and os.path.exists(manifest):
            with open(manifest) as f:
                before = json.load(f)["files"]
        made = {"files": before + [m.file for m in messages if m and m.file], "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)}
        with open(f"{manifest}.{uuid.uuid4()}", "w") as f:
            json.dump(made, f)
        os.replace(f.name, manifest)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.file:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(self.path, m.file))


class SqliteShards(DataSource):
    """``spark.read.format("docloom_sqlite").option("table", t).load(path)``, and the same to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _declared(self.options["path"], self.options["table"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteShards)


# storage


class Storage(ABC):
    """Keyed rows that are kept.  ``keys`` name a row, ``version`` tells which of two is newer."""

    def __init__(self, keys: Sequence[str], version: str):
        self.keys, self.version = list(keys), version

    @abstractmethod
    def save(self, rows: DataFrame) -> None:
        """Add rows; all or, if it fails, none."""

    @abstractmethod
    def load(self) -> DataFrame:
        """All rows."""

    def newest(self) -> DataFrame:
        """The newest row of each key."""
        rows = self.load()
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.col(self.version)).alias("x")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "x.*").select(*rows.columns)

    def retrieve(self, wanted: DataFrame) -> DataFrame:
        """The newest row of each of the wanted keys that there is."""
        return self.newest().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")


class SqliteStorage(Storage):
    def __init__(self, spark: SparkSession, path: str, table: str, keys: Sequence[str], version: str):
        super().__init__(keys, version)
        register(spark)
        self.spark, self.path, self.table = spark, path, table

    def save(self, rows: DataFrame) -> None:
        rows.write.format(FORMAT).option("table", self.table).mode("append").save(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.format(FORMAT).option("table", self.table).load(self.path)


class Packed(NamedTuple):
    data: bytes
    checksum: str


def pack(json_text: str) -> Packed:
    data = zlib.compress(json_text.encode())
    return Packed(data, sha256(data).hexdigest())


def unpack(data: bytes | None, checksum: str | None) -> str | None:
    """The text, or None if it isn't what was packed."""
    if data is None or checksum is None or sha256(data).hexdigest() != checksum:
        return None
    return zlib.decompress(data).decode()


def sealed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, and ``data`` and ``checksum`` of all other columns."""
    rest = F.to_json(F.struct(*(c for c in rows.columns if c not in keys)), {"ignoreNullFields": "false"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pack(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([m.data for m in made], pa.binary()), pa.array([m.checksum for m in made], pa.string())], [*b.schema.names[:-1], "data", "checksum"])

    given = rows.select(*keys, rest.alias("json"))
    return given.mapInArrow(run, StructType([*given.drop("json").schema.fields, *StructType.fromDDL("data binary, checksum string").fields]))


def opened(rows: DataFrame, keys: Sequence[str], schema: StructType) -> DataFrame:
    """The keys, the packed columns of ``schema``, and ``intact``; the columns of a row that isn't are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            texts = [unpack(d, c) for d, c in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(texts, pa.string())], [*b.schema.names[: n - 2], "json"])

    given = rows.select(*keys, "data", "checksum")
    texts = given.mapInArrow(run, StructType([*given.select(*keys).schema.fields, StructField("json", StringType())]))
    return texts.withColumn("x", F.from_json("json", schema)).select(*keys, "x.*", F.col("json").isNotNull().alias("intact"))


class CheckedStorage(Storage):
    """Another storage with every row sealed; ``load`` leaves out rows that are no longer intact, ``checked`` shows them."""

    def __init__(self, inner: Storage, schema: str):
        super().__init__(inner.keys, inner.version)
        self.inner = inner
        self.schema = StructType([f for f in StructType.fromDDL(schema).fields if f.name not in inner.keys])

    def save(self, rows: DataFrame) -> None:
        self.inner.save(sealed(rows, self.keys))

    def checked(self) -> DataFrame:
        return opened(self.inner.load(), self.keys, self.schema)

    def load(self) -> DataFrame:
        return self.checked().filter("intact").drop("intact")
