r"""Keyed sinks of a stream, which a repeated micro-batch does not change.

A sink is a folder: rows lie in buckets by the hash of their key, and a ledger names, for
each bucket, the micro-batches that wrote it and where.  A micro-batch reads the buckets
that its own keys fall in, merges, writes them anew beside the old ones, and only then
appends its lines to the ledger, in one file.  A micro-batch that the ledger has is left
out, and one that failed before its lines were written has changed nothing that
counts, so after any failure the stream can repeat its last micro-batch.

Use ``writeStream.foreachBatch(sink.upsert)`` or ``foreachBatch(sink.take_unseen)``; one
query writes a sink.  What reaches the driver is the ledger's last line of each bucket.  Older
versions of a bucket stay until ``vacuum``.  Null keys are a key of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import tables

BUCKETS = 32
LEDGER = "batch long, bucket int, path string"


class KeyedSink:
    """Rows by key in the folder ``path``; ``schema`` is that of the rows that are kept."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, *, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._append_ledger([])

    def _append_ledger(self, lines: list[tuple]) -> None:
        self.spark.createDataFrame(lines, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def done(self, batch: int) -> bool:
        return bool(self.ledger().filter(F.col("batch") == batch).limit(1).count())

    def _latest(self, of: list[int] | None = None) -> list[str]:
        lines = self.ledger().filter("bucket >= 0")
        if of is not None:
            lines = lines.filter(F.col("bucket").isin(of))
        return [r.path for r in lines.groupBy("bucket").agg(F.max_by("path", "batch").alias("path")).collect()]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """What the sink holds."""
        return self._read(self._latest())

    def merge(self, new: DataFrame, batch: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the keys of ``new`` by ``merged(old rows, new)``, once for each batch."""
        if self.done(batch):
            return
        new = new.withColumn("_bucket", self._bucket())
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        if touched:
            made = merged(self._read(self._latest(touched)), new.drop("_bucket")).select(*(f.name for f in self.schema))
            at = f"{self.path}/data/{batch}-{uuid.uuid4()}"
            made.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(at)
        self._append_ledger([(batch, b, f"{at}/bucket={b}") for b in touched] or [(batch, -1, None)])

    def upsert(self, version: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: of each key the row of the highest version stays, the new one on a tie."""
        return lambda new, batch: self.merge(new, batch, lambda old, rows: tables.upsert(old, rows.select(*old.columns), [self.key], version))

    def take_unseen(self, taken: str, day: str, order: str, expiry: int) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: rows whose key was not taken within ``expiry`` days go to the folder ``taken``, by batch; the sink holds (key, last).

        Rows must not come later than those of a later day of an earlier batch.
        """

        def run(new: DataFrame, batch: int) -> None:
            if self.done(batch):
                return
            new = new.withColumn("_bucket", self._bucket())
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]
            last = self._read(self._latest(touched)) if touched else self._read([])
            rows = tables.sink_unseen(new.drop("_bucket"), self.key, day, order, expiry, last)
            at = f"{taken.rstrip('/')}/batch={batch}"  # written again as it was if the ledger was not reached
            rows.write.mode("overwrite").parquet(at)
            kept = self.spark.read.schema(rows.schema).parquet(at).groupBy(self.key).agg(F.max(day).alias("last"))
            self.merge(kept, batch, lambda old, days: old.unionByName(days.select(*old.columns)).groupBy(self.key).agg(F.max("last").alias("last")))

        return run

    def vacuum(self) -> None:
        """Delete versions of buckets that the ledger has newer ones of, and what failed batches left."""
        keep = {p.rsplit("/", 2)[1] for p in self._latest()}
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(fs_path):
            for status in fs.listStatus(fs_path):
                if status.getPath().getName() not in keep:
                    fs.delete(status.getPath(), True)
