"""Versioned tables in hash buckets: a change reads and writes the buckets it touches, and no other.

``data/<folder>/bucket=B`` holds what one change wrote of bucket B. ``commits/v=N`` holds a row per bucket of version N, the folder
that the bucket was last written to, and is written last: a version without it does not exist. A change that was cut off
leaves files that nobody reads, and can be made again. A change may carry a tag, such as the id of a micro-batch; the same
tag again changes nothing. Of two changes of one version the second raises.

Everything goes through Spark's readers and writers, so a path may be in any file system that they know.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quarry.operators import state

COMMITS = "bucket int, folder string, tag string, attempt string, v int"
#: Rows of a bucket that one task writes.
FILE_ROWS = 1_000_000


class BucketStore:
    """A table of ``schema`` under ``path``; rows of one ``key`` are in one of ``buckets`` buckets, the same for all versions."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:  # no version yet
            return None

    def version(self) -> int:
        commits = self._commits()
        return 0 if commits is None else commits.agg(F.max("v")).first()[0] or 0

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows: at most one row per bucket."""
        commits = self._commits()
        if commits is None:
            return {}
        version = self.version() if version is None else version
        return {r.bucket: r.folder for r in commits.filter((F.col("v") == version) & (F.col("bucket") >= 0)).collect()}

    def has(self, tag: str) -> bool:
        """Whether a change with this tag is stored."""
        commits = self._commits()
        return commits is not None and not commits.filter(F.col("tag") == tag).isEmpty()

    def _files(self, held: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest or a given version."""
        return self._files(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows of the keys (not null), from their buckets alone."""
        touched = {r.bucket for r in keys.select(self._bucket()).distinct().collect()}  # at most ``buckets`` rows
        held = {b: f for b, f in self.manifest().items() if b in touched}
        return self._files(held).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def change(self, keys: DataFrame, apply: Callable[[DataFrame], DataFrame], tag: str | None = None) -> int:
        """Write the next version: ``apply`` gets the rows of the buckets that hold any of ``keys`` and returns what these
        buckets hold from now on; both are evaluated more than once. Returns the newest version."""
        now = self.version()
        if tag is not None and self.has(tag):
            return now
        sizes = {r.bucket: r.n for r in keys.groupBy(self._bucket()).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``buckets`` rows
        held, folder = self.manifest(now), f"{now + 1}-{uuid.uuid4().hex}"
        after = apply(self._files({b: f for b, f in held.items() if b in sizes})).select(*self.schema.names, self._bucket())
        # A bucket with many rows is written by several tasks; a key need not stay together inside it.
        tasks = max(1, -(-max(sizes.values(), default=0) // FILE_ROWS))
        dealt = after.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(tasks))).repartition("bucket", "_part").drop("_part")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        stored = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(f"{self.path}/data/{folder}")
        written = {r.bucket for r in stored.select("bucket").distinct().collect()}
        self._commit(now + 1, {b: f for b, f in held.items() if b not in sizes} | dict.fromkeys(written, folder), tag, folder)
        return now + 1

    def _commit(self, version: int, held: dict[int, str], tag: str | None, attempt: str) -> None:
        if self.version() >= version:
            raise RuntimeError(f"version {version} of {self.path} is taken: another change came first")
        rows = [(b, f, tag, attempt) for b, f in held.items()] or [(-1, None, tag, attempt)]
        self.spark.createDataFrame(rows, "bucket int, folder string, tag string, attempt string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits/v={version}")
        if self._commits().filter((F.col("v") == version) & (F.col("attempt") != attempt)).count():
            raise RuntimeError(f"two changes wrote version {version} of {self.path}")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, tag: str | None = None) -> int:
        """All rows of the keys in ``rows`` and ``keys`` give way to ``rows``."""
        gone = rows.select(self.key) if keys is None else rows.select(self.key).unionByName(keys.select(self.key))
        return self.change(gone, lambda old: self._without(old, gone).unionByName(rows.select(*self.schema.names)), tag)

    def upsert(self, rows: DataFrame, mutable: list[str], keep: list[str], keys: list[str] | None = None, tag: str | None = None) -> int:
        """Rows by identity (``keys``, the store's key among them): ``mutable`` columns from ``rows``, ``keep`` columns from the stored row."""
        return self.change(rows, lambda old: state.upsert(old, rows, keys or [self.key], mutable, keep), tag)

    def delete(self, keys: DataFrame, tag: str | None = None) -> int:
        return self.change(keys, lambda old: self._without(old, keys), tag)

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """``rows`` of other keys; null is a key like any other."""
        gone = keys.select(F.col(self.key).alias("_gone")).distinct()
        return rows.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
