"""Shared folder, cut points and the word rule used by several operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting, as in tests: a folder is made for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that
    outlive any executor."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of ``rows`` in a session that has not chosen a number itself: Spark's default of 10,000 is meant
    for numbers, and a batch is held several times over, by the executor and by its worker. A number that the caller set stays."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(rows))


def partitions_for(df: DataFrame, column: str, mb: int) -> int:
    """Shuffle partitions of about ``mb`` MB of a text column, at least ``spark.sql.shuffle.partitions``."""
    size = df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, with A-Z lower-cased; null has none.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for caches shared by its tasks."""
    return sys.modules.setdefault("_quarry_worker", types.ModuleType("_quarry_worker")).__dict__


LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 20, 1 << 27, 32


def marked(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_hit``: false where the keys (whole numbers) are certainly not in ``ids``, a written table.

    A bitmap of hashed keys is broadcast: ``BITS_A_KEY`` bits a key, at most ``MOST_BITS`` (16 MB) whatever their number.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys]), F.lit(bits))
    maps = ids.dropna(subset=keys).select(place.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_pos", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_pos div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_pos % 8 as int))")) != 0, F.lit(False))
    for k in keys:
        hit = hit & F.col(k).isNotNull()
    return placed.join(F.broadcast(maps), "_bucket", "left").withColumn("_hit", hit).select(*rows.columns, "_hit")


def among(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys may be in ``ids``, in the scan and without a shuffle: a full bitmap keeps more rows, it drops none
    that is in ``ids``. An exact join must follow."""
    return marked(rows, ids, keys).filter("_hit").drop("_hit")


def without(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``ids`` (null keys stay); only rows that the bitmap cannot clear are joined."""
    known = marked(rows, ids, keys)
    return known.filter("not _hit").drop("_hit").unionByName(known.filter("_hit").drop("_hit").join(ids, keys, "left_anti"))


LEAST_HOT, MOST_HOT = 500, 50_000


def hot_limit(n_rows: int) -> int:
    """Rows of one key that a task may take: at most ``MOST_HOT`` keys of ``n_rows`` rows can have more."""
    return max(LEAST_HOT, n_rows // MOST_HOT)


def hot_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, _copies) of the keys with more than ``limit`` rows, counted on the map side first."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_copies"))


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has few rows a key: rows of a hot key are dealt by hash over ``_copies``
    tasks, and its rows of ``one`` go to each of them. ``hot`` has at most ``MOST_HOT`` rows (``hot_limit``)."""
    hot = F.broadcast(hot)
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("_copies")
    copied = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")
