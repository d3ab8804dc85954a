"""Row numbers by key and order, whatever a key's share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import scratch_dir

#: Rows that one task numbers.
PART_ROWS = 1_000_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place (from 0) among the rows of their ``keys`` in ``order``; null is a key like any other.

    Keys and order alone are range partitioned, so a key with most of the rows lies in many parts; each part numbers its
    own rows, and a prefix sum over the parts' counts shifts them. Only a key that continues from an earlier part needs a shift, at
    most one per part. The other columns wait in files and meet their numbers by a row id.
    """
    spark = rows.sparkSession
    held, dealt = scratch_dir(spark, "rows"), scratch_dir(spark, "ordered")
    rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(held)
    whole = spark.read.parquet(held)
    slim = whole.select(*dict.fromkeys([*keys, *order]), "_id")
    parts = max(1, -(-whole.count() // PART_ROWS))
    slim.repartitionByRange(parts, *keys, *order, "_id").withColumn("_part", F.spark_partition_id()).write.parquet(dealt)
    placed = spark.read.parquet(dealt)
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_id")
    local = placed.select("*", (F.row_number().over(inside) - 1).cast("long").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_c")).withColumn("_shift", F.sum("_c").over(before)).filter("_shift > 0")
    shifts = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_shift")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    numbers = local.join(F.broadcast(shifts), on, "left").select("_id", (F.col("_n") + F.coalesce("_shift", F.lit(0))).alias(name))
    return whole.join(numbers, "_id").drop("_id")
