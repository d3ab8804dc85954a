"""Fixed virtual slots: records hash into slots, slots are mapped to shards, and only the map is edited.

DataFrame functions only. The slot of a record never changes; its shard is looked up in a versioned
map ``(version, vslot, bytes, shard)``, stored as Parquet with one folder per version: ``store_map`` adds a
version and changes no earlier one, ``read_map`` returns the newest or a given one. Everything that is
gathered is the slot table, whose size is the fixed number of slots.

A record's slot comes from its doc_id. Where a slot holds more than ``SLACK`` of a shard's fair share and four times the mean, as that
of null or often repeated doc_ids may, its records are dealt by a second hash (text and place) over so many slots of a second range as bring each below
that; these slots are mapped like all others, so the law holds for hot keys too.

Nulls: a null key hashes like any other value, a null text counts 0 bytes plus 1. Repeated
rows are kept, each with its own position. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import cut, fresh_dir

MAP = "vslot int, bytes long, shard int, version int"
#: Rows of one virtual slot that are numbered by one task; a slot with more is dealt over several.
SLOT_ROWS = 1_000_000
#: Part of a shard's fair share that a slot may hold, and slots of the second range for each shard.
SLACK, EXTRA = 0.01, 512


def vslot(key: str | Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot of ``records(vslot, size)``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def split_hot(records: DataFrame, sizes: DataFrame, shards: int, slots: int) -> DataFrame:
    """``records(vslot, size, text_crc32, row)`` with the records of slots above their share dealt over slots from ``slots`` on.

    At most ``shards / SLACK`` slots are that large, so their table is bounded; each takes as many slots of the ``EXTRA * shards`` as its
    bytes need, beginning at a hash of its number.
    """
    total = sizes.agg(F.sum("bytes").alias("total"))
    share = F.col("total") * SLACK / shards
    hot = sizes.crossJoin(F.broadcast(total)).filter((F.col("bytes") > share) & (F.col("bytes") > 4 * F.col("total") / slots))  # one row of totals
    hot = hot.select("vslot", F.least(F.lit(EXTRA * shards), F.ceil(F.col("bytes") / share)).cast("int").alias("_many"), F.pmod(F.xxhash64("vslot", F.lit("second")), F.lit(EXTRA * shards)).alias("_first"))
    dealt = records.join(F.broadcast(hot), "vslot", "left")
    place = F.pmod(F.xxhash64("text_crc32", "row"), F.col("_many"))
    second = slots + F.pmod(F.col("_first") + place, F.lit(EXTRA * shards))
    return dealt.withColumn("vslot", F.coalesce(second.cast("int"), F.col("vslot"))).drop("_many", "_first")


def first_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Slot-to-shard map with near-equal bytes: slots in falling size, each to the shard with least.

    ``sizes`` has one row per slot, so the ordered list it folds over is bounded by the number of slots.
    """
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "vslot"))))
    step = (
        "aggregate(slots, named_struct('loads', transform(sequence(1, {n}), i -> named_struct('bytes', 0L, 'shard', i - 1)), 'out', array()),"
        " (acc, s) -> named_struct("
        "'loads', transform(acc.loads, l -> if(l.shard = array_min(acc.loads).shard, named_struct('bytes', l.bytes + s.bytes, 'shard', l.shard), l)),"
        "'out', concat(acc.out, array(named_struct('vslot', s.vslot, 'bytes', s.bytes, 'shard', array_min(acc.loads).shard)))),"
        " acc -> acc.out)"
    ).replace("{n}", str(int(shards))).replace("'out', array())", "'out', cast(array() as array<struct<vslot:int,bytes:bigint,shard:int>>))")
    return sizes.agg(ordered.alias("slots")).select(F.inline(F.expr(step))).select(F.lit(version).alias("version"), "vslot", "bytes", "shard")


def rebalance(current: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map: only slots beyond a shard's fair share move.

    Shards may be added (``shards`` larger) but not removed. Inside a shard the slots are kept in
    falling size while their sum is at most ``(1 + slack)`` of the mean; the rest goes, largest first, to
    the shard with least. Slots that are new in ``sizes`` are placed the same way.
    """
    now = sizes.join(current.select("vslot", "shard", "version"), "vslot", "left")
    fair = now.agg(((1 + slack) * F.sum("bytes") / shards).alias("fair"), (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next"))
    held = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    placed = now.crossJoin(F.broadcast(fair)).withColumn("kept", F.col("shard").isNotNull() & (F.sum("bytes").over(held) <= F.col("fair")))
    one = placed.agg(
        F.first("next").alias("next"),
        F.collect_list(F.when(F.col("kept"), F.struct("vslot", "bytes", "shard"))).alias("kept"),
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct("bytes", "vslot"))))).alias("moved"),
    )
    loads = f"transform(sequence(0, {int(shards) - 1}), i -> named_struct('bytes', aggregate(filter(kept, k -> k.shard = i), 0L, (a, k) -> a + k.bytes), 'shard', i))"
    step = (
        f"aggregate(moved, named_struct('loads', {loads}, 'out', kept),"
        " (acc, s) -> named_struct("
        "'loads', transform(acc.loads, l -> if(l.shard = array_min(acc.loads).shard, named_struct('bytes', l.bytes + s.bytes, 'shard', l.shard), l)),"
        "'out', concat(acc.out, array(named_struct('vslot', s.vslot, 'bytes', s.bytes, 'shard', array_min(acc.loads).shard)))),"
        " acc -> acc.out)"
    )
    return one.select("next", F.inline(F.expr(step))).select(F.col("next").alias("version"), "vslot", "bytes", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add the version of ``slot_map`` to the maps under ``path``; a version that is there already raises."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is not None:
        slot_map.select("vslot", "bytes", "shard").coalesce(1).write.parquet(f"{path}/version={version}")  # one row per slot


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest map under ``path``, or that of ``version``."""
    maps = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard, from 0), grown_shard, vslot.

    Law ``bytes``: the shards' byte sums are near equal. ``path`` holds the stored maps (a new folder by
    default): the first call there stores version 1, a later one stores the map rebalanced to the bytes of
    ``docs`` as the next version; the newest version is then read back and decides. Positions count up by
    virtual slot and, inside a slot, by doc_id (a slot of many rows by parts): one prefix sum over the slot
    table and one sort inside each part, so no task holds a whole shard or a hot slot. The texts stay
    behind: only ids, sizes and checksums are shuffled.
    """
    spark, first = docs.sparkSession, path is None
    path = path or fresh_dir(spark, "slot-maps")
    named = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            vslot("doc_id", slots).alias("vslot"), F.monotonically_increasing_id().alias("row"),
        ), "records",
    )
    records = cut(split_hot(named, cut(slot_bytes(named), "slots"), shards, slots), "slotted")
    sizes = cut(slot_bytes(records), "slots")
    if sizes.isEmpty():
        mapped = spark.createDataFrame([], MAP)
    else:
        store_map(first_map(sizes, shards) if first or not stored(spark, path) else rebalance(read_map(spark, path), sizes, shards), path)
        mapped = read_map(spark, path)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / SLOT_ROWS)).cast("int").alias("parts")
    dealt = records.join(F.broadcast(sizes.select("vslot", parts)), "vslot").withColumn("part", F.pmod("row", F.col("parts")).cast("int"))
    counts = dealt.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("rows"))  # a row per slot and per SLOT_ROWS records
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(F.broadcast(mapped.select("vslot", "shard")), "vslot")
    placed = placed.select("vslot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("offset"))
    inside = Window.partitionBy("vslot", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row")
    numbered = dealt.withColumn("pos", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(placed), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("pos")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def stored(spark: SparkSession, path: str) -> bool:
    """Whether any map is stored under ``path``."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.schema(MAP).parquet(path).isEmpty()
    except AnalysisException:  # no such folder
        return False
