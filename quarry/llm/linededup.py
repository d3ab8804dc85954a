"""Incremental, reversible line dedup: sharded cuckoo filters in front of exact reference counts.

State: Parquet folders under one path of the shared store. Every change adds one version to each of them and
rewrites nothing:

* ``refs``: which document holds which line key on which lines (``part`` tells rows of one doc_id apart by
  their text);
* ``gone``: deleted doc_ids; a reference of an earlier version is dead then;
* ``docs``: inserted doc_ids;
* ``counts``: exact number of documents and smallest doc_id of the keys that the version touched; the newest
  row of a key holds, 0 documents mean that the key is dead;
* ``filters``: cuckoo filters of the shards that the version touched; the newest of a shard holds;
* ``state``: written last, one row; a version without it does not exist.

An insertion probes the filters: keys that are certainly new become new counts without meeting the exact
table, only the others are joined with it. A deletion takes the documents' references back; keys without
references leave counts and filter, which a Bloom filter could not do. A key is 128 bits (two seeded
64-bit hashes) of the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys of fewer than
``MIN_CHARS`` code points are never counted. A key's shard is its hash modulo the number of shards; this
doubles when a shard would hold more than ``SHARD_KEYS`` keys, and the filters are built anew from the counts.
A frequent line adds nothing to a shard: references are combined before they are shuffled.

``dedup_lines`` inserts a table in ``BATCHES`` batches, so that each later batch goes through the filters of
the earlier ones.

Nulls: a null text is one empty line. A row with a null doc_id is no document: its lines are neither
counted nor dropped. Rows that repeat a doc_id are parts of one document. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import among, cut, fresh_dir, hot_limit, marked, spread_join

MIN_CHARS = 10
SHARDS, SHARD_KEYS = 16, 500_000
BATCHES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]
FILTERS = "shard int, size long, fill binary, slots binary"
SCHEMAS = {
    "refs": "k1 long, k2 long, doc_id long, part long, at array<int>", "docs": "doc_id long", "gone": "doc_id long",
    "counts": "k1 long, k2 long, n_docs long, owner long", "filters": FILTERS,
    "state": "version int, shards int, filters_from int, n_keys long, deletes array<int>",
}


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a fingerprint has two possible buckets."""

    SLOTS, KICKS = 4, 400

    def __init__(self, size: int, fill: bytes | None = None, slots: bytes | None = None):
        self.size = size
        self.fill = bytearray(fill) if fill is not None else bytearray(size)
        self.slots = array("H", slots if slots is not None else bytes(2 * self.SLOTS * size))

    @classmethod
    def holding(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / (cls.SLOTS * 0.85))))))

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.size - 1)
        mark = (k2.view(np.uint64) % np.uint64(65535)) + np.uint64(1)
        one = k1.view(np.uint64) & mask
        return mark, one, one ^ (self._jump(mark) & mask)

    @staticmethod
    def _jump(mark: np.ndarray) -> np.ndarray:
        return (mark * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(k1, k2)
        table = np.frombuffer(self.slots, np.uint16).reshape(self.size, self.SLOTS)
        marks = mark.astype(np.uint16)[:, None]
        return (table[one] == marks).any(axis=1) | (table[two] == marks).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False when a key finds no place: build a larger filter from the counts then."""
        return all(self._put(m, a, b) for m, a, b in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True))

    def _put(self, mark: int, one: int, two: int) -> bool:
        fill, slots, n = self.fill, self.slots, self.SLOTS
        for at in (one, two):
            if fill[at] < n:
                slots[n * at + fill[at]] = mark
                fill[at] += 1
                return True
        at = one
        for kick in range(self.KICKS):
            place = n * at + kick % n
            mark, slots[place] = slots[place], mark
            at ^= ((mark * 0x9E3779B97F4A7C15) % 2**64 >> 20) & (self.size - 1)
            if fill[at] < n:
                slots[n * at + fill[at]] = mark
                fill[at] += 1
                return True
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        fill, slots, n = self.fill, self.slots, self.SLOTS
        for mark, *both in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in both:
                own = slots[n * at : n * at + fill[at]]
                if mark in own:
                    fill[at] -= 1
                    slots[n * at + own.index(mark)] = slots[n * at + fill[at]]
                    slots[n * at + fill[at]] = 0
                    break

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "size": [self.size], "fill": [bytes(self.fill)], "slots": [self.slots.tobytes()]})


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_refs(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, part, at): the countable line keys of each document and the lines they are on."""
    lines = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("pos", "key"))
    long_enough = lines.filter(F.length("key") >= MIN_CHARS)
    keyed = long_enough.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), F.col("key")).alias("k2"), "doc_id", "part", "pos")
    return keyed.groupBy("k1", "k2", "doc_id", "part").agg(F.collect_set("pos").alias("at"))


class LineIndex:
    """Handle to one version of the state. A change returns the handle of the next version; two changes from one
    handle clash and the second raises."""

    def __init__(self, spark: SparkSession, path: str, version: int = 0, shards: int = SHARDS, filters_from: int = 1, n_keys: int = 0, deletes: tuple[int, ...] = ()):
        self.spark, self.path, self.version, self.shards = spark, path, version, shards
        self.filters_from, self.n_keys, self.deletes = filters_from, n_keys, tuple(deletes)
        self.rebuilt: DataFrame | None = None  # filters of another shard count than the stored ones

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, shards: int = SHARDS) -> LineIndex:
        """An empty index."""
        return cls(spark, path or fresh_dir(spark, "lines"), shards=shards)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The newest version stored under ``path``."""
        newest = spark.read.schema(SCHEMAS["state"] + ", v int").parquet(f"{path}/state").orderBy(F.desc("version")).first()
        return cls(spark, path, newest.version, newest.shards, newest.filters_from, newest.n_keys, newest.deletes)

    def _read(self, name: str, first: int = 1) -> DataFrame:
        """All rows of a folder up to this version, with their version ``v``."""
        if not self.version:
            return self.spark.createDataFrame([], SCHEMAS[name] + ", v int")
        return self.spark.read.schema(SCHEMAS[name] + ", v int").parquet(f"{self.path}/{name}").filter(F.col("v").between(first, self.version))

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{name}/v={self.version + 1}")

    def _next(self, **changed) -> LineIndex:
        """The next version, to be stored by :meth:`_commit`."""
        own = {"shards": self.shards, "filters_from": self.filters_from, "n_keys": self.n_keys, "deletes": self.deletes} | changed
        return LineIndex(self.spark, self.path, self.version + 1, **own)

    def _commit(self) -> LineIndex:
        row = [(self.version, self.shards, self.filters_from, self.n_keys, list(self.deletes))]
        self.spark.createDataFrame(row, SCHEMAS["state"]).coalesce(1).write.parquet(f"{self.path}/state/v={self.version}")
        return self

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, v, ...) without those whose document was deleted after them."""
        if not self.deletes:
            return rows
        last = self._read("gone").groupBy("doc_id").agg(F.max("v").alias("until"))
        return rows.join(last, "doc_id", "left").filter("until is null or until < v").drop("until")

    def refs(self) -> DataFrame:
        return self._alive(self._read("refs")).drop("v")

    def counts(self) -> DataFrame:
        """k1, k2, n_docs, owner of the live keys."""
        rows = self._read("counts")
        if self.version < 2:
            return rows.drop("v")
        return rows.groupBy(*KEY).agg(F.max_by(F.struct("n_docs", "owner"), "v").alias("c")).select(*KEY, "c.*").filter("n_docs > 0")

    def filters(self) -> DataFrame:
        if self.rebuilt is not None:
            return self.rebuilt
        rows = self._read("filters", self.filters_from)
        newest = rows.groupBy("shard").agg(F.max("v").alias("v"))
        return rows.join(F.broadcast(newest), ["shard", "v"]).drop("v")  # one row a shard

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("k2", F.lit(self.shards)).cast("int"))

    def _wide(self, n_keys: int) -> LineIndex:
        """This version with filters of as many shards as ``n_keys`` keys need: a batch that is large beside the index is probed in
        shards of its own size, never in the old ones."""
        shards = self.shards
        while n_keys > shards * SHARD_KEYS:
            shards *= 2
        if shards == self.shards:
            return self
        wide = LineIndex(self.spark, self.path, self.version, shards, self.filters_from, self.n_keys, self.deletes)
        wide.rebuilt = cut(wide._built(self.counts()), "filters")
        return wide

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys(k1, k2)`` with ``maybe``: false only where the key is certainly not stored."""

        def look(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            k1, k2 = own["k1"].to_numpy(np.int64), own["k2"].to_numpy(np.int64)
            maybe = np.zeros(len(own), bool)
            for row in stored.itertuples():
                maybe |= CuckooFilter(int(row.size), row.fill, row.slots).contains(k1, k2)
            return pd.DataFrame({"k1": k1, "k2": k2, "maybe": maybe})

        own = self._sharded(keys.select(*KEY))
        return own.groupBy("shard").cogroup(self.filters().select("shard", F.col("size"), "fill", "slots").groupBy("shard")).applyInPandas(look, "k1 long, k2 long, maybe boolean")

    def _filters_after(self, changes: DataFrame) -> DataFrame:
        """Filters of the touched shards with ``changes(k1, k2, gain)`` applied: gain 1 inserts, -1 deletes.

        A filter that would be over-full comes back with size -1: it is to be built anew from the counts.
        """

        def apply(change: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            if not len(change):
                return pd.DataFrame({"shard": [], "size": [], "fill": [], "slots": []})
            shard = int(change["shard"].iloc[0])
            gone, new = ([change.loc[change["gain"] == gain, k].to_numpy(np.int64) for k in KEY] for gain in (-1, 1))
            if len(stored):
                now = CuckooFilter(int(stored["size"].iloc[0]), stored["fill"].iloc[0], stored["slots"].iloc[0])
            else:
                now = CuckooFilter.holding(2 * len(new[0]))
            now.delete(*gone)
            if sum(now.fill) + len(new[0]) > 0.93 * CuckooFilter.SLOTS * now.size or not now.insert(*new):
                return pd.DataFrame({"shard": [shard], "size": [-1], "fill": [b""], "slots": [b""]})
            return now.row(shard)

        return self._sharded(changes).groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(apply, FILTERS)

    def _built(self, keys: DataFrame) -> DataFrame:
        """Filters of ``keys(k1, k2)``, one a shard."""

        def build(own: pd.DataFrame) -> pd.DataFrame:
            n = len(own)
            while True:
                made = CuckooFilter.holding(2 * n)
                if made.insert(own["k1"].to_numpy(np.int64), own["k2"].to_numpy(np.int64)):
                    return made.row(int(own["shard"].iloc[0]))
                n *= 2

        return self._sharded(keys.select(*KEY)).groupBy("shard").applyInPandas(build, FILTERS)

    def _store_filters(self, after: LineIndex, changes: DataFrame) -> LineIndex:
        """Write the filters of version ``after``, whose counts are stored, and its state."""
        if after.shards != self.shards:
            self._write("filters", after._built(after.counts()))
            after.filters_from = after.version
        else:
            done = cut(self._filters_after(changes), "filters")
            full = done.filter("size < 0").select("shard")
            made = done.filter("size > 0")
            if not full.isEmpty():
                again = self._sharded(after.counts()).join(F.broadcast(full), "shard", "left_semi")
                made = made.unionByName(self._built(again))
            self._write("filters", made)
        return after._commit()

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. A document that is stored already adds only what it did not have."""
        self._write("docs", docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        ids = self.spark.read.schema(SCHEMAS["docs"]).parquet(f"{self.path}/docs/v={self.version + 1}")
        refs = line_refs(docs)
        again = self._alive(self._read("docs")).select("doc_id").join(ids, "doc_id", "left_semi").distinct()
        known = None
        if self.version and not again.isEmpty():
            known = cut(self.refs().join(again, "doc_id", "left_semi"), "known")
            refs = refs.join(known.select(*KEY, "doc_id", "part"), [*KEY, "doc_id", "part"], "left_anti")
        self._write("refs", refs.select(*KEY, "doc_id", "part", "at"))
        holders = self.spark.read.schema(SCHEMAS["refs"]).parquet(f"{self.path}/refs/v={self.version + 1}")
        if known is not None:  # a further row of a stored document is no further document
            holders = holders.join(known.select(*KEY, "doc_id"), [*KEY, "doc_id"], "left_anti")
        gained = cut(holders.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("least")), "gained")
        wide = self._wide(self.n_keys + gained.count())
        probed = gained.join(wide.probe(gained), KEY) if self.version else gained.withColumn("maybe", F.lit(False))
        probed = cut(probed, "probed")
        new = probed.filter("not maybe").select(*KEY, F.col("n").alias("n_docs"), F.col("least").alias("owner"), F.lit(True).alias("is_new"))
        met = probed.filter("maybe")
        if self.version:
            met = met.join(among(self.counts(), met.select(*KEY), KEY), KEY, "left")
        else:
            met = met.select("*", F.lit(None).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("owner"))
        met = met.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.col("n")).alias("n_docs"), F.least("owner", "least").alias("owner"), F.col("n_docs").isNull().alias("is_new"))
        touched = cut(new.unionByName(met), "touched")
        self._write("counts", touched.drop("is_new"))
        fresh = touched.filter("is_new").select(*KEY, F.lit(1).alias("gain"))
        return self._store_filters(self._next(n_keys=self.n_keys + fresh.count(), shards=wide.shards), fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take back every reference of the documents in ``doc_ids(doc_id)``."""
        self._write("gone", doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct())
        gone = self.spark.read.schema(SCHEMAS["gone"]).parquet(f"{self.path}/gone/v={self.version + 1}")
        refs = self.refs()
        keys = cut(refs.join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "keys")
        left = among(refs, keys, KEY).join(gone, "doc_id", "left_anti").join(keys, KEY, "left_semi")
        still = left.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("owner"))
        self._write("counts", keys.join(still, KEY, "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))))
        now = self.spark.read.schema(SCHEMAS["counts"]).parquet(f"{self.path}/counts/v={self.version + 1}")
        dead = now.filter("n_docs = 0").select(*KEY, F.lit(-1).alias("gain"))
        after = self._next(n_keys=self.n_keys - dead.count(), deletes=(*self.deletes, self.version + 1))
        return self._store_filters(after, dead)

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the new text and n_lines, n_dropped.

        A key held by two or more indexed documents loses its lines everywhere but in its owner. Only
        line numbers travel to the documents; documents that lose nothing are not shuffled.
        """
        counts = cut(self.counts().filter("n_docs > 1"), "repeated")
        refs = self.refs()
        limit = hot_limit(docs.count())
        hot = counts.filter(F.col("n_docs") > limit).select(*KEY, F.ceil(F.col("n_docs") / limit).cast("int").alias("_copies"))
        lost = spread_join(among(refs, counts.select(*KEY), KEY), counts.select(*KEY, "owner"), KEY, hot).filter("owner <> doc_id")
        lost = cut(lost.groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_part")).agg(F.flatten(F.collect_list("at")).alias("_lost")), "lost")
        # The caller's columns travel in one struct, so no name of theirs can clash with one used here.
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_part"), F.col("text").cast("string").alias("text"))
        rows = marked(own, lost.select("_id", "_part"), ["_id", "_part"])
        text = F.coalesce("text", F.lit(""))
        n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
        names = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
        whole = rows.filter("not _hit").select(*names, text.alias("text"), n_lines, F.lit(0).cast("long").alias("n_dropped"))
        lines = F.split(text, "\n", -1)
        kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_lost", F.array().cast("array<int>")))
        some = rows.filter("_hit").join(lost, ["_id", "_part"], "left").withColumn("_lines", lines)
        some = some.select("_row", F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n").alias("_new"), n_lines.alias("_n"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("_gone"))
        some = some.select(*names, F.col("_new").alias("text"), F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"))
        return whole.unionByName(some)


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Index all of ``docs`` in batches by a hash of doc_id and return them cleaned, with n_lines and n_dropped."""
    index = LineIndex.create(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k in range(batches):
        index = index.insert(slim.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index.clean(docs)
