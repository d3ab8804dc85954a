"""Near-duplicate groups by HyperMinHash sketches, exact verification and connected components.

Sketch: 128 buckets, each with a hash function of its own. A bucket keeps the count of leading zeros of
its smallest hash (6 bits) and the 10 bits after the leading one; four buckets fill one 64-bit
band, so a sketch is 32 longs and each long is a band key as it stands. Two sets with Jaccard 0.8
miss each other in all bands with probability (1 - 0.8**4)**32 < 1e-7.

No step emits all pairs of a group:

1. texts with equal shingle sets form one class, represented by the smallest doc_id;
2. in each band bucket the class that shares most with others is the hub; every other class is
   compared with the hub only, and classes of buckets of at most ``SMALL`` also with one another;
3. pairs pass the collision-corrected estimate (five standard errors below the limit), then the exact
   test on full sets; the links are joined into components;
4. classes of larger buckets that still span several components go through an exact prefix join
   (rarest shingles first, with length and position limits), which loses no pair above the
   limit, and its links are added.

Hot keys: a bucket, a class, a hub of links or a component with more rows than a task should take is dealt
over several tasks (``spread_join``).

Nulls: a null text is an empty set and links with nothing. A row with a null doc_id links with nothing
and is kept, its component is null. Repeated rows share a component. Rows that repeat a doc_id with
another text are each linked by their own text: classes and links have keys of their own, and ``keep_one``
drops rows, not doc_ids. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import among, cut, hot_keys, hot_limit, spread_join, text_batches, without, words

BANDS, ROWS = 32, 4
BUCKETS = BANDS * ROWS
MANTISSA = 10
SMALL = 8
CACHE_WORDS, TEXTS = 100_000, 1000
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
MULTIPLIERS = _RANDOM.integers(0, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RANDOM.integers(0, 2**63, BUCKETS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the ``n``-word shingles of a text, in text order; word hashes are cached."""

    def __init__(self, n: int):
        self.n, self.cache = n, {}

    def word_hashes(self, found: list[bytes]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.cache.__getitem__, found)), np.uint64)
        except KeyError:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            for w in set(found):
                if w not in self.cache:
                    self.cache[w] = xxhash.xxh64_digest(w)
            return np.frombuffer(b"".join(map(self.cache.__getitem__, found)), np.uint64)

    def in_order(self, text: str | None, n: int | None = None) -> np.ndarray:
        """With fewer than ``n`` words the whole sequence is one shingle; without words there is none."""
        found = words(text)
        if not found:
            return np.empty(0, np.uint64)
        h = self.word_hashes(found)
        n = min(n or self.n, len(h))
        x = mix(h[: len(h) - n + 1] + np.uint64(n))
        for i in range(1, n):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return x

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.in_order(text))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty set."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024] * MULTIPLIERS[:, None]
        part += ADDENDS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    zeros = 53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def small(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts of ``TEXTS`` rows, so that what a part is turned into stays small."""
    for b in batches:
        for at in range(0, len(b), TEXTS):
            yield b.iloc[at : at + TEXTS]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (tells rows of one doc_id apart by their text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key (128 bits of the whole set), sketch (null for an empty set)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n_words)
        for b in small(batches):
            sets = [shingler(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "row_key": b["row_key"], "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [registers(s).view(np.int64) if len(s) else None for s in sets],
            })

    return _keyed(docs).filter("doc_id is not null").mapInPandas(run, "doc_id long, row_key long, n_shingles long, set_key binary, sketch array<bigint>")


def shingle_sets(docs: DataFrame, owners: DataFrame, n_words: int) -> DataFrame:
    """(id, shingles array<bigint>) for ``owners(id, doc_id, row_key)``; a row that repeats is read once."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n_words)
        for b in small(batches):
            yield pd.DataFrame({"id": b["id"], "shingles": [shingler(t).view(np.int64) for t in b["text"]]})

    keys, owners = ["doc_id", "row_key"], cut(owners, "owners")
    texts = among(_keyed(docs), owners.select(*keys), keys).groupBy(*keys).agg(F.first("text").alias("text"))
    return texts.join(owners, keys).select("id", "text").mapInPandas(run, "id long, shingles array<bigint>")


def estimate(a: str, b: str, na: str, nb: str) -> Column:
    """Jaccard from equal registers, less the share that equal by chance.

    Two independent minima of sets of sizes n and m fall into one register cell with probability
    about 0.7213 * 2**-10 * n*m / (n+m)**2: a cell is 2**-10 of its octave wide.
    """
    lanes = "".join(f"+ int(shiftrightunsigned(x, {16 * k}) & 65535L = 0L)" for k in range(ROWS))
    equal = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, x) -> n {lanes})") / F.lit(float(BUCKETS))
    n, m = F.col(na).cast("double"), F.col(nb).cast("double")
    chance = F.lit(0.7213 / 2**MANTISSA) * n * m / ((n + m) * (n + m))
    return (equal - chance) / (F.lit(1.0) - chance)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every vertex of ``edges(a, b)``: comp is the least vertex it can reach.

    Least-neighbour labels with pointer jumping; the rounds end when a full sweep changes nothing.
    """
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a"))).distinct(), "adjacency")
    limit = hot_limit(both.count())
    hubs = cut(hot_keys(both, ["to"], limit), "hubs")
    label = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("comp")), "labels")
    while True:
        near = spread_join(both, label.select(F.col("id").alias("to"), "comp"), ["to"], hubs).groupBy("id").agg(F.min("comp").alias("near"))
        swept = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("beyond"))
        new = cut(spread_join(swept, jump, ["comp"], hot_keys(label, ["comp"], limit)).select("id", "old", F.least("comp", "beyond").alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("id", "comp")
        label = new.select("id", "comp")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets.

    A vertex with many pairs is a hot key of both joins; its sketch and its set go to several tasks.
    """
    pairs = cut(pairs, "pairs")
    limit = hot_limit(pairs.count())
    hot = {x: cut(hot_keys(pairs, [x], limit), "hubs") for x in "ab"}
    margin = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    likely = (
        spread_join(spread_join(pairs, side("a"), ["a"], hot["a"]), side("b"), ["b"], hot["b"])
        .filter("least(na, nb) * 100 >= greatest(na, nb) * " + str(percent))
        .filter(estimate("sa", "sb", "na", "nb") >= margin).select("a", "b")
    )
    likely = cut(likely, "likely")
    needed = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    sets = cut(shingle_sets(docs, classes.select("id", "doc_id", "row_key").join(needed, "id", "left_semi"), n_words), "sets")
    own = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    full = spread_join(spread_join(likely, own("a"), ["a"], hot["a"]), own("b"), ["b"], hot["b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(full.withColumn("common", common).filter(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select("a", "b").distinct(), "links")


def _prefix_pairs(members: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Pairs of ``members(id, comp)`` in different components that may reach ``percent``; misses none.

    Sets with that similarity share a shingle among the first n - ceil(n * percent) + 1 of each, in any
    order common to all; rarest first makes these lists short. What is left after the shared shingle
    must suffice for the intersection asked for. On each shingle only members outside its largest
    component are joined with the rest, so a large linked group is not compared with itself. The members of a
    frequent shingle are dealt over several tasks.
    """
    owners = classes.select("id", "doc_id", "row_key").join(members.select("id"), "id", "left_semi")
    sets = shingle_sets(docs, owners, n_words).join(members, "id")
    posts = cut(sets.select("id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("g")), "postings")
    common = posts.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("df > 1")
    limit = hot_limit(posts.count())
    known = spread_join(posts, common, ["g"], common.filter(F.col("df") > limit).select("g", F.ceil(F.col("df") / limit).cast("int").alias("_copies")))
    order = Window.partitionBy("id").orderBy("df", "g")
    placed = known.withColumn("at", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id")) + F.row_number().over(order) - 1)
    front = cut(placed.filter(f"lo <> hi and at <= n - ceil(n * {percent} / 100.0D - 1e-9D)").select("g", "id", "comp", "n", "at"), "prefixes")
    most = front.groupBy("g", "comp").count().groupBy("g").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
    hot = cut(hot_keys(front, ["g"], limit), "hot-shingles")
    minor = spread_join(front, most, ["g"], hot).filter("comp <> main").select("g", F.col("id").alias("i"), F.col("comp").alias("ci"), F.col("n").alias("ni"), F.col("at").alias("pi"))
    wide = spread_join(front, minor, ["g"], hot).filter("ci <> comp and least(n, ni) * 100 >= greatest(n, ni) * " + str(percent))
    wide = wide.filter(f"{100 + percent} * (1 + least(n - at - 1, ni - pi - 1)) >= {percent} * (n + ni)")
    return wide.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct()


def labelled(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Per row with a doc_id: doc_id, row_key, n_shingles, component_id, class_id (smallest doc_id of the class) and
    ``stays``: the row's class is the component's first that holds its smallest doc_id, and the row is of that doc_id."""
    text_batches(docs.sparkSession)
    sk = cut(sketches(docs, n_words), "sketches")
    least = F.min(F.struct("doc_id", "row_key")).alias("o")
    grouped = sk.filter("n_shingles > 0").groupBy("set_key").agg(least, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows"))
    # Two classes may have one smallest doc_id (a doc_id with two texts), so a class has a number of its own.
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("id"), "set_key", "o.*", "n", "sketch", "rows"), "classes")
    limit = hot_limit(BANDS * classes.count())
    copies = F.ceil(F.col("m") / limit).cast("int").alias("_copies")

    bands = classes.select("id", F.posexplode("sketch").alias("band", "key"))
    sizes = cut(bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "bucket-sizes")
    hot = sizes.filter(F.col("m") > limit).select("band", "key", copies)
    shared = cut(spread_join(bands, sizes, ["band", "key"], hot), "buckets")
    score = shared.groupBy("id").agg(F.sum("m").alias("score"))
    hubs = shared.join(score, "id").groupBy("band", "key").agg(F.min(F.struct(-F.col("score"), "id"))["id"].alias("hub"))
    star = spread_join(shared, hubs, ["band", "key"], hot).filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    few = shared.filter(f"m <= {SMALL}").select("band", "key", "id")
    close = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), ["band", "key"]).filter("a < b").select("a", "b")
    links = _verified(star.union(close).distinct(), classes, docs, n_words, percent)
    label = components(links)

    large = shared.filter(f"m > {SMALL}").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = large.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band", "key")
    members = cut(spread_join(large, mixed, ["band", "key"], hot).select("id", "comp").distinct(), "unsettled")
    if not members.isEmpty():
        pairs = _prefix_pairs(members, classes, docs, n_words, percent)
        more = _verified(pairs, classes, docs, n_words, percent)
        if not more.isEmpty():
            label = components(links.union(more))

    named = cut(classes.select("id", "set_key", "doc_id", "rows").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "named")
    first = named.groupBy("comp").agg(F.min(F.struct("doc_id", "id")).alias("first"), F.count(F.lit(1)).alias("m"))
    named = spread_join(named, first.select("comp", "first"), ["comp"], first.filter(F.col("m") > limit).select("comp", copies))
    named = named.select("set_key", F.col("doc_id").alias("class_id"), F.col("first.doc_id").alias("component_id"), (F.col("id") == F.col("first.id")).alias("first_class"))
    common = classes.filter(F.col("rows") > limit).select("set_key", F.ceil(F.col("rows") / limit).cast("int").alias("_copies"))
    sets = spread_join(sk.filter("n_shingles > 0").select("doc_id", "row_key", "n_shingles", "set_key"), named, ["set_key"], common).drop("set_key")
    alone = sk.filter("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first_class"))
    return sets.unionByName(alone).withColumn("stays", (F.col("doc_id") == F.col("component_id")) & F.col("first_class")).drop("first_class")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept, class_id."""
    # A null doc_id has no class; its row is counted and kept apart.
    nameless = docs.filter("doc_id is null").select(F.col("text").cast("string").alias("text"))
    out = labelled(docs, n_words, percent).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")
    return out.unionByName(_nameless(nameless, n_words))


def _nameless(rows: DataFrame, n_words: int) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n_words)
        for b in batches:
            yield pd.DataFrame({"n_shingles": [len(shingler(t)) for t in b["text"]]})

    counted = rows.mapInPandas(run, "n_shingles long")
    none = F.lit(None).cast("long")
    return counted.select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(True).alias("kept"), none.alias("class_id"))


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each group the text of its smallest doc_id stays.

    Rows that repeat the doc_id and the shingles of a kept row stay.
    """
    keys = ["doc_id", "row_key"]
    dropped = labelled(docs, n_words, percent).filter("not stays").select(*keys).distinct()
    # The caller's columns travel in one struct, so no name of theirs can clash with one used here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"))
    return without(own, cut(dropped, "dropped"), keys).select("_row.*")
