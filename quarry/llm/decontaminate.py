"""Benchmark passages in documents: size-partitioned MinHash containment search.

The asked-for containment is ``|shingles(item) & shingles(doc)| >= percent % of |shingles(item)|`` over
five-word shingles. Items fall into size partitions (powers of two of their shingle count). An item's
sketch is its bottom-k MinHash, the k smallest shingle hashes; k follows from the partition's upper
size bound u as u - ceil(u * percent) + 1. More than n - ceil(n * percent) shingles of a matching item
cannot be absent from a document, so at least one sketch value occurs in it: the search misses
nothing, however long the document is, where a sketch of the document would lose short items.
Candidates are verified by exact containment on the full shingle sets.

Documents are read once and never shuffled while the items' shingles stay within ``broadcast_limit``;
beyond it the sketch is joined to the documents' shingles instead (``_by_join``).

Nulls: a null or empty text, of either side, contains and matches nothing. An item of fewer than five
words is one shingle of all its words and is looked for as that word sequence. A null doc_id or
item_id is carried through as null. Repeated rows give repeated results; empty tables give none.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.neardup import Shingler, small
from quarry.llm.shared import among, cut, hot_keys, hot_limit, spread_join, text_batches, without, words

SCHEMA = "item int, item_id long, size int, partition int, width int, shingles array<bigint>, sketch array<bigint>"
BROADCAST_LIMIT = 4_000_000


def item_sketches(items: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Per item with words: size partition, shingle width, full shingle set and bottom-k sketch."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n_words)
        for b in batches:
            rows = []
            for item_id, null, text in zip(b["item_id"], b["null_id"], b["text"], strict=True):
                full = shingler(text)
                if len(full):
                    upper = 1 << (len(full) - 1).bit_length()
                    k = min(len(full), upper - -(-upper * percent // 100) + 1)
                    rows.append((0, None if null else item_id, len(full), upper, min(n_words, len(words(text))), full.view(np.int64), full[:k].view(np.int64)))
            out = pd.DataFrame(rows, columns=["item", "item_id", "size", "partition", "width", "shingles", "sketch"])
            out["item_id"] = out["item_id"].astype("Int64")
            yield out

    slim = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("item_id").isNull().alias("null_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(run, SCHEMA)


class Items:
    """A bounded table of sketched items as a few arrays, as it is broadcast."""

    def __init__(self, rows: list):
        own = lambda name: np.concatenate([np.asarray(r[name], np.int64) for r in rows] or [np.empty(0, np.int64)]).view(np.uint64)
        ends = lambda name: np.cumsum([0, *(len(r[name]) for r in rows)])
        self.ids, self.width = [r.item_id for r in rows], np.array([r.width for r in rows], np.int32)
        self.shingles, self.ends = own("shingles"), ends("shingles")
        sketch, owner = own("sketch"), np.repeat(np.arange(len(rows)), np.diff(ends("sketch")))
        order = np.lexsort((owner, sketch))
        self.sketch, self.owner = sketch[order], owner[order]

    def full(self, k: int) -> np.ndarray:
        return self.shingles[self.ends[k] : self.ends[k + 1]]

    def by_width(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sketch values and their items, for each shingle width."""
        at = self.width[self.owner]
        return {int(w): (self.sketch[at == w], self.owner[at == w]) for w in np.unique(at)}


class Scanner:
    """Finds the items of a bounded table in single documents."""

    def __init__(self, items: Items, n_words: int, percent: int):
        self.shingler, self.percent, self.items = Shingler(n_words), percent, items
        self.by_width = items.by_width()

    def __call__(self, text: str | None) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items in a text."""
        for width, (sketch, owner) in self.by_width.items():
            if width < self.shingler.n and len(words(text)) < width:
                continue
            found = np.unique(self.shingler.in_order(text, width))
            if not len(found):
                continue
            at = np.searchsorted(found, sketch)
            at[at == len(found)] = 0
            for k in np.unique(owner[found[at] == sketch]):
                full = self.items.full(k)
                shared = len(np.intersect1d(full, found, assume_unique=True))
                if 100 * shared >= self.percent * len(full):
                    yield int(k), shared


def find_items(docs: DataFrame, items: DataFrame, n_words: int = 5, percent: int = 80, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of every pair that reaches the limit."""
    text_batches(docs.sparkSession)
    sketched = cut(item_sketches(items, n_words, percent), "items")
    total = sketched.agg(F.sum("size")).first()[0] or 0
    if total > broadcast_limit:
        return _by_join(docs, sketched, n_words, percent)
    known = docs.sparkSession.sparkContext.broadcast(Items(sketched.collect()))  # at most broadcast_limit shingles

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known.value, n_words, percent)
        for b in batches:
            rows = [
                (None if null else doc_id, scanner.items.ids[k], len(scanner.items.full(k)), shared)
                for doc_id, null, text in zip(b["doc_id"], b["null_id"], b["text"], strict=True)
                for k, shared in scanner(text)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "item_shingles", "shared_shingles"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.col("text").cast("string").alias("text"))
    hits = slim.mapInPandas(run, "doc_id long, item_id long, item_shingles long, shared_shingles long")
    return hits.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def _by_join(docs: DataFrame, sketched: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The same result with both sides joined on shingle hashes; rows get a key of their own first.

    A bitmap of the sketches clears nearly all shingles of the documents where they are read; a frequent one is dealt
    over several tasks.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n_words)
        for b in small(batches):
            found = [(row, width, np.unique(shingler.in_order(text, width)).view(np.int64)) for row, text in zip(b["row"], b["text"], strict=True) for width in widths if width == n_words or len(words(text)) >= width]
            size = [len(g) for _, _, g in found]
            yield pd.DataFrame({"row": np.repeat([r for r, _, _ in found], size).astype(np.int64), "width": np.repeat([w for _, w, _ in found], size).astype(np.int32), "g": np.concatenate([g for _, _, g in found] or [np.empty(0, np.int64)])})

    key = ["width", "g"]
    widths = [r.width for r in sketched.select("width").distinct().collect()]  # at most n_words values
    numbered = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = cut(sketched.withColumn("item", F.monotonically_increasing_id()), "keyed-items")
    sketch = cut(keyed.select("item", "width", F.explode("sketch").alias("g")), "sketches")
    grams = cut(among(numbered.select("row", "text").mapInPandas(run, "row long, width int, g long"), sketch.select(*key).distinct(), key), "grams")
    hot = cut(hot_keys(grams, key, hot_limit(grams.count())), "hot-shingles")
    candidates = cut(spread_join(grams, sketch, key, hot).select("row", "item").distinct(), "candidates")
    chosen = numbered.select("row", "text").join(candidates.select("row").distinct(), "row", "left_semi").mapInPandas(run, "row long, width int, g long")
    full = keyed.select("item", "item_id", "size", "width", F.explode("shingles").alias("g"))
    wanted = candidates.join(full, "item")
    hits = chosen.join(wanted, ["row", *key]).groupBy("row", "item").agg(F.first("item_id").alias("item_id"), F.first("size").cast("long").alias("item_shingles"), F.count(F.lit(1)).alias("shared_shingles"))
    hits = hits.filter(f"100 * shared_shingles >= {percent} * item_shingles").join(numbered.select("row", "doc_id"), "row")
    return hits.select("doc_id", "item_id", "item_shingles", "shared_shingles", (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows without a doc_id can't be named and stay."""
    hits = find_items(docs, items, n_words, percent).select("doc_id").distinct()
    # The caller's columns travel in one struct, so no name of theirs can clash with one used here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    return without(own, cut(hits, "hits"), ["doc_id"]).select("_row.*")
