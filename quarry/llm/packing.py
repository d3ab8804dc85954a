"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

The plan is made on the histogram of piece lengths (at most ``max(capacities)`` rows, whatever the number
of documents). For a mix of sizes it is exactly best-fit decreasing over all pieces: equal lengths are
placed in bulk, an interval of equal bins at a time; if no open bin holds a piece, the size of the mix with
the least cost per token is opened, counting what the rest of the histogram could put into it (or only what
pieces of the same length could: ``optimistic`` or not); at the end each bin shrinks to the smallest
permitted length that holds its contents. The sizes are chosen jointly: every mix of permitted lengths is
planned under both rules, and the plan of least total cost is used. It is never dearer than the best plan
with a single size, which is one of them.

Spark counts lengths, numbers the pieces of each length (hot lengths are salted: numbers are given inside
(length, salt) groups of bounded size and shifted by the counts before) and looks every piece's bin
up by length and number.

``pack`` counts tokens with the automaton of :mod:`quarry.llm.wordpiece` plus one end token; ``pack_files`` takes the
documents of token files and returns whole sequences with their ids and boundaries. Documents longer than
the largest capacity are cut into pieces of that capacity and a rest. Nothing is dropped: a null or empty text
is one end token, a null doc_id is kept, repeated rows are packed one by one, an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokenfiles, wordpiece
from quarry.llm.shared import cut, hot_limit

CAPACITIES = (512, 1024, 2048, 4096)


def default_cost(capacity: int) -> float:
    """Cost of a sequence: its tokens, attention's share that grows with the square, and a fixed overhead."""
    return capacity + capacity * capacity / 16384 + 64.0


class Remaining:
    """The histogram of pieces that are not placed yet, by falling length."""

    def __init__(self, histogram: dict[int, int]):
        self.lengths = sorted(histogram)
        self.counts = [histogram[n] for n in self.lengths]

    def fill(self, capacity: int, length: int, todo: int) -> int:
        """Tokens that an empty bin takes: pieces of ``length`` first, then always the longest that fits."""
        k = min(todo, capacity // length)
        room, i = capacity - k * length, bisect_left(self.lengths, length)
        while room and i:
            i = min(i, bisect_right(self.lengths, room, 0, i)) - 1
            if i < 0:
                break
            room -= min(self.counts[i], room // self.lengths[i]) * self.lengths[i]
        return capacity - room


def mix_plan(histogram: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float], optimistic: bool) -> tuple[list[tuple], list[tuple[int, int, int, int]]]:
    """(placements, intervals of bins) of best-fit decreasing with the bin sizes of one mix."""
    rest = Remaining(histogram)
    open_bins: list[tuple[int, int, int, int]] = []  # (remaining, first bin, number of bins, used), sorted
    places, next_bin = [], 0

    def put(length: int, first: int, k: int, remaining: int, at: int, n: int, used: int) -> None:
        """k pieces into an interval of n bins; what is left of each part stays open."""
        each = remaining // length
        whole, more = divmod(k, each)
        if whole:
            places.append((length, first, first + whole * each, at, each, used))
            insort(open_bins, (remaining - each * length, at, whole, used + each * length))
        if more:
            places.append((length, first + whole * each, first + k, at + whole, more, used))
            insort(open_bins, (remaining - more * length, at + whole, 1, used + more * length))
        if left := n - whole - bool(more):
            insort(open_bins, (remaining, at + whole + bool(more), left, used))

    for length in sorted(histogram, reverse=True):
        todo, number = histogram[length], 0
        fitting = [c for c in sizes if c >= length]
        while todo:
            i = bisect_left(open_bins, (length,))
            if i < len(open_bins):
                remaining, at, n, used = open_bins.pop(i)
                k = min(todo, n * (remaining // length))
                put(length, number, k, remaining, at, n, used)
            else:
                filled = lambda c: rest.fill(c, length, todo) if optimistic else min(todo, c // length) * length  # noqa: E731, B023
                size = min(fitting, key=lambda c: (cost(c) / filled(c), c))
                each = size // length
                # As long as enough pieces are left to fill any size with them, the next bins are opened alike.
                bins = max(1, (todo - fitting[-1] // length) // each)
                k = min(todo, bins * each)
                put(length, number, k, size, next_bin, bins, 0)
                next_bin += bins
            todo, number = todo - k, number + k
    return places, [(at, at + n, used, used + remaining) for remaining, at, n, used in open_bins]


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> tuple[list[tuple], list[tuple], tuple]:
    """(placements, bins, mix) for ``{length: count}``: the cheapest plan over all mixes of sizes.

    A placement (length, first, last, bin, per_bin, used) puts the pieces numbered first..last-1 of that
    length into bins from ``bin`` on, ``per_bin`` each, behind ``used`` tokens. A bin row (bin, last_bin,
    used, capacity) describes the bins of an interval after they were downsized. ``mix`` is (sizes, optimistic).
    """
    capacities, longest = sorted(capacities), max(histogram, default=0)
    best = None
    for k in range(1, len(capacities) + 1):
        for sizes in combinations(capacities, k):
            if sizes[-1] >= longest:
                for optimistic in (True, False) if k > 1 else (False,):
                    places, opened = mix_plan(histogram, sizes, cost, optimistic)
                    bins = sorted((at, end, used, capacities[bisect_left(capacities, used)]) for at, end, used, _ in opened)
                    total = sum((end - at) * cost(c) for at, end, _, c in bins)
                    if best is None or total < best[0]:
                        best = total, places, bins, (sizes, optimistic)
    return best[1:]


def _lookup(places: list[tuple], bins: list[tuple]) -> dict[int, list[tuple]]:
    """Per length its placements with the bins they reach: (first, last, bin, per_bin, used, [(last_bin, used, capacity)])."""
    starts, by_length = [b[0] for b in bins], {}
    for length, first, last, at, per_bin, used in places:
        end = at + -(-(last - first) // per_bin)
        reached = bins[bisect_right(starts, at) - 1 : bisect_left(starts, end)]
        by_length.setdefault(length, []).append((first, last, at, per_bin, used, [tuple(b[1:]) for b in reached]))
    return by_length


def pack_lengths(rows: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """``rows(n, ...)``, a document of ``n`` tokens each, cut into pieces and packed: the other columns with piece,
    start, n_tokens, bin_id, bin_offset, bin_used, bin_capacity."""
    longest, names = max(capacities), [c for c in rows.columns if c != "n"]
    cutting = rows.filter("n > 0").select(*names, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))).alias("piece"))
    length = F.least(F.lit(longest), F.expr(f"n - piece * {longest}")).cast("long")
    cut_up = cut(cutting.select(*names, F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), length.alias("n_tokens"), F.monotonically_increasing_id().alias("_row")), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in cut_up.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max(capacities) rows
    places, bins, _ = plan(histogram, capacities, cost)
    # The table follows from the histogram: its size is bounded by the capacities, not by the documents.
    limit = hot_limit(sum(histogram.values()))
    known = [(k, -(-histogram[k] // limit), v) for k, v in _lookup(places, bins).items()]
    schema = "n_tokens long, salts int, places array<struct<first:long,last:long,bin:long,per_bin:long,used:long,bins:array<struct<last_bin:long,used:long,capacity:long>>>>"
    table = rows.sparkSession.createDataFrame(known, schema)
    salted = cut_up.join(F.broadcast(table.select("n_tokens", "salts")), "n_tokens").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int"))
    counts = salted.groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("n"))  # at most max(capacities) + MOST_HOT rows
    before = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("n_tokens", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("n_tokens", "_salt").orderBy("_row")
    numbered = salted.withColumn("number", F.row_number().over(inside) - 1).join(F.broadcast(shift), ["n_tokens", "_salt"]).withColumn("number", F.col("number") + F.col("shift"))
    placed = numbered.join(F.broadcast(table.select("n_tokens", "places")), "n_tokens").withColumn("p", F.expr("filter(places, x -> x.first <= number and number < x.last)[0]"))
    placed = placed.select(
        *names, "piece", "start", "n_tokens", "p.bins",
        F.expr("p.bin + (number - p.first) div p.per_bin").alias("bin_id"),
        F.expr("p.used + (number - p.first) % p.per_bin * n_tokens").alias("bin_offset"),
    )
    own = placed.withColumn("b", F.expr("filter(bins, x -> bin_id < x.last_bin)[0]"))
    return own.select(*names, "piece", "start", "n_tokens", "bin_id", "bin_offset", F.col("b.used").alias("bin_used"), F.col("b.capacity").alias("bin_capacity"))


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_used, bin_capacity of every piece of ``docs(doc_id, text)``."""
    counted = wordpiece.token_counts(docs, vocabulary)
    return pack_lengths(counted.select("doc_id", (F.col("n_tokens") + 1).alias("n")), capacities, cost)


def pack_files(manifest: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """Sequences of the documents in token files (:func:`quarry.llm.tokenfiles.write`), one row a bin: bin_id, bin_capacity,
    bin_used, ids (little-endian uint32, bin_used of them), pieces (doc_id, start in the document, offset, n_tokens).

    A bin's pieces are gathered: at most ``max(capacities)`` ids.
    """
    found = tokenfiles.read(manifest)  # ``start``, the ids before a document, tells documents apart
    packed = pack_lengths(found.select("doc_id", F.col("start").alias("at"), F.col("n_tokens").alias("n")), capacities, cost)
    ids = packed.join(found.select(F.col("start").alias("at"), "ids"), "at").withColumn("part", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * n_tokens as int))"))
    listed = F.array_sort(F.collect_list(F.struct("bin_offset", "part", "doc_id", "start", "n_tokens")))
    bins = ids.groupBy("bin_id", "bin_capacity", "bin_used").agg(listed.alias("l"))
    joined = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    pieces = F.transform("l", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["bin_offset"].alias("offset"), x["n_tokens"].alias("n_tokens")))
    return bins.select("bin_id", "bin_capacity", "bin_used", joined.alias("ids"), pieces.alias("pieces"))
