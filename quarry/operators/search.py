"""Batch search: every text scored against every query inside its own task, best rows only leaving it.

Points and queries are embedded by the same function: ``embed(texts)`` returns a matrix of dense vectors (one
row a text) and a list of sparse vectors (indices, values). :class:`HashedEmbedder` is the built-in one.
Queries are broadcast, the points are read where they are, and a task keeps ``n`` points per query and list; nothing is
shuffled but these. A query set of more than ``QUERY_VALUES`` values goes in blocks of that size: its vectors are
computed in tasks and written, so are those of the points, once, and each block is one scan of them.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieve
from quarry.session import scratch_dir, text_batches

Sparse = tuple[np.ndarray, np.ndarray]
Embed = Callable[[list[str]], tuple[np.ndarray, list[Sparse]]]
QUERY_VALUES = 5_000_000
CACHE_TOKENS, CACHE_CHARS = 200_000, 4_000_000
ROWS = 256
LISTS = ("dense", "sparse")
PATTERN, STOP = re.compile(T.TOKEN), frozenset(T.TOKEN_STOP)

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class HashedEmbedder:
    """Counts of hashed tokens: 1,024 dense dimensions, 250,002 sparse ones."""

    def __init__(self, dense: int = T.DENSE_DIM, sparse: int = T.SPARSE_DIM):
        self.dense, self.sparse = dense, sparse
        self.cache: dict[str, int] = {}
        self.chars = 0

    def numbers(self, text: str) -> np.ndarray:
        """First four bytes of the SHA-256 of every token."""
        cache, found = self.cache, PATTERN.findall(text.lower())
        for token in set(found).difference(cache):
            cache[token] = -1 if token in STOP else int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big")
            self.chars += len(token)
        out = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
        if len(cache) > CACHE_TOKENS or self.chars > CACHE_CHARS:  # nothing stays of a text with very many or very long tokens
            cache.clear()
            self.chars = 0
        return out[out >= 0]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[Sparse]]:
        dense, sparse = np.zeros((len(texts), self.dense)), []
        for i, text in enumerate(texts):
            found = self.numbers(text)
            dense[i] = np.bincount(found % self.dense, minlength=self.dense)
            at, n = np.unique(found % self.sparse, return_counts=True)
            sparse.append((at, n.astype(np.float64)))
        return dense, sparse


class Queries:
    """Vectors of a batch of queries, ready to score points."""

    def __init__(self, ids: list, dense: np.ndarray, sparse: list[Sparse], allowed: dict[object, np.ndarray] | None, free: np.ndarray | None):
        self.ids, self.dense, self.allowed, self.free = ids, dense, allowed, free
        self.norm2 = (dense * dense).sum(axis=1)
        # Inverted lists: of each sparse index that a query has, the queries and their values.
        at = np.concatenate([np.full(len(i), k) for k, (i, _) in enumerate(sparse)] or [np.empty(0, np.int64)]).astype(np.int64)
        idx = np.concatenate([i for i, _ in sparse] or [np.empty(0, np.int64)])
        val = np.concatenate([v for _, v in sparse] or [np.empty(0)])
        order = np.argsort(idx, kind="stable")
        self.at, self.val = at[order], val[order]
        self.idx, first = np.unique(idx[order], return_index=True)
        self.ends = np.append(first, len(idx))

    def dense_scores(self, points: np.ndarray) -> np.ndarray:
        dots, norm2 = points @ self.dense.T, (points * points).sum(axis=1)
        scale = np.sqrt(norm2[:, None] * self.norm2[None, :])
        return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)

    def sparse_scores(self, points: list[Sparse]) -> np.ndarray:
        out = np.zeros((len(points), len(self.ids)))
        for i, (idx, val) in enumerate(points):
            place = np.searchsorted(self.idx, idx)
            place[place == len(self.idx)] = 0
            met = np.flatnonzero(self.idx[place] == idx) if len(self.idx) else []
            if len(met):
                first, n = self.ends[place[met]], np.diff(self.ends)[place[met]]
                rows = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                out[i] = np.bincount(self.at[rows], self.val[rows] * np.repeat(val[met], n), minlength=len(self.ids))
        return out

    def mask(self, groups: list) -> np.ndarray:
        """Which query may meet which point, by the points' groups."""
        out = np.zeros((len(groups), len(self.ids)), bool)
        out[:, self.free] = True
        for i, group in enumerate(groups):
            if group in self.allowed:
                out[i, self.allowed[group]] = True
        return out


class Best:
    """The ``n`` best points per query so far; ties go to the smaller point."""

    def __init__(self, n_queries: int, n: int):
        self.n, self.limit = n, np.full(n_queries, 0.0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, points: np.ndarray) -> None:
        row, query = np.nonzero((scores > 0) & (scores >= self.limit[None, :]))
        self.held.append((query, scores[row, query], points[row]))
        self.size += len(row)
        if self.size > 8 * self.n * len(self.limit) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, point = (np.concatenate(x) for x in zip(*self.held, strict=True))
        _, place = np.unique(point, return_inverse=True)
        order = np.lexsort((place, -score, query))
        query, score, point = query[order], score[order], point[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.n
        last = nth == self.n - 1
        self.limit[query[last]] = score[last]
        self.held = [(query[keep], score[keep], point[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def embedded(queries: DataFrame, query: str, text: str, embed: Embed) -> tuple[list, np.ndarray, list[Sparse]] | None:
    """Ids and vectors of the queries in order of their ids, or None if they are more than one block."""
    n = queries.count()
    size = queries.agg(F.sum(F.length(text))).first()[0] or 0
    if n * T.DENSE_DIM + size > QUERY_VALUES:
        return None
    rows = queries.select(query, F.coalesce(text, F.lit("")).alias("t")).orderBy(query).collect()  # at most QUERY_VALUES characters
    return [r[0] for r in rows], *embed([r.t for r in rows])


#: Vectors as lists of what is not zero.
VECTORS = "width int, di array<int>, dv array<double>, si array<bigint>, sv array<double>"


def vectors(rows: DataFrame, text: str, embed: Embed) -> DataFrame:
    """The other columns of ``rows`` and the vectors of ``text``, written once."""
    keys = [c for c in rows.columns if c != text]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                dense, sparse = embed(list(part[text]))
                places = [np.flatnonzero(d) for d in dense]
                yield part[keys].assign(width=dense.shape[1], di=[p.astype(np.int32) for p in places], dv=[d[p].astype(np.float64) for d, p in zip(dense, places, strict=True)], si=[i.astype(np.int64) for i, _ in sparse], sv=[v.astype(np.float64) for _, v in sparse])

    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), VECTORS]))
    path = scratch_dir(rows.sparkSession, "vectors")
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def unpacked(part: pd.DataFrame) -> tuple[np.ndarray, list[Sparse]]:
    dense = np.zeros((len(part), int(part["width"].max()) if len(part) else 0))
    for i, (at, v) in enumerate(zip(part["di"], part["dv"], strict=True)):
        dense[i, at] = v
    return dense, list(zip(part["si"], part["sv"], strict=True))


def top_points(points: DataFrame, point: str, text: str, queries: DataFrame, query: str, asked: str, n: int, embed: Embed | None = None, group: str | None = None, hop1: DataFrame | None = None, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """The best ``n`` points of every query by cosine of the dense vectors (list ``dense``) and by dot product of the
    sparse ones (``sparse``): query, point, list, score, rank. Scores of 0 give no row.

    With ``hop1(query, group)`` a query meets only points of its groups; a query without any meets all.
    """
    embed = embed or HashedEmbedder()
    text_batches(points.sparkSession)
    slim = points.select(F.col(point).alias("point"), F.coalesce(text, F.lit("")).alias("text"), (F.col(group) if group else F.lit(None).cast("string")).alias("grp")).filter("point is not null")
    kinds = dict(points.dtypes) | dict(queries.dtypes)
    schema = f"{query} {kinds[query]}, {point} {kinds[point]}, list string, score double"
    found = embedded(queries, query, asked, embed)
    if found is not None:
        rows = _scan(slim, found, _allowed(found[0], hop1, query, group), n, lists, query, point, schema, lambda part: embed(list(part["text"])))
        return _ranked(rows, query, point, n)
    spark = points.sparkSession
    own = vectors(queries.select(query, F.coalesce(asked, F.lit("")).alias("_text")), "_text", embed)
    total = own.agg(F.sum(F.col("width") + F.size("si"))).first()[0]
    blocks = -(-total // QUERY_VALUES)
    held, path = vectors(slim, "text", embed), scratch_dir(spark, "best")
    numbered = own.withColumn("_block", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int"))
    for k in range(blocks):
        block = numbered.filter(F.col("_block") == k)
        part = block.orderBy(query).toPandas()  # about QUERY_VALUES values
        if len(part):
            ids = part[query].tolist()
            near = hop1.join(block.select(query), query, "left_semi") if hop1 is not None else None
            rows = _scan(held, (ids, *unpacked(part)), _allowed(ids, near, query, group), n, lists, query, point, schema, unpacked)
            _ranked(rows, query, point, n).write.mode("append").parquet(path)
    return spark.read.schema(schema + ", rank int").parquet(path)


def _allowed(ids: list, hop1: DataFrame | None, query: str, group: str | None) -> tuple[dict | None, np.ndarray | None]:
    """Places of the queries that may meet each group, and of those that may meet all."""
    if hop1 is None:
        return None, None
    number = {x: i for i, x in enumerate(ids)}
    rows = [(number[r[0]], r[1]) for r in hop1.select(query, group).collect() if r[0] in number]  # a few groups per query
    by_group: dict[object, set[int]] = {}
    for i, g in rows:
        by_group.setdefault(g, set()).add(i)
    return {g: np.array(sorted(own)) for g, own in by_group.items()}, np.setdiff1d(np.arange(len(ids)), [i for i, _ in rows])


def _scan(rows: DataFrame, found: tuple, met: tuple, n: int, lists: tuple[str, ...], query: str, point: str, schema: str, embed: Callable[[pd.DataFrame], tuple[np.ndarray, list[Sparse]]]) -> DataFrame:
    """One pass over rows(point, grp, ...): each task's best points of the broadcast queries."""
    known = rows.sparkSession.sparkContext.broadcast((*found, *met))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = Queries(*known.value)
        best = {name: Best(len(asked.ids), n) for name in lists}
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at : at + ROWS]
                own_dense, own_sparse = embed(part)
                mask = asked.mask(list(part["grp"])) if asked.allowed is not None else 1
                own = part["point"].to_numpy()
                for name, held in best.items():
                    held.add((asked.dense_scores(own_dense) if name == "dense" else asked.sparse_scores(own_sparse)) * mask, own)
        for name, held in best.items():
            if held.held:
                number, score, own = held.cut()
                yield pd.DataFrame({query: [asked.ids[i] for i in number], point: own, "list": name, "score": score})

    return rows.mapInPandas(run, schema)


def _ranked(rows: DataFrame, query: str, point: str, n: int) -> DataFrame:
    order = Window.partitionBy("list", query).orderBy(F.desc("score"), point)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hybrid(points: DataFrame, point: str, text: str, queries: DataFrame, query: str, asked: str, limit: int, offset: int = 0, embed: Embed | None = None, group: str | None = None, hop1: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of the dense and the sparse list: query, point, score, rank."""
    lists = top_points(points, point, text, queries, query, asked, retrieve.prefetch(limit, offset), embed, group, hop1)
    return retrieve.fuse([lists], query, point, limit, offset)


def two_hop(units: DataFrame, unit: str, text: str, cards: DataFrame, material: str, card: str, queries: DataFrame, query: str, asked: str, limit: int = 20, embed: Embed | None = None) -> DataFrame:
    """Hop 1: the five best materials by their cards. Hop 2: the best units (20 at most) inside these, or among all for a
    query that no card meets. Both hops are hybrid searches."""
    hop1 = hybrid(cards, material, card, queries, query, asked, retrieve.MATERIAL_HOP, embed=embed).select(query, material)
    return hybrid(units, unit, text, queries, query, asked, min(max(limit, 1), retrieve.UNIT_HOP), embed=embed, group=material, hop1=hop1)
