"""Batch retrieval: every operator takes a table of queries, never one query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.evidence import CARD
from quarry.operators.numbering import numbered
from quarry.session import text_batches, written

RRF_K = 60
BOOST = 0.05
MATERIAL_HOP, UNIT_HOP = 5, 20
KEYWORDS, SIBLINGS = 8, 4
# Order of material types among siblings; others come last.
TYPE_ORDER = {"document": 0, "project": 1, "dataset": 2, "code": 3}


def ranked(scores: DataFrame, query: str, point: str, limit: int, score: str = "score") -> DataFrame:
    """Best ``limit`` points per query; ties by key. Spark cuts each task's list before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), point)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def sparse_scores(points: DataFrame, queries: DataFrame, query: str, point: str) -> DataFrame:
    """Dot products of raw counts over shared indices.

    Query postings are a batch, so the join picks its own strategy: broadcast while they are small.
    """
    q = queries.select(query, "idx", F.col("tf").alias("qtf"))
    return points.join(q, "idx").groupBy(query, point).agg(F.sum(F.col("qtf") * F.col("tf")).alias("score"))


def cosine_scores(points: DataFrame, queries: DataFrame, query: str, point: str) -> DataFrame:
    """Cosine of hashed vectors by an equi-join on the dimension; zero scores give no row."""
    q = queries.select(query, "idx", F.col("tf").alias("qtf"), F.col("norm2").alias("qnorm2"))
    dots = points.join(q, "idx").groupBy(query, point).agg(F.sum(F.col("qtf") * F.col("tf")).alias("dot"), F.first("norm2").alias("n"), F.first("qnorm2").alias("m"))
    return dots.select(query, point, (F.col("dot") / F.sqrt((F.col("n") * F.col("m")).cast("double"))).alias("score"))


def fuse(lists: list[DataFrame], query: str, point: str, limit: int, offset: int = 0, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, then offset and limit."""
    parts = [x.select(query, point, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = ranked(union.groupBy(query, point).agg(F.sum("part").alias("score")), query, point, offset + limit)
    return fused.filter(F.col("rank") > offset)


def prefetch(limit: int, offset: int = 0) -> int:
    return max((offset + limit) * 4, 20)


def restrict(units: DataFrame, hop1: DataFrame, query: str, material: str) -> DataFrame:
    """Unit scores inside each query's first-hop materials; queries without any are unrestricted."""
    inside = units.join(hop1.select(query, material), [query, material], "left_semi")
    return inside.unionByName(units.join(hop1.select(query).distinct(), query, "left_anti"))


def boost_same_source(hits: DataFrame, query: str, source: str, limit: int, boost: float = BOOST) -> DataFrame:
    """Hits of the top hit's source gain ``boost``; stable re-sort, then cut."""
    top = F.first(source).over(Window.partitionBy(query).orderBy("rank"))
    lifted = hits.withColumn("score", F.col("score") + F.when(F.col(source) == top, boost).otherwise(0.0)).withColumnRenamed("rank", "old")
    again = lifted.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "old")))
    return again.filter(F.col("rank") <= limit).drop("old")


def diverse(hits: DataFrame, query: str, material: str, per_material: int) -> DataFrame:
    """At most ``per_material`` hits per query and material, in rank order."""
    nth = F.row_number().over(Window.partitionBy(query, material).orderBy("rank"))
    return hits.withColumn("nth", nth).filter(F.col("nth") <= per_material).drop("nth")


def rerank(hits: DataFrame, scores: DataFrame, query: str, point: str) -> DataFrame:
    """New scores, stable descending sort; a query keeps its order if it has fewer than two hits or a hit
    without a score."""
    found = hits.join(scores.select(query, point, F.col("score").alias("new")), [query, point], "left")
    w = Window.partitionBy(query)
    usable = (F.count(F.lit(1)).over(w) >= 2) & (F.count("new").over(w) == F.count(F.lit(1)).over(w))
    found = found.withColumn("usable", usable).withColumn("score", F.when(F.col("usable"), F.col("new")).otherwise(F.col("score")))
    order = Window.partitionBy(query).orderBy(F.when(F.col("usable"), F.col("score")).desc_nulls_last(), "rank")
    return found.withColumn("new_rank", F.row_number().over(order)).drop("new", "usable", "rank").withColumnRenamed("new_rank", "rank")


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank_with(hits: DataFrame, query_text: DataFrame, point_text: DataFrame, query: str, point: str, scorer: Scorer | None = None, build: Callable[[], Scorer] | None = None) -> DataFrame:
    """Rerank hook: ``scorer(query texts, unit texts)`` runs in Arrow batches; texts are clipped to 2048.

    A scorer that is dear to make, such as a model, is given as ``build``, which makes it: once in every worker and task, for all
    batches of it. The hits are written once, so that the search behind them runs once for their pairs and their order.
    """
    make = build or (lambda: scorer)
    text_batches(hits.sparkSession)
    hits = written(hits.sparkSession, hits, "hits")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = make()
        for asked, found in batches:
            yield own(asked, found)

    score = F.pandas_udf(run, "double")
    pairs = hits.select(query, point).join(query_text, query).join(point_text, point)
    return rerank(hits, pairs.select(query, point, score(F.substring("query_text", 1, 2048), F.substring("point_text", 1, 2048)).alias("score")), query, point)


def material_detail(materials: DataFrame, analyses: DataFrame, units: DataFrame, material: str) -> DataFrame:
    """A row per unit of every material, numbered in order (one row with null unit for a material without any): title, type, path
    and status of the material, what its analysis says, unit_no, unit_type and citation of the unit. Its card is no unit.

    materials(material, name, material_type, subtype, root_path, status), analyses(material, title, summary, purpose, keywords, topics,
    technologies, relevance), units(material, pos, unit, unit_type, path, page, line_start, line_end). Units stay rows, so a
    material may have any number of them.
    """
    own = units.filter(F.col("unit") != CARD).select(material, "pos", "unit_type", T.format_location("path", "page", "line_start", "line_end").alias("citation"))
    placed = numbered(own, [material], ["pos"], "unit_no").drop("pos")
    none = F.array().cast("array<string>")
    j = materials.join(analyses, material, "left").join(placed, material, "left")
    return j.select(
        material, F.coalesce(F.nullif("title", F.lit("")), "name").alias("title"), "material_type", "subtype", "root_path", "status", F.coalesce("summary", F.lit("")).alias("summary"), "purpose",
        *[F.coalesce(c, none).alias(c) for c in ("keywords", "topics", "technologies")], "relevance", "unit_no", "unit_type", "citation",
    )


def enrich(hits: DataFrame, materials: DataFrame, analyses: DataFrame, material: str) -> DataFrame:
    """Hits with their material's type and root path (empty for an unknown one), the snippet of its analysis' summary or
    else of the hit's content, and the first eight keywords of the analysis.

    hits(material, content, ...), materials(material, material_type, root_path), analyses(material, summary, keywords).
    """
    known = materials.select(material, F.coalesce("material_type", F.lit("")).alias("material_type"), "root_path")
    read = analyses.select(material, F.lit(True).alias("_read"), F.col("summary").alias("_summary"), F.slice("keywords", 1, KEYWORDS).alias("_keywords"))
    rich = hits.join(known, material, "left").join(read, material, "left")
    rich = rich.withColumn("snippet", F.when(F.col("_read"), T.clip("_summary")).otherwise(T.clip("content"))).withColumn("keywords", F.coalesce("_keywords", F.array().cast("array<string>")))
    return rich.na.fill("", ["material_type", "root_path"]).drop("_read", "_summary", "_keywords")


def siblings(materials: DataFrame, material: str, source: str) -> DataFrame:
    """(material, siblings): root paths of the other READY materials of its source by type and path, the first four and
    ``+N more``.

    materials(material, source, material_type, root_path, status). Only five rows a source are gathered: its
    first five READY materials hold the first four others of any of them; the rest is a count.
    """
    rank = F.coalesce(*[F.when(F.col("material_type") == t, F.lit(i)) for t, i in TYPE_ORDER.items()], F.lit(9))
    ready = materials.filter("lower(status) = 'ready'").select(source, material, "root_path", rank.alias("_rank"))
    order = Window.partitionBy(source).orderBy("_rank", "root_path", material)
    first = ready.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SIBLINGS + 1)
    listed = first.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(material).alias("m"), F.col("root_path").alias("p")))).alias("_l"))
    total = ready.groupBy(source).agg(F.count(F.lit(1)).alias("_t"))
    own = materials.select(material, source, (F.lower("status") == "ready").alias("_ready")).join(listed, source, "left").join(total, source, "left")
    names = F.transform(F.filter("_l", lambda x: x["m"] != F.col(material)), lambda x: x["p"])
    others = F.col("_t") - F.coalesce(F.col("_ready").cast("int"), F.lit(0))
    more = F.when(others > SIBLINGS, F.array(F.concat(F.lit("+"), (others - SIBLINGS).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return own.select(material, F.coalesce(F.concat(F.slice(names, 1, SIBLINGS), more), F.array().cast("array<string>")).alias("siblings"))


def page(hits: DataFrame, query: str, offset: int, limit: int) -> DataFrame:
    """One page of each query's window with total, pages and has_more."""
    total = F.count(F.lit(1)).over(Window.partitionBy(query))
    counted = hits.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / limit).cast("long"))
    return counted.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


#: Queries that a matrix product takes at once.
STEP = 64


def dense_topk(points: DataFrame, queries: DataFrame, limit: int, block: int = 512, part: int = 20_000) -> DataFrame:
    """Exact cosine search of ``queries(query_id, vector)`` over ``points(point_id, vector)``.

    Points are dealt into parts and queries into blocks; each (part, block) pair is one matrix product
    that keeps the best of each query, and the parts' lists are merged by rank. Both counts grow with their
    table, no side is broadcast, and what leaves a pair is at most ``limit`` rows a query.
    """
    n_parts = max(1, -(-points.count() // part))
    n_blocks = max(1, -(-queries.count() // block))
    # Every part meets every block, so both sides are replicated to their pairs.
    p = points.select("point_id", "vector", F.pmod(F.xxhash64("point_id"), F.lit(n_parts)).cast("int").alias("part"))
    p = p.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "point_id": [], "score": []}
        if len(own) and len(asked):
            ids = own["point_id"].to_numpy()
            a = np.stack(own["vector"].to_numpy()).astype(np.float64)
            norm = np.sqrt((a * a).sum(axis=1))
            for at in range(0, len(asked), STEP):
                some = asked.iloc[at : at + STEP]
                b = np.stack(some["vector"].to_numpy()).astype(np.float64)
                score = np.round((b @ a.T) / (np.sqrt((b * b).sum(axis=1))[:, None] * norm[None, :]), 6)
                for i, query_id in enumerate(some["query_id"]):
                    top = np.lexsort((ids, -score[i]))[:limit]
                    out["query_id"] += [query_id] * len(top)
                    out["point_id"] += ids[top].tolist()
                    out["score"] += score[i][top].tolist()
        return pd.DataFrame(out)

    found = p.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInPandas(best, "query_id long, point_id long, score double")
    return ranked(found, "query_id", "point_id", limit)
