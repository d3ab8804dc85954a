"""Queries over the hashed index: documents are units, benchmark items are queries.

Material of a document: its source and language (``source/lang``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index, profile, retrieve, search
from quarry.operators.corpus import mapped
from quarry.operators.evidence import CARD
from quarry.plans import profile as profile_plans
from quarry.plans.common import bucket_sql, clip_sql, query, tokens_sql
from quarry.session import table, written

def _material() -> Column:
    return F.concat_ws("/", "source", "lang")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("asked"))


def _top(spark: SparkSession, sf_dir: str, name: str, n: int) -> DataFrame:
    """The best ``n`` documents of every item in one list."""
    return search.top_points(_docs(spark, sf_dir), "doc_id", "text", _items(spark, sf_dir), "item_id", "asked", n, lists=(name,)).drop("list")


def _hybrid(spark: SparkSession, sf_dir: str, limit: int, docs: DataFrame | None = None) -> DataFrame:
    """Fused ranks; ``docs`` restricts both prefetches before they rank."""
    return search.hybrid(_docs(spark, sf_dir) if docs is None else docs, "doc_id", "text", _items(spark, sf_dir), "item_id", "asked", limit)


def posts_sql(dim: int, name: str, tbl: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, {bucket_sql('token', dim)} AS idx, count(*) AS tf
  FROM (SELECT {key}, unnest({tokens_sql('text')}) AS token FROM {tbl}) GROUP BY ALL)"""


def scores_sql(p: str = "", points: str = "documents", key: str = "doc_id") -> str:
    """CTEs ``{p}sparse`` and ``{p}dense`` with item_id, key, score."""
    return f"""{posts_sql(T.SPARSE_DIM, p + 'sp', points, key)}, {posts_sql(T.SPARSE_DIM, p + 'sq', 'benchmark', 'item_id')},
{p}sparse AS (SELECT item_id, {key}, CAST(sum(sp.tf * sq.tf) AS BIGINT) AS score FROM {p}sp sp JOIN {p}sq sq USING (idx) GROUP BY ALL),
{posts_sql(T.DENSE_DIM, p + 'dp', points, key)}, {posts_sql(T.DENSE_DIM, p + 'dq', 'benchmark', 'item_id')},
{p}dpn AS (SELECT {key}, CAST(sum(tf * tf) AS BIGINT) AS n FROM {p}dp GROUP BY ALL), {p}dqn AS (SELECT item_id, CAST(sum(tf * tf) AS BIGINT) AS m FROM {p}dq GROUP BY ALL),
{p}dense AS (
  SELECT item_id, {key}, dot / sqrt((n * m)::DOUBLE) AS score
  FROM (SELECT item_id, {key}, CAST(sum(dp.tf * dq.tf) AS BIGINT) AS dot FROM {p}dp dp JOIN {p}dq dq USING (idx) GROUP BY ALL) JOIN {p}dpn USING ({key}) JOIN {p}dqn USING (item_id))"""


def rank_sql(source: str, limit: int, where: str = "", key: str = "doc_id") -> str:
    return f"SELECT * FROM (SELECT item_id, {key}, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {key}) AS rank FROM {source} {where}) WHERE rank <= {limit}"


def hybrid_sql(limit: int, where: str = "", p: str = "", points: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``{p}hits``: item_id, key, score, rank."""
    n = retrieve.prefetch(limit)
    return f"""{scores_sql(p, points, key)},
{p}lists AS (
  SELECT item_id, {key}, 1.0::DOUBLE / (60 + rank) AS part FROM ({rank_sql(p + 'dense', n, where, key)})
  UNION ALL SELECT item_id, {key}, 1.0::DOUBLE / (60 + rank) FROM ({rank_sql(p + 'sparse', n, where, key)})),
{p}fused AS (SELECT item_id, {key}, sum(part) AS score FROM {p}lists GROUP BY ALL),
{p}hits AS ({rank_sql(p + 'fused', limit, '', key)})"""


@query(f"WITH {scores_sql()} {rank_sql('sparse', 20)}")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: raw counts over shared hashed indices."""
    return _top(spark, sf_dir, "sparse", 20).withColumn("score", F.col("score").cast("long"))


@query(
    f"WITH {scores_sql()}, top AS ({rank_sql('dense', 10)}) SELECT item_id, doc_id, round(score, 9) AS score, rank, {clip_sql('text')} AS snippet FROM top JOIN documents USING (doc_id)"
)
def hashed_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3, FN4, JN2, FN10: cosine over hashed counts."""
    return _top(spark, sf_dir, "dense", 10).join(_docs(spark, sf_dir), "doc_id").select("item_id", "doc_id", F.round("score", 9).alias("score"), "rank", T.clip("text").alias("snippet"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS point_id,
         round(list_dot_product(q.e, p.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(p.e, p.e))), 6) AS score
  FROM v q, v p WHERE q.vec_id % 50 = 0)
SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2 over given vectors: every vector whose id is divisible by 50, against all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.dense_topk(v.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector")), asked, 10)


@query(f"WITH {hybrid_sql(10)} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM hits")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: dense and sparse lists fused by reciprocal rank."""
    return _hybrid(spark, sf_dir, 10).withColumn("score", F.round("score", 9))


@query(f"WITH {hybrid_sql(10)} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM hits")
def embedder_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1: the same search with an embedder of the caller's: any function of a list of texts."""
    plain = search.HashedEmbedder()

    def embed(texts: list[str]):
        return plain(texts)

    return search.hybrid(_docs(spark, sf_dir), "doc_id", "text", _items(spark, sf_dir), "item_id", "asked", 10, embed=embed).withColumn("score", F.round("score", 9))


WHERE_FILTER = "JOIN (SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3')) USING (doc_id)"


@query(f"WITH {hybrid_sql(10, WHERE_FILTER)} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM hits")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ9: the payload filter holds in both prefetches."""
    allowed = _docs(spark, sf_dir).filter((F.col("lang") == "en") & F.col("source").isin("src0", "src1", "src2", "src3"))
    return _hybrid(spark, sf_dir, 10, allowed).withColumn("score", F.round("score", 9))


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id, source, material_type (by language), root_path, status (a seventh failed)."""
    grouped = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "project").when(F.col("lang") == "fr", "dataset")
    return grouped.select(_material().alias("material_id"), "source", kind.alias("material_type"), _material().alias("root_path"), F.when(F.col("n") % 7 == 0, "failed").otherwise("ready").alias("status"))


MATERIALS_SQL = """materials AS (SELECT source || '/' || lang AS material_id, source, CASE lang WHEN 'en' THEN 'document' WHEN 'de' THEN 'project' WHEN 'fr' THEN 'dataset' END AS material_type,
  source || '/' || lang AS root_path, CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents GROUP BY source, lang)"""


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of all materials but the Spanish ones: summary and keywords."""
    units = _docs(spark, sf_dir).filter("lang <> 'es'").select(_material().alias("material_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = profile.summaries(profile.unit_heads(units, ["material_id"], "doc_id", "text"), ["material_id"], "doc_id")
    words = profile.material_keywords(units, "material_id", "doc_id", "text").select("material_id", F.col("terms").alias("keywords"))
    return found.join(words, "material_id", "left")


ANALYSES_SQL = f"""analyses AS (WITH {profile_plans.KEYWORDS}, {profile_plans.DIGEST},
  w AS (SELECT material_id, list(f[3] ORDER BY place) AS keywords FROM r WHERE place <= 80 GROUP BY material_id)
  SELECT material_id, {profile_plans.SUMMARY} AS summary, keywords FROM h LEFT JOIN w USING (material_id) WHERE material_id NOT LIKE '%/es')"""


@query(
    f"""WITH {hybrid_sql(100)}, {MATERIALS_SQL}, {ANALYSES_SQL}, counted AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM hits),
own AS (SELECT c.*, source || '/' || lang AS material_id, text FROM counted c JOIN documents USING (doc_id) WHERE rank > 20 AND rank <= 40)
SELECT item_id, doc_id, round(score, 9) AS score, rank, total, CAST(ceil(total / 20) AS BIGINT) AS pages, total > 40 AS has_more, material_id, coalesce(material_type, '') AS material_type, root_path,
       CASE WHEN a.material_id IS NOT NULL THEN {clip_sql('summary')} ELSE {clip_sql('text')} END AS snippet, array_to_string(coalesce(keywords[:8], []), '|') AS keywords
FROM own JOIN materials USING (material_id) LEFT JOIN analyses a USING (material_id)"""
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1, JN4: the second page of 20 of each query's window of 100, enriched with material and analysis."""
    hits = retrieve.page(_hybrid(spark, sf_dir, 100), "item_id", 20, 20).join(_docs(spark, sf_dir).select("doc_id", _material().alias("material_id"), F.col("text").alias("content")), "doc_id")
    rich = retrieve.enrich(hits, _materials(spark, sf_dir), _analyses(spark, sf_dir), "material_id").withColumn("keywords", F.array_join("keywords", "|"))
    return rich.select("item_id", "doc_id", F.round("score", 9).alias("score"), "rank", "total", "pages", "has_more", "material_id", "material_type", "root_path", "snippet", "keywords")


CARDS_SQL = f"""cards AS (WITH {profile_plans.KEYWORDS}, w AS (SELECT material_id, list(f[3] ORDER BY place) AS terms FROM r WHERE place <= 80 GROUP BY material_id)
  SELECT material_id, trim(array_to_string(list_concat([material_id], terms[:24], terms[:12]), ' ')) AS text FROM w)"""
INSIDE = """JOIN m USING (doc_id) WHERE (item_id, m.material_id) IN (SELECT (item_id, material_id) FROM c_hits) OR item_id NOT IN (SELECT item_id FROM c_hits)"""
TWO_HOP_SQL = f"""WITH {CARDS_SQL}, {hybrid_sql(5, p='c_', points='cards', key='material_id')},
m AS (SELECT doc_id, source || '/' || lang AS material_id, source FROM documents),
{hybrid_sql(20, INSIDE)},
units AS (SELECT item_id, doc_id, score, rank, m.material_id, m.source FROM hits JOIN m USING (doc_id))"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _docs(spark, sf_dir).select(_material().alias("material_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = profile.material_keywords(units, "material_id", "doc_id", "text")
    return words.select("material_id", index.card_text("material_id", "terms", F.slice("terms", 1, 12)).alias("card"))


def _two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials by their cards, then units inside each query's five best materials, both by hybrid search."""
    docs = _docs(spark, sf_dir).select("doc_id", _material().alias("material_id"), "source", "text")
    hits = search.two_hop(docs, "doc_id", "text", _cards(spark, sf_dir), "material_id", "card", _items(spark, sf_dir), "item_id", "asked", 20)
    return hits.join(docs.drop("text"), "doc_id").select("item_id", "doc_id", "score", "material_id", "source", "rank")


@query(TWO_HOP_SQL + " SELECT item_id, doc_id, material_id, round(score, 9) AS score, rank FROM units")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3."""
    return _two_hop(spark, sf_dir).select("item_id", "doc_id", "material_id", F.round("score", 9).alias("score"), "rank")


@query(
    TWO_HOP_SQL
    + """, t AS (SELECT *, first_value(source) OVER (PARTITION BY item_id ORDER BY rank) AS top FROM units),
b AS (SELECT *, score + CASE WHEN source = top THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS boosted FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY boosted DESC, rank) AS new_rank FROM b)
SELECT item_id, doc_id, source, round(boosted, 9) AS score, new_rank AS rank FROM r WHERE new_rank <= 10"""
)
def boosted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3."""
    return retrieve.boost_same_source(_two_hop(spark, sf_dir), "item_id", "source", 10).select("item_id", "doc_id", "source", F.round("score", 9).alias("score"), "rank")


@query(TWO_HOP_SQL + " SELECT item_id, doc_id, material_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, material_id ORDER BY rank) AS nth FROM units) WHERE nth <= 3")
def diverse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2."""
    return retrieve.diverse(_two_hop(spark, sf_dir), "item_id", "material_id", 3).select("item_id", "doc_id", "material_id", "rank")


@query(
    TWO_HOP_SQL
    + """, x AS (SELECT u.*, CASE WHEN item_id % 4 <> 0 OR doc_id % 3 <> 0 THEN (n_chars % 97)::DOUBLE END AS new FROM units u JOIN documents USING (doc_id)),
y AS (SELECT *, count(*) OVER (PARTITION BY item_id) >= 2 AND count(new) OVER (PARTITION BY item_id) = count(*) OVER (PARTITION BY item_id) AS ok FROM x)
SELECT item_id, doc_id, round(CASE WHEN ok THEN new ELSE score END, 9) AS score,
       row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN ok THEN new END DESC NULLS LAST, rank) AS rank FROM y"""
)
def rerank_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: scores from a table; some queries lack one and keep their order."""
    hits = written(spark, _two_hop(spark, sf_dir), "hits")  # read twice
    given = hits.join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id").filter("item_id % 4 <> 0 or doc_id % 3 <> 0").select("item_id", "doc_id", (F.col("n_chars") % 97).cast("double").alias("score"))
    return retrieve.rerank(hits, given, "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 9).alias("score"), "rank")


WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(substr(coalesce({}, ''), 1, 2048)), '\\s+'), lambda x: x <> ''))"


@query(
    TWO_HOP_SQL
    + f""", sc AS (SELECT u.*, len(list_intersect({WORDS_SQL.format('b.text')}, {WORDS_SQL.format('d.text')}))::DOUBLE AS s, count(*) OVER (PARTITION BY item_id) AS n FROM units u JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, CASE WHEN n >= 2 THEN s ELSE score END AS score, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN n >= 2 THEN s END DESC NULLS LAST, rank) AS rank FROM sc"""
)
def scored_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF2: reranking by a Python scorer in Arrow batches (shared words of query and unit)."""

    def shared_words(asked: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([float(len(set(a.lower().split()) & set(b.lower().split()))) for a, b in zip(asked, found, strict=True)])

    texts = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("point_text"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("query_text"))
    return retrieve.rerank_with(_two_hop(spark, sf_dir), asked, texts, "item_id", "doc_id", build=lambda: shared_words).select("item_id", "doc_id", "score", "rank")


SIBLINGS_SQL = f"""{MATERIALS_SQL}, so AS (SELECT *, CASE material_type WHEN 'document' THEN 0 WHEN 'project' THEN 1 WHEN 'dataset' THEN 2 WHEN 'code' THEN 3 ELSE 9 END AS type_rank FROM materials),
sn AS (SELECT a.material_id, list(b.root_path ORDER BY b.type_rank, b.root_path) FILTER (WHERE b.root_path IS NOT NULL) AS names
      FROM so a LEFT JOIN so b ON a.source = b.source AND a.material_id <> b.material_id AND b.status = 'ready' GROUP BY a.material_id),
siblings AS (SELECT material_id, array_to_string(CASE WHEN len(names) > 4 THEN list_append(names[:4], '+' || (len(names) - 4) || ' more') ELSE coalesce(names, []) END, '|') AS siblings FROM sn)"""


@query(f"WITH {SIBLINGS_SQL} SELECT * FROM siblings")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: other READY materials of the same source."""
    return retrieve.siblings(_materials(spark, sf_dir), "material_id", "source").withColumn("siblings", F.array_join("siblings", "|"))


@query(
    f"""WITH {MATERIALS_SQL}, {ANALYSES_SQL}, u AS (SELECT source || '/' || lang AS material_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS unit_no, CASE WHEN doc_id % 2 = 0 THEN 'page' ELSE 'text' END AS unit_type,
  'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' page ' || (doc_id % 5) ELSE ' lines 1-' || (n_chars % 7 + 1) END AS citation FROM documents WHERE doc_id % 9 <> 0 AND lang <> 'fr')
SELECT m.material_id, CASE WHEN m.material_type = 'project' AND a.material_id IS NOT NULL THEN 'Project ' || m.material_id ELSE regexp_extract(m.material_id, '[^/]+$') END AS title, m.material_type, root_path, status,
  coalesce({clip_sql('summary')}, '') AS summary, CASE WHEN a.material_id IS NOT NULL THEN {profile_plans.PURPOSE_SQL} END AS purpose, array_to_string(coalesce(keywords, []), '|') AS keywords, array_to_string(coalesce(keywords[:12], []), '|') AS topics,
  CASE WHEN a.material_id IS NOT NULL THEN {profile_plans.RELEVANCE_SQL} END AS relevance, unit_no, unit_type, citation FROM materials m LEFT JOIN analyses a USING (material_id) LEFT JOIN u USING (material_id)"""
)
def material_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13: every material with its analysis and the citations of all its units, a row each; every ninth unit is a card."""
    d, none = F.col("doc_id"), F.lit(None)
    m = _materials(spark, sf_dir).select("material_id", F.element_at(F.split("root_path", "/"), -1).alias("name"), "material_type", none.cast("string").alias("subtype"), "root_path", "status")
    kinds = m.select("material_id", "material_type")
    a = _analyses(spark, sf_dir).join(kinds, "material_id").select(
        "material_id", F.when(F.col("material_type") == "project", F.concat(F.lit("Project "), "material_id")).otherwise("").alias("title"), T.clip("summary").alias("summary"), mapped(F.col("material_type"), profile.PURPOSE).alias("purpose"),
        "keywords", F.slice("keywords", 1, 12).alias("topics"), none.cast("array<string>").alias("technologies"), mapped(F.col("material_type"), profile.RELEVANCE, F.lit(0.4)).alias("relevance"),
    )
    u = _docs(spark, sf_dir).filter("lang <> 'fr'").select(
        _material().alias("material_id"), d.alias("pos"), F.when(d % 9 == 0, CARD).otherwise("u").alias("unit"), F.when(d % 2 == 0, "page").otherwise("text").alias("unit_type"), F.concat(F.lit("doc"), d.cast("string")).alias("path"),
        F.when(d % 2 == 0, d % 5).alias("page"), F.when(d % 2 == 1, F.lit(1)).alias("line_start"), F.when(d % 2 == 1, F.col("n_chars") % 7 + 1).alias("line_end"),
    )
    return retrieve.material_detail(m, a, u, "material_id").drop("subtype", "technologies").withColumns({c: F.array_join(c, "|") for c in ("keywords", "topics")})


@query(
    TWO_HOP_SQL
    + """, k AS (SELECT item_id, material_id, doc_id % 3 AS page, min(rank) AS rank FROM units GROUP BY ALL)
SELECT item_id, material_id, page, rank FROM k"""
)
def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN14: first occurrence of each location in rank order."""
    located = _two_hop(spark, sf_dir).withColumn("page", F.col("doc_id") % 3)
    nth = F.row_number().over(Window.partitionBy("item_id", "material_id", "page").orderBy("rank"))
    return located.withColumn("nth", nth).filter("nth = 1").select("item_id", "material_id", "page", "rank")


@query(
    TWO_HOP_SQL
    + f""", {SIBLINGS_SQL} SELECT item_id, u.doc_id, 'doc' || u.doc_id AS path, 'doc' || u.doc_id || CASE WHEN u.doc_id % 2 = 0 THEN ' page ' || (u.doc_id % 5) ELSE ' lines 1-' || (n_chars % 7 + 1) END AS citation,
 {clip_sql('text')} AS snippet, round(score, 9) AS score, rank, siblings FROM units u JOIN documents USING (doc_id) LEFT JOIN siblings USING (material_id)"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17, FN6: hits as citation rows, with the siblings of their material."""
    hits = _two_hop(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text", "n_chars"), "doc_id")
    even = F.col("doc_id") % 2 == 0
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    cited = T.format_location(path, F.when(even, F.col("doc_id") % 5), F.when(~even, F.lit(1)), F.when(~even, F.col("n_chars") % 7 + 1))
    others = retrieve.siblings(_materials(spark, sf_dir), "material_id", "source").withColumn("siblings", F.array_join("siblings", "|"))
    return hits.join(others, "material_id", "left").select("item_id", "doc_id", path.alias("path"), cited.alias("citation"), T.clip("text").alias("snippet"), F.round("score", 9).alias("score"), "rank", "siblings")


# Evaluation: a benchmark item is a case; the documents that contain its text are what it expects.
EVAL_SQL = f"""WITH {hybrid_sql(5)},
cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'semantic' END AS mode, text FROM benchmark),
expect AS (SELECT case_id, doc_id FROM cases JOIN documents ON contains(documents.text, cases.text)),
hit AS (SELECT e.case_id, e.doc_id, h.rank FROM expect e JOIN hits h ON h.item_id = e.case_id AND h.doc_id = e.doc_id),
scores AS (
  SELECT case_id, mode, count(DISTINCT e.doc_id) AS expected, count(DISTINCT hit.doc_id) AS found, coalesce(min(hit.rank), 0) AS rank
  FROM cases LEFT JOIN expect e USING (case_id) LEFT JOIN hit USING (case_id, doc_id) GROUP BY ALL)"""


def _case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.evaluate import containing, score_cases

    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("semantic").alias("mode"), "text")
    expect = containing(cases, _docs(spark, sf_dir), "case_id", "doc_id")
    hits = _hybrid(spark, sf_dir, 5).select(F.col("item_id").alias("case_id"), "doc_id", "rank")
    return score_cases(cases.select("case_id", "mode"), expect, hits)


@query(EVAL_SQL + " SELECT case_id, mode, expected, found, rank, rank = 1 AS hit_at_1, CASE WHEN expected > 0 THEN round(found / expected, 9) ELSE 0.0 END AS recall FROM scores")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, AGG18."""
    return _case_scores(spark, sf_dir).withColumn("recall", F.round("recall", 9))


@query(EVAL_SQL + " SELECT mode, count(*) AS cases, count(*) FILTER (WHERE rank = 1) AS hits_at_1, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 9) AS mrr FROM scores GROUP BY mode")
def eval_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18 by mode."""
    from quarry.operators.evaluate import by_mode

    return by_mode(_case_scores(spark, sf_dir), ["mode"]).withColumn("mrr", F.round("mrr", 9))


CITED = """'doc' || doc_id AS path, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' page ' || (doc_id % 5) ELSE ' lines 1-' || (doc_id % 7 + 1) END AS citation,
  CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS page, CASE WHEN doc_id % 2 = 1 THEN 1 END AS line_start"""


@query(
    f"""WITH {hybrid_sql(5)}, cited AS (SELECT item_id AS case_id, rank, {CITED} FROM hits),
cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'semantic' END AS mode, 3 + item_id % 3 AS k, text FROM benchmark),
expect AS (SELECT case_id, doc_id AS expect_no, 'doc' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 END AS page, doc_id % 2 = 1 AS lines FROM cases JOIN documents ON contains(documents.text, cases.text)),
met AS (SELECT e.case_id, e.expect_no, c.rank FROM expect e JOIN cases USING (case_id) JOIN cited c ON c.case_id = e.case_id AND c.rank <= k
  WHERE contains(c.path || ' ' || c.citation, e.path) AND (e.page IS NULL OR e.page IS NOT DISTINCT FROM c.page) AND (NOT e.lines OR c.line_start IS NOT NULL)),
s AS (SELECT case_id, mode, k, (SELECT count(*) FROM expect e WHERE e.case_id = cases.case_id) AS expected, (SELECT count(DISTINCT expect_no) FROM met WHERE met.case_id = cases.case_id) AS found,
  coalesce((SELECT min(rank) FROM met WHERE met.case_id = cases.case_id), 0) AS rank FROM cases WHERE mode = 'lexical')
SELECT *, rank = 1 AS hit_at_1, CASE WHEN expected > 0 THEN round(found / expected, 9) ELSE 0.0 END AS recall FROM s"""
)
def selector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, UDF5: a selector answers the lexical cases with citations, which are matched by path, page and lines."""
    from quarry.operators.evaluate import containing, score_selector

    d = F.col("doc_id")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("semantic").alias("mode"), (3 + F.col("item_id") % 3).alias("k"), F.col("text").alias("query"))
    pairs = containing(cases.withColumnRenamed("query", "text"), _docs(spark, sf_dir), "case_id", "doc_id")
    expected = F.struct(F.concat(F.lit("doc"), d.cast("string")).alias("path"), F.when(d % 4 == 0, d % 5).alias("page"), (d % 2 == 1).alias("lines"), F.lit(None).cast("string").alias("section"))

    def select(asked: DataFrame) -> DataFrame:
        hits = search.hybrid(_docs(spark, sf_dir), "doc_id", "text", asked, "case_id", "query", 5)
        page, line, path = F.when(d % 2 == 0, d % 5), F.when(d % 2 == 1, F.lit(1)), F.concat(F.lit("doc"), d.cast("string"))
        return hits.select("case_id", "rank", path.alias("path"), T.format_location(path, page, line, d % 7 + 1).alias("citation"), page.alias("page"), line.alias("line_start"), F.lit(None).cast("string").alias("section"))

    scored = score_selector(cases, pairs.select("case_id", d.alias("expect_no"), expected.alias("expected")), select, ("lexical",))
    return scored.select("case_id", "mode", "k", "expected", "found", "rank", "hit_at_1", F.round("recall", 9).alias("recall"))
