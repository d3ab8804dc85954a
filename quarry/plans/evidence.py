"""Queries that turn hits into evidence, findings and reports.

A hit is a hashed dense hit of a benchmark item; a run is ``item_id div 4``, its questions are its items.
Stance comes from ``labels.toxic``: toxic documents contradict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evidence as E
from quarry.plans import retrieval as R
from quarry.plans.common import query
from quarry.session import table

HITS = f"""WITH {R.scores_sql()}, top AS ({R.rank_sql('dense', 30)}),
tox AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT item_id // 4 AS run_id, item_id AS question_id, rank AS pos, doc_id AS evidence_id, source AS material_id, lang AS finding,
         source || ' page ' || (doc_id % 5) AS citation, source AS path, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS page,
         CASE WHEN toxic = 1 THEN 'contradicts' ELSE 'supports' END AS stance
  FROM top JOIN documents USING (doc_id) LEFT JOIN tox USING (doc_id)),
b0 AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY question_id) AS q, row_number() OVER (PARTITION BY run_id, question_id ORDER BY pos) AS n FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY q, n) AS t FROM b0 WHERE q <= 3 AND n <= 8),
e AS (SELECT * FROM b WHERE t <= 24)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R._top(spark, sf_dir, "dense", 30)
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = top.join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").join(toxic, "doc_id", "left")
    return d.select(
        F.expr("item_id div 4").alias("run_id"), F.col("item_id").alias("question_id"), F.col("rank").alias("pos"), F.col("doc_id").alias("evidence_id"), F.col("source").alias("material_id"),
        F.col("lang").alias("finding"), F.concat("source", F.lit(" page "), (F.col("doc_id") % 5).cast("string")).alias("citation"), F.col("source").alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 5).alias("page"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        F.when(F.col("toxic") == 1, "contradicts").otherwise("supports").alias("stance"),
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.budget(_hits(spark, sf_dir), "run_id", "question_id", ["pos"], "quick")


@query(HITS + " SELECT run_id, question_id, pos, evidence_id, n AS evidence_no FROM e")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13 in quick mode."""
    return _evidence(spark, sf_dir).select("run_id", "question_id", "pos", "evidence_id", "evidence_no")


FINDINGS = (
    HITS
    + """, s AS (SELECT *, count(*) FILTER (WHERE stance <> 'contradicts') OVER (PARTITION BY question_id) AS sup FROM e),
c AS (SELECT question_id, lower(trim(finding)) AS k, min((pos, finding, citation)) AS f FROM s WHERE stance <> 'contradicts' OR sup = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY f) AS n FROM c),
cl AS (SELECT question_id, string_agg(f[2] || ' (' || f[3] || ')', '; ' ORDER BY n) AS claim FROM r WHERE n <= 4 GROUP BY question_id),
l AS (SELECT question_id, coalesce(string_agg(evidence_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE stance <> 'contradicts'), '') AS supporting,
  coalesce(string_agg(evidence_id::VARCHAR, ',' ORDER BY pos) FILTER (WHERE stance = 'contradicts'), '') AS contradicting, CASE WHEN bool_or(stance = 'contradicts') THEN 0.5 ELSE 0.9 END AS confidence FROM e GROUP BY question_id)"""
)


@query(FINDINGS + " SELECT question_id, claim, supporting, contradicting, confidence FROM cl JOIN l USING (question_id)")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17."""
    return E.findings(_evidence(spark, sf_dir), "question_id", "pos")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(F.expr("item_id div 4").alias("run_id"), i.alias("question_id"), (i % 2 == 0).alias("comparative"), (i % 3).cast("int").alias("iterations"))


@query(
    HITS
    + """, per AS (SELECT run_id, question_id, count(*) AS items, count(DISTINCT material_id) AS materials FROM e GROUP BY ALL),
tot AS (SELECT run_id, count(DISTINCT material_id) AS available FROM e GROUP BY ALL),
q AS (SELECT item_id // 4 AS run_id, item_id AS question_id, item_id % 2 = 0 AS comparative, item_id % 3 AS iterations FROM benchmark),
j AS (SELECT q.*, coalesce(items, 0) AS items, coalesce(materials, 0) AS materials, coalesce(available, 0) AS available FROM q LEFT JOIN per USING (run_id, question_id) LEFT JOIN tot USING (run_id))
SELECT run_id, question_id, items, materials, CASE WHEN items > 0 AND comparative AND materials < 2 AND available > 1 AND iterations < 2 THEN 'gap' WHEN items > 0 THEN 'covered'
 WHEN iterations = 0 THEN 'pending' WHEN iterations < 2 THEN 'gap' ELSE 'unresolved' END AS status FROM j"""
)
def question_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20; every third question's evidence is missing from what the budget leaves."""
    found = E.question_coverage(_questions(spark, sf_dir), _evidence(spark, sf_dir), "run_id", "question_id")
    return found.select("run_id", "question_id", "items", "materials", "status")


@query(HITS + " SELECT h.question_id, h.evidence_id FROM h WHERE EXISTS (SELECT 1 FROM e WHERE e.material_id = h.material_id AND e.path = h.path AND e.page IS NOT DISTINCT FROM h.page)")
def validated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10, PRJ11: all hits as report citations, checked against the evidence."""
    return E.allowed_citations(_hits(spark, sf_dir), _evidence(spark, sf_dir)).select("question_id", "evidence_id")


@query(
    FINDINGS
    + """, q AS (SELECT item_id // 4 AS run_id, item_id AS question_id, 'item ' || item_id AS heading, 'Run ' || (item_id // 4) AS objective FROM benchmark),
p AS (SELECT q.*, coalesce(claim, 'No evidence retrieved.') AS body FROM q LEFT JOIN cl USING (question_id)),
g AS (SELECT run_id, objective, string_agg('## ' || question_id || ' ' || heading || chr(10) || body, chr(10) || chr(10) ORDER BY question_id) AS middle,
  coalesce(string_agg(heading, '; ' ORDER BY question_id) FILTER (WHERE NOT contains(body, 'No evidence')), '') AS covered FROM p GROUP BY ALL)
SELECT run_id, '# ' || objective || chr(10) || chr(10) || middle || chr(10) || chr(10) || '## Summary' || chr(10) ||
 CASE WHEN covered = '' THEN objective || '. Insufficient evidence.' ELSE objective || '. Covered: ' || covered || '.' END || chr(10) AS report FROM g"""
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN19."""
    q = _questions(spark, sf_dir).select("run_id", "question_id", F.concat(F.lit("item "), F.col("question_id").cast("string")).alias("heading"), F.concat(F.lit("Run "), F.col("run_id").cast("string")).alias("objective"))
    return E.report(E.sections(q, E.findings(_evidence(spark, sf_dir), "question_id", "pos"), "question_id"), "run_id", "question_id", "heading", "objective")


@query("""WITH q AS (SELECT item_id % 5 AS run_id, item_id AS pos, CASE WHEN item_id % 7 = 0 THEN '' ELSE 'Q' || (item_id % 4) END AS qid FROM benchmark),
n AS (SELECT run_id, pos, CASE WHEN qid = '' THEN 'Q' || row_number() OVER (PARTITION BY run_id ORDER BY pos) ELSE qid END AS qid FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY pos) AS k FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS m FROM f WHERE k = 1)
SELECT run_id, pos, qid FROM r WHERE m <= 4""")
def question_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN20."""
    i = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select((i % 5).alias("run_id"), i.alias("pos"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("Q"), (i % 4).cast("string"))).alias("qid"))
    return E.trim_questions(q, "run_id", "qid", "pos", 4)


def _carded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of which a third cites a material's card, and a third a file that is named ``material``."""
    kind = F.col("evidence_id") % 3
    return _evidence(spark, sf_dir).withColumn("citation", F.when(kind == 0, E.CARD).when(kind == 1, "material").otherwise(F.col("citation")))


@query(HITS + " SELECT question_id, string_agg(evidence_id::VARCHAR, ',' ORDER BY pos) AS evidence FROM e GROUP BY question_id HAVING bool_or(evidence_id % 3 <> 0)")
def finding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: findings with at least one eligible piece of evidence."""
    e = _carded(spark, sf_dir)
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "evidence_id")))), lambda x: x["evidence_id"])
    against = F.col("stance") == "contradicts"
    found = e.groupBy("question_id").agg(ids(~against).alias("supporting"), ids(against).alias("contradicting"), ids(F.lit(True)).alias("every"))
    return E.valid_findings(found, e, "question_id").select("question_id", F.array_join(F.transform("every", lambda x: x.cast("string")), ",").alias("evidence"))


@query(
    HITS
    + """, q AS (SELECT item_id // 4 AS run_id, item_id AS question_id, CASE WHEN item_id % 5 = 0 THEN 'No evidence retrieved.' ELSE 'Body of ' || item_id END AS body FROM benchmark),
ks AS (SELECT question_id, list(evidence_id ORDER BY pos) FILTER (WHERE evidence_id % 3 <> 0) AS keys FROM e WHERE question_id % 3 <> 1 GROUP BY question_id),
ct AS (SELECT DISTINCT run_id FROM e WHERE run_id % 2 = 0 AND evidence_id % 3 <> 0)
SELECT run_id, question_id, coalesce(array_to_string(keys, ','), '') AS keys, CASE WHEN coalesce(len(keys), 0) = 0 AND NOT contains(body, 'No evidence') AND run_id NOT IN (SELECT run_id FROM ct) THEN 'No evidence retrieved.' ELSE body END AS body
FROM q LEFT JOIN ks USING (question_id)"""
)
def section_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: sections keep eligible keys; without any, and without citations of their run, their body is the fixed one."""
    e = _carded(spark, sf_dir)
    i = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select(F.expr("item_id div 4").alias("run_id"), i.alias("question_id"), F.when(i % 5 == 0, E.NO_EVIDENCE).otherwise(F.concat(F.lit("Body of "), i.cast("string"))).alias("body"))
    keys = e.filter("question_id % 3 <> 1").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("keys"))
    s = q.join(keys, "question_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    out = E.valid_sections(s, e, e.filter("run_id % 2 = 0"), "run_id", "question_id")
    return out.select("run_id", "question_id", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"), "body")
