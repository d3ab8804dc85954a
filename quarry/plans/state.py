"""Queries over pipeline state: ``events`` is a log of state changes per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import state as S
from quarry.operators.evidence import CARD
from quarry.plans.common import query
from quarry.session import scratch_dir, table
from quarry.sources.store import BucketStore


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15."""
    return S.latest(_events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


HALVES = """a AS (SELECT user_id, event_type, sum(value) AS value, min(event_id) AS created FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, sum(value) AS value, min(event_id) AS created FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY ALL)"""


@query(f"WITH {HALVES} SELECT user_id, event_type, round(CASE WHEN b.created IS NOT NULL THEN b.value ELSE a.value END, 4) AS value, coalesce(a.created, b.created) AS created FROM a FULL JOIN b USING (user_id, event_type)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: the odd half of the log upserted into a store of the even half; the first creation is kept."""
    e = _events(spark, sf_dir)
    part = lambda rows: rows.groupBy("user_id", "event_type").agg(F.sum("value").alias("value"), F.min("event_id").alias("created"))
    old = part(e.filter("event_id % 2 = 0"))
    store = BucketStore(spark, scratch_dir(spark, "state"), old.schema, "user_id", 16)
    store.replace(old)
    store.upsert(part(e.filter("event_id % 2 = 1 and user_id % 3 <> 0")), ["value"], ["created"], ["user_id", "event_type"])
    return store.read().withColumn("value", F.round("value", 4))


STATUS = ("discovered", "processing", "failed", "ready", "classified")
STATUS_SQL = "['discovered', 'processing', 'failed', 'ready', 'classified'][doc_id % 5 + 1]"


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("material_id"), status.alias("status"), (F.col("n_chars") % 1000).alias("created_at"))


@query(f"SELECT doc_id AS material_id, 'processing' AS status, n_chars % 1000 AS created_at FROM documents WHERE {STATUS_SQL} = 'discovered' ORDER BY created_at, doc_id LIMIT 50")
def claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2: the limit is the claim size."""
    return S.claim_oldest(_materials(spark, sf_dir), "material_id")


@query(f"SELECT doc_id AS material_id, {STATUS_SQL} AS status FROM documents WHERE {STATUS_SQL} IN ('processing', 'discovered', 'failed', 'ready')")
def claim_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5."""
    return S.claimable(_materials(spark, sf_dir)).select("material_id", "status")


@query("""WITH runs AS (SELECT user_id AS material_id, event_id AS run_no, ts AS created_at, CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'running' ELSE 'done' END AS status FROM events),
l AS (SELECT material_id, arg_max(status, (created_at, run_no)) AS status FROM runs GROUP BY material_id)
SELECT DISTINCT doc_id AS material_id FROM documents WHERE doc_id NOT IN (SELECT material_id FROM l WHERE status IN ('claimed', 'running'))""")
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: materials whose latest run is not open."""
    status = F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "running").otherwise("done")
    runs = _events(spark, sf_dir).select(F.col("user_id").alias("material_id"), F.col("event_id").alias("run_no"), F.col("ts").alias("created_at"), status.alias("status"))
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("material_id")).distinct()
    return S.open_run_check(wanted, runs, "material_id")


@query("""WITH n AS (SELECT url AS path, min(page_id) AS k, max(length(html)) AS size FROM pages GROUP BY url),
b AS (SELECT path, CASE WHEN k % 3 = 0 THEN size + 1 ELSE size END AS size FROM n WHERE k % 4 <> 0)
SELECT path, size FROM n WHERE (path, size) NOT IN (SELECT (path, size) FROM b)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8: pages that are new or of another size than in a snapshot."""
    n = table(spark, sf_dir, "pages").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("k"), F.max(F.length("html")).alias("size"))
    before = n.filter("k % 4 <> 0").select("path", F.when(F.col("k") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return S.snapshot_diff(n, before, "path", "size").select("path", "size")


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS digest, doc_id FROM documents)
SELECT digest, min(doc_id) AS doc_id FROM d WHERE doc_id % 3 <> 0 AND digest NOT IN (SELECT digest FROM d WHERE doc_id % 3 = 0) GROUP BY digest""")
def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2, SET3: documents whose digest is not known yet, first of each digest; every third document is known."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    return S.register_new(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0"), "digest", ["doc_id"])


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def unit_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3: exact-duplicate groups."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    return S.duplicate_groups(d, "digest", "doc_id")


@query("""WITH g AS (SELECT source, bool_or(coalesce(n_chars, 0) < 50) AS short_unit, bool_or(toxic = 1) AS toxic_unit, bool_or(contains(coalesce(text, ''), '%%%')) AS symbols
  FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source)
SELECT source, unnest(list_filter([CASE WHEN short_unit THEN 'short_unit' END, CASE WHEN toxic_unit THEN 'toxic_unit' END, CASE WHEN symbols THEN 'symbols' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: rules evaluated in one aggregate per material."""
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    rules = {"short_unit": F.coalesce("n_chars", F.lit(0)) < 50, "toxic_unit": F.col("toxic") == 1, "symbols": F.coalesce("text", F.lit("")).contains("%%%")}
    return S.quality_errors(d, ["source"], rules)


@query("SELECT DISTINCT 'src' || (doc_id % 25) AS source FROM documents WHERE 'src' || (doc_id % 25) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def expected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: expected sources that no document has."""
    d = table(spark, sf_dir, "documents")
    expected = d.select(F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("source")).distinct()
    return S.expected_missing(expected, d, "source")


@query("""WITH u AS (SELECT source, doc_id, CASE WHEN doc_id % 6 = 0 THEN 'tests/t' || doc_id % 9 ELSE 'p' || doc_id % 30 END AS path, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS page, coalesce(text, '') AS text FROM documents),
x AS (SELECT DISTINCT source, TRY_CAST(substr(source, 4) AS INT) AS k FROM documents),
a AS (SELECT source, count(*) AS units, count(DISTINCT path) AS files, count(DISTINCT page) AS pages, bool_or(starts_with(path, 'tests/')) AS tests, arg_min(contains(text, 'the'), doc_id) FILTER (WHERE page = 1) AS first_ok, bool_or(contains(text, '%%%')) AS phrase_ok FROM u GROUP BY source)
SELECT source, unnest(list_filter([CASE WHEN k % 4 = 0 AND k > 12 THEN 'deep_cap' END, CASE WHEN k % 4 = 0 AND k * 3 <= 20 THEN 'scanned' END, CASE WHEN k % 4 = 0 AND files > 12 THEN 'indexed_cap' END, CASE WHEN k % 4 = 0 AND tests THEN 'tests_indexed' END,
 CASE WHEN k % 4 = 1 AND pages < 5 THEN 'pages' END, CASE WHEN k % 4 = 1 AND NOT coalesce(first_ok, false) THEN 'first_phrase' END, CASE WHEN k % 4 = 2 AND NOT phrase_ok THEN 'phrase' END, CASE WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'mode' END, CASE WHEN k % 4 = 3 AND units <> 1 THEN 'one_unit' END], lambda r: r IS NOT NULL)) AS rule
FROM x JOIN a USING (source)""")
def processing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: file caps, page counts, phrases, coverage mode and single units asked of materials by their number."""
    d = F.col("doc_id")
    path = F.when(d % 6 == 0, F.concat(F.lit("tests/t"), (d % 9).cast("string"))).otherwise(F.concat(F.lit("p"), (d % 30).cast("string")))
    units = table(spark, sf_dir, "documents").select("source", d.alias("pos"), path.alias("path"), F.when(d % 2 == 0, d % 5).alias("page"), F.col("text").alias("content"))
    k = F.expr("try_cast(substr(source, 4) as int)")
    expected = units.select("source").distinct().select(
        "source", k.alias("deep"), (k * 3).alias("scanned"), F.when(k % 3 == 0, "hierarchical").otherwise("direct").alias("mode"), F.when(k % 2 == 1, "hierarchical").alias("want_mode"),
        F.when(k % 4 == 0, 12).alias("max_files"), F.when(k % 4 == 0, 20).alias("min_scanned"), F.when(k % 4 == 1, 5).alias("min_pages"), F.when(k % 4 == 1, "the").alias("first_phrase"), F.when(k % 4 == 2, "%%%").alias("phrase"), (k % 4 == 3).alias("one_unit"),
    )
    return S.processing_errors(units, expected, "source")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'citation' ELSE 'path' END AS place FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22: citations of a material's card, by its citation or its path."""
    d, source = F.col("doc_id"), F.col("source")
    cited = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 7 == 0, CARD).when(d % 3 == 0, "material").otherwise(source).alias("citation"), F.when(d % 11 == 0, CARD).when(d % 2 == 0, source).alias("path"))
    return S.citation_errors(cited, CARD).select("doc_id", F.when(F.col("citation") == CARD, "citation").otherwise("path").alias("place"))


@query("""WITH o AS (SELECT doc_id, source AS material_id, n_chars FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, source AS material_id, n_chars FROM documents WHERE doc_id % 2 = 1 AND lang = 'de')
SELECT * FROM o WHERE material_id NOT IN (SELECT material_id FROM n) UNION ALL SELECT * FROM n""")
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: all points of the materials in the new batch are replaced, in a stored index whose other buckets stay as they are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("material_id"), "n_chars", "lang")
    old, new = d.filter("doc_id % 2 = 0").drop("lang"), d.filter("doc_id % 2 = 1 and lang = 'de'").drop("lang")
    store = BucketStore(spark, scratch_dir(spark, "points"), old.schema, "material_id", 16)
    store.replace(old)
    store.replace(new)
    return store.read()


@query("SELECT source AS material_id, count(*) AS points, 0::BIGINT AS left_over FROM documents GROUP BY source")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: points of each material, and after the index is wiped."""
    from quarry.operators.index import count_points, wipe

    points = table(spark, sf_dir, "documents").select(F.col("source").alias("material_id"), "doc_id")
    after = count_points(wipe(points)).withColumnRenamed("points", "left_over")
    return count_points(points).join(after, "material_id", "left").na.fill(0, ["left_over"])
