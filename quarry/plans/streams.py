"""Streaming queries: tables written as files, streamed with ``availableNow`` and read back.

Arrivals come in waves, each drained by a stream of its own from one checkpoint, as after a restart.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.evidence import CARD
from quarry.plans.common import bucket_sql, query
from quarry.session import scratch_dir, table
from quarry.streaming import ingest
from quarry.streaming.materials import FILES, MaterialPipeline, schema

# The extractor below travels to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _waves(spark: SparkSession, waves: list[DataFrame], run: Callable[[DataFrame], None]) -> None:
    """Each wave is written as files, which one micro-batch takes together, and then processed."""
    path = scratch_dir(spark, "arrivals")
    for rows in waves:
        rows.write.mode("append").parquet(path)
        run(ingest.arriving(spark, path, rows.schema))


@query("""WITH n AS (SELECT url AS path, length(html)::VARCHAR AS fingerprint, page_id FROM pages),
a AS (SELECT path, fingerprint FROM n WHERE page_id % 3 <> 0),
b AS (SELECT path, CASE WHEN page_id % 2 = 0 THEN fingerprint || 'x' ELSE fingerprint END AS fingerprint FROM n WHERE page_id % 5 <> 0)
SELECT path, fingerprint FROM a UNION ALL SELECT b.path, b.fingerprint FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = b.path AND a.fingerprint = b.fingerprint)""")
def stream_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1: pages arrive, and later again: known ones with the same length are passed over, changed and new ones come through. A url may be
    that of several pages."""
    n = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.length("html").cast("string").alias("fingerprint"), "page_id")
    later = F.when(F.col("page_id") % 2 == 0, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")).alias("fingerprint")
    out, checkpoint = scratch_dir(spark, "new-items"), scratch_dir(spark, "checkpoint")
    waves = [n.filter("page_id % 3 <> 0").select("path", "fingerprint"), n.filter("page_id % 5 <> 0").select("path", later)]
    _waves(spark, waves, lambda rows: ingest.drain(ingest.unlike_items(rows, "path", "fingerprint"), out, checkpoint))
    return spark.read.schema("path string, fingerprint string").parquet(out)


@query("SELECT DISTINCT user_id || ':' || event_type AS run_key FROM events")
def stream_run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2: repeated requests for a run are ignored, also by a later stream."""
    keys = table(spark, sf_dir, "events").select("event_id", T.run_key("user_id", "event_type").alias("run_key"))
    out, checkpoint = scratch_dir(spark, "run-keys"), scratch_dir(spark, "checkpoint")
    waves = [keys.filter("event_id % 4 <> 0").select("run_key"), keys.select("run_key")]
    _waves(spark, waves, lambda rows: ingest.drain(ingest.first_items(rows, "run_key"), out, checkpoint))
    return spark.read.schema("run_key string").parquet(out)


def _lines(path: str, text: str) -> Iterable[tuple[str | None, int, int, str]]:
    """An extractor as a user writes one: every line with a word is a unit; one kind of junk cannot be read."""
    if "%%%" in text:
        raise ValueError(f"{path}: cannot be decoded")
    return [(None, i + 1, i + 1, line) for i, line in enumerate(text.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]


def _processed(spark: SparkSession, sf_dir: str) -> MaterialPipeline:
    """Documents as Markdown files of materials ``source/number``; a second wave brings materials again and adds new ones."""
    d = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", (d % 30).cast("string")).alias("material_id"), "source", F.concat("source", F.lit("/")).alias("root_path"),
        F.concat(F.lit("d"), d.cast("string"), F.lit(".md")).alias("path"), "text", (d % 30).alias("k"), "doc_id",
    )
    columns = schema(FILES).names
    pipeline = MaterialPipeline(spark, scratch_dir(spark, "materials"), 16, extract=_lines)
    _waves(spark, [files.filter("k < 20 and doc_id % 2 = 0").select(columns), files.filter("k >= 10 and (k < 15 or doc_id % 4 < 2)").select(columns)], pipeline.run)
    return pipeline


# Rows of the second wave take the place of a material's first ones, unless the material fails.
MATERIALS_SQL = r"""WITH f AS (SELECT source || '/' || (doc_id % 30) AS material_id, doc_id % 30 AS k, doc_id, 'd' || doc_id || '.md' AS path, text, contains(coalesce(text, ''), '%%%') OR text IS NULL AS bad,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]'))) AS units FROM documents),
w AS (SELECT 1 AS wave, * FROM f WHERE k < 20 AND doc_id % 2 = 0 UNION ALL SELECT 2, * FROM f WHERE k >= 10 AND (k < 15 OR doc_id % 4 < 2)),
g AS (SELECT material_id, wave, bool_or(bad) AS failed, count(*) AS files, sum(units)::BIGINT AS units FROM w GROUP BY ALL),
s AS (SELECT material_id, arg_max(failed, wave) AS failed, arg_max(files, wave) AS files, arg_max(units, wave) AS units, max(wave) FILTER (WHERE NOT failed) AS shown, max(wave) AS wave FROM g GROUP BY material_id)"""


@query(MATERIALS_SQL + rf""", u AS (
  SELECT material_id, sum({bucket_sql("path || ':' || n || ':' || line", 1 << 32)})::BIGINT AS mark FROM (
    SELECT material_id, wave, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM w WHERE text IS NOT NULL) l
  JOIN s USING (material_id) WHERE s.shown = l.wave AND regexp_matches(line, '[^ \t\n\x0b\x0c\r]') GROUP BY material_id),
q AS (SELECT material_id, min(path || CASE WHEN text IS NULL THEN ' load: no text' ELSE ' extract: ' || path || ': cannot be decoded' END) AS first_error, count(*) AS quarantined FROM w JOIN s USING (material_id) WHERE bad AND w.wave = s.wave GROUP BY material_id)
SELECT s.material_id, CASE WHEN s.failed THEN 'failed' ELSE 'ready' END AS status, 'document' AS material_type, 'markdown' AS subtype, s.files, CASE WHEN s.failed THEN 0 ELSE s.units END AS units,
  coalesce(g.units + 1, 0) AS points, coalesce(mark, 0) AS mark, coalesce(quarantined, 0) AS quarantined, first_error
FROM s LEFT JOIN g ON g.material_id = s.material_id AND g.wave = s.shown LEFT JOIN u ON u.material_id = s.material_id LEFT JOIN q ON q.material_id = s.material_id""")
def stream_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: claim, classify, extract, profile and replace in micro-batches. Per material its state, what the index holds of it
    (points with the card, and a sum over the units' contents) and its files in quarantine; a material that fails keeps its points."""
    done = _processed(spark, sf_dir)
    unit = F.concat_ws(":", "path", F.col("line_start").cast("string"), "content")
    held = done.points.read().groupBy("material_id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.when(F.col("unit") != CARD, T.token_bucket(unit, 1 << 32))).alias("mark"))
    error = F.concat("path", F.lit(" "), "stage", F.lit(": "), "error")
    lost = done.quarantine.read().groupBy("material_id").agg(F.count(F.lit(1)).alias("quarantined"), F.min(error).alias("first_error"))
    out = done.states.read().join(held, "material_id", "left").join(lost, "material_id", "left").na.fill(0, ["points", "mark", "quarantined"])
    return out.select("material_id", "status", "material_type", "subtype", "files", "units", "points", "mark", "quarantined", "first_error")
