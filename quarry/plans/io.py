"""Queries over files that Spark writes from the tables and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.common import query
from quarry.session import scratch_dir, table
from quarry.sources import files


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Documents as text files below ``kept``, a hidden folder, a build folder and a vendor tree."""
    root = scratch_dir(spark, "tree")
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.col("source").alias("folder"))
    for folder, rows in ((".hidden", "folder = 'src1'"), ("build", "folder = 'src2'"), ("kept/node_modules", "folder = 'src3'"), ("kept", "folder not in ('src1', 'src2', 'src3')")):
        d.filter(rows).write.mode("append").partitionBy("folder").text(f"{root}/{folder}")
    return root


@query("SELECT DISTINCT 'kept' AS top, source AS folder FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: relative paths without hidden, build and vendor folders."""
    found = files.scan(spark, _tree(spark, sf_dir), content=False)
    return found.select(F.split("path", "/")[0].alias("top"), F.regexp_extract("path", "folder=([^/]+)/", 1).alias("folder")).distinct()


@query()
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the first 1000 bytes of every file as valid text."""
    return files.bounded_text(files.scan(spark, _tree(spark, sf_dir), content=False), 1000).select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("folder"), F.octet_length("text").alias("bytes"))


@query()
def drop_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: compressed files of a drop folder."""
    root = scratch_dir(spark, "drop")
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.option("compression", "gzip").text(root)
    return files.drop_listing(files.scan(spark, root, content=False))


@query("""SELECT 'suite' || (item_id // 100) AS suite, item_id::VARCHAR AS id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'semantic' ELSE 'lexical' END AS mode, CASE WHEN item_id % 2 = 0 THEN 7 ELSE 5 END AS k,
 n AS expect_no, 'doc' || item_id AS path, CASE WHEN n = 1 THEN 4 END AS page FROM benchmark, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR item_id % 2 = 0""")
def suite_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: benchmark items as evaluation suites, one JSON document per hundred items, read back as cases and
    expected hits with the defaults."""
    i, root = F.col("item_id"), scratch_dir(spark, "suites")
    hit = lambda page: F.struct(F.concat(F.lit("doc"), i.cast("string")).alias("path"), page.alias("page"))
    one = F.array(hit(F.lit(None).cast("int")))
    case = F.struct(i.cast("string").alias("id"), F.col("text").alias("query"), F.when(i % 3 == 0, "semantic").alias("mode"), F.when(i % 2 == 0, 7).alias("k"), F.when(i % 2 == 0, F.concat(one, F.array(hit(F.lit(4))))).otherwise(one).alias("expect"))
    suites = table(spark, sf_dir, "benchmark").groupBy(F.concat(F.lit("suite"), F.expr("cast(item_id div 100 as string)")).alias("id")).agg(F.collect_list(case).alias("cases"))
    suites.select(F.to_json(F.struct("id", "cases")).alias("value"), F.col("id").alias("file")).write.partitionBy("file").text(root)
    found = files.suites(spark, root)
    return found.select("suite", "id", "query", "mode", "k", "expect_no", "expect.path", "expect.page")


@query("SELECT trim(text) AS instruction, conv_id::VARCHAR AS input, turn::VARCHAR AS output FROM conversations WHERE trim(coalesce(text, '')) <> '' ORDER BY conv_id * 1000 + turn LIMIT 200")
def csv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: the first 200 records with an instruction (the limit is the sample's size)."""
    root = scratch_dir(spark, "sample")
    records = table(spark, sf_dir, "conversations").select(F.trim("text").alias("instruction"), F.col("conv_id").cast("string").alias("input"), F.col("turn").cast("string").alias("output"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    files.sample_csv(records, root, "n")
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(root)


@query("SELECT lang AS artifact_type, 'v' || (doc_id % 2) AS processor_version, count(*) AS n, sum(n_chars * CASE WHEN lang = 'de' THEN 2 ELSE 1 END)::BIGINT AS total FROM documents GROUP BY ALL")
def stage_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: all partitions written, then those of one type replaced."""
    root = scratch_dir(spark, "stage")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("artifact_type"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("processor_version"))
    files.write_stage(d, root)
    files.write_stage(d.filter("artifact_type = 'de'").withColumn("n_chars", F.col("n_chars") * 2), root)
    return spark.read.parquet(root).groupBy("artifact_type", "processor_version").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))


@query("""WITH f AS (SELECT doc_id // 10 AS material_id, 'p' || doc_id AS path, sha256(coalesce(text, '')) AS sha, coalesce(strlen(text), 0) AS size FROM documents)
SELECT material_id, count(*) AS files, sum(size)::BIGINT AS bytes, sha256(string_agg(path || chr(0) || sha || chr(10), '' ORDER BY path)) AS digest FROM f GROUP BY material_id""")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2."""
    t = F.coalesce("text", F.lit(""))
    f = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("material_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha2(t, 256).alias("sha"), F.octet_length(t).cast("long").alias("size"))
    return files.manifest(f, "material_id").select("material_id", "files", "bytes", "digest")
