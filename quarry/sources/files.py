"""File sources and sinks: corpus scan, bounded reads, suites, samples, versioned outputs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarry.operators.corpus import tree_digest
from quarry.operators import corpus as C

EXPAND_SUFFIXES = (".zip", ".tar", ".tgz", ".7z", ".gz")
HIT = S.StructType([S.StructField("path", S.StringType()), S.StructField("page", S.IntegerType()), S.StructField("lines", S.BooleanType()), S.StructField("section", S.StringType())])
CASE = S.StructType([
    S.StructField("id", S.StringType()), S.StructField("query", S.StringType()), S.StructField("mode", S.StringType()), S.StructField("k", S.IntegerType()),
    S.StructField("material_type", S.StringType()), S.StructField("expect", S.ArrayType(HIT)),
])
SUITE = S.StructType([S.StructField("id", S.StringType()), S.StructField("cases", S.ArrayType(CASE))])


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files below ``root`` by relative path and whole ``uri``, without hidden, cache and vendor parts.

    Without ``content`` the column is pruned and files are only listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].replace("file:", "").rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    columns = ["length", "modificationTime"] + (["content"] if content else [])
    return found.select(path.alias("path"), F.col("path").alias("uri"), *columns).filter(C.visible("path"))


def bounded_text(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` bytes of each file of ``files(uri, ...)`` as text; invalid UTF-8 is replaced. No more of a file is read."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            texts = []
            for uri in b["uri"]:
                store, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://"))
                with store.open_input_file(path) as source:
                    texts.append(source.read(limit).decode("utf-8", "replace"))
            yield b.assign(text=texts)

    slim = files.drop("content")
    return slim.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in slim.dtypes) + ", text string")


def drop_listing(files: DataFrame) -> DataFrame:
    """Top-level files whose suffix means expansion, with a fingerprint of time and size."""
    top = files.filter(~F.col("path").contains("/") & (C.suffix_format("path")["action"] == "expand"))
    return top.select("path", F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("fingerprint"))


def suites(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation suites: one row per case and expected hit, with the defaults lexical and 5."""
    cases = spark.read.schema(SUITE).json(path, multiLine=True).select(F.col("id").alias("suite"), F.explode("cases").alias("c"))
    return cases.select("suite", "c.id", "c.query", F.coalesce("c.mode", F.lit("lexical")).alias("mode"), F.coalesce("c.k", F.lit(5)).alias("k"), "c.material_type", F.posexplode_outer("c.expect").alias("expect_no", "expect"))


def sample_csv(records: DataFrame, path: str, order: str, rows: int = 200) -> None:
    """First ``rows`` records with an instruction as three quoted columns."""
    kept = records.filter(F.trim(F.coalesce("instruction", F.lit(""))) != "").orderBy(order).limit(rows)
    kept.select("instruction", "input", "output").write.option("header", True).option("quoteAll", True).csv(path)


def write_stage(results: DataFrame, path: str) -> None:
    """Stage output by (artifact_type, processor_version); only the partitions in ``results`` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact_type", "processor_version").parquet(path)


def manifest(files: DataFrame, material: str) -> DataFrame:
    """Files, bytes and tree digest of each material of files(material, path, sha, size); the entries stay rows
    (:func:`manifest_entries`)."""
    sizes = files.groupBy(material).agg(F.sum("size").alias("bytes"))
    return tree_digest(files, material, "path", "sha").join(sizes, material)


def manifest_entries(files: DataFrame, material: str, path: str) -> None:
    """Entries (path, sha, size) as JSON lines, one folder a material, in path order inside each file."""
    kept = files.select(material, "path", "sha", "size").repartition(material).sortWithinPartitions(material, "path")
    kept.write.mode("overwrite").partitionBy(material).json(path)
