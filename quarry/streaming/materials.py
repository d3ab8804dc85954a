"""The processing chain per micro-batch: claim, classify, extract, profile, analyze, replace in the index.

A micro-batch holds files(material_id, source, root_path, path, text); a material arrives whole in one file of the stream, which a
batch never splits. Every step is one DataFrame for all materials of the batch. A file that cannot be extracted fails its
material: the material goes to quarantine with stage and error, keeps what the index holds of it, and the
others of the batch go on.

Four bucketed stores under one path take the results: ``points`` (units and one card a material), ``analyses``, ``quarantine`` and, last,
``states``. Each change carries the batch id as its tag, so a batch that is given again after a failure repeats only what was
not stored, and one that is complete changes nothing. A material whose files and pipeline version are those of its READY state
is not claimed again; one that failed is.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions import text as T
from quarry.operators import corpus, index, profile, segment
from quarry.operators.evidence import CARD
from quarry.operators.numbering import numbered
from quarry.sources.store import BucketStore
from quarry.streaming import ingest

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = "material_id string, source string, root_path string, path string, text string"
STATES = "material_id string, status string, material_type string, subtype string, files long, units long, digest string, run_key string, batch_id long, error string"
POINTS = "material_id string, unit string, path string, section string, line_start int, line_end int, content string, point_key string"
QUARANTINE = "material_id string, path string, stage string, error string, batch_id long"
ANALYSES = "material_id string, title string, summary string, purpose string, topics array<string>, keywords array<string>, technologies array<string>, capabilities array<string>, relevance double, mode string, ratio double"

#: A file's units: section (or None), first line, last line, content. It may raise; the error fails the file's material.
Extract = Callable[[str, str], Iterable[tuple[str | None, int, int, str]]]


def schema(ddl: str) -> ST.StructType:
    return ST.StructType.fromDDL(ddl)


def extracted_by(files: DataFrame, extract: Extract) -> DataFrame:
    """(material_id, path, section, line_start, line_end, content, error) by a function of path and text: what it raises is the
    ``error`` of the one row of that file, and stops nothing."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for material, path, text in zip(b["material_id"], b["path"], b["text"], strict=True):
                try:
                    rows += [(material, path, *unit, None) for unit in extract(path, text)]
                except Exception as error:  # any failure of a user's function is the file's own
                    rows.append((material, path, None, None, None, None, str(error) or type(error).__name__))
            out = pd.DataFrame(rows, columns=["material_id", "path", "section", "line_start", "line_end", "content", "error"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return files.select("material_id", "path", "text").mapInPandas(run, "material_id string, path string, section string, line_start int, line_end int, content string, error string")


def extracted(files: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """The built-in extraction: units by the material's type, cut to ``size`` tokens. files(material_id, path, text, type, subtype)."""
    units = corpus.extract_units(files, "material_id", "path", "text").withColumn("_key", F.concat_ws("\n", "material_id", "path"))
    kinds = files.select("material_id", "path", F.col("type").alias("material_type"), "subtype")
    own = units.join(kinds, ["material_id", "path"]).select("_key", "material_id", "path", "material_type", "subtype", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), "line_start", "content")
    cut = segment.cut_units(own, "_key", "material_id", ["path"], size, overlap)
    path = F.expr("substring(_key, length(material_id) + 2)").alias("path")
    return cut.select("material_id", path, "section", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "content", F.lit(None).cast("string").alias("error"))


class MaterialPipeline:
    """``process`` for ``foreachBatch``, and its stores under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, version: str = "v1", extract: Extract | None = None, analyzer=profile.analyze):
        self.spark, self.path, self.version, self.extract, self.analyzer = spark, path.rstrip("/"), version, extract, analyzer
        store = lambda name, ddl: BucketStore(spark, f"{self.path}/{name}", schema(ddl), "material_id", buckets)
        self.points, self.analyses, self.quarantine, self.states = store("points", POINTS), store("analyses", ANALYSES), store("quarantine", QUARANTINE), store("states", STATES)

    def _kept(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Written under the batch's own folder; a repeat overwrites it."""
        path = f"{self.path}/work/{batch_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def claimed(self, batch: DataFrame) -> DataFrame:
        """Files of the batch's materials that are to be processed, with ``digest`` and ``run_key`` of their material."""
        named = batch.filter("material_id is not null")
        entry = F.xxhash64("path", "text")  # order does not matter, so no material is gathered
        digests = named.groupBy("material_id").agg(F.concat_ws(":", F.sum(entry.cast("decimal(38,0)")).cast("string"), F.count(F.lit(1)).cast("string")).alias("digest"))
        digests = digests.withColumn("run_key", T.run_key("material_id", F.lit(self.version)))
        done = self.states.lookup(digests.select("material_id")).filter("status = 'ready'").select("material_id", "digest", "run_key")
        return named.join(digests.join(done, ["material_id", "digest", "run_key"], "left_anti"), "material_id")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        tag = f"batch {batch_id}"
        if self.states.has(tag):
            return
        files = self._kept(self.claimed(batch), "files", batch_id)
        decided = corpus.classify(files, "material_id", "path").select("material_id", F.col("type").alias("type"), "subtype")
        classes = self._kept(decided, "classes", batch_id)

        unsafe, unread = T.unsafe_path("path"), F.col("text").isNull()
        stopped = files.filter(F.col("path").isNull() | unsafe | unread).select("material_id", "path", F.lit("load").alias("stage"), F.when(unread, "no text").otherwise("unsafe path").alias("error"))
        readable = files.filter(F.col("path").isNotNull() & ~unsafe & ~unread).join(classes, "material_id")
        found = self._kept(extracted_by(readable, self.extract) if self.extract else extracted(readable), "extracted", batch_id)
        failures = stopped.unionByName(found.filter("error is not null").select("material_id", "path", F.lit("extract").alias("stage"), "error"))
        failures = self._kept(failures.withColumn("batch_id", F.lit(batch_id).cast("long")), "failures", batch_id)

        failed = failures.select("material_id").distinct()
        good = lambda df: df.join(failed, "material_id", "left_anti")
        units = self._kept(good(found).drop("error"), "units", batch_id)
        materials = good(files.groupBy("material_id").agg(F.first("source").alias("source"), F.first("root_path").alias("root_path"), F.count(F.lit(1)).alias("files"), F.first("digest").alias("digest"), F.first("run_key").alias("run_key")))
        materials = self._kept(materials.join(classes, "material_id"), "materials", batch_id)
        analyses = self._kept(self._analyzed(materials, units, good(files)), "analyses", batch_id)
        ready = materials.select("material_id")

        self.points.replace(self._points(materials, units, analyses), ready, tag)
        self.analyses.replace(analyses, ready, tag)
        self.quarantine.replace(failures, files.select("material_id").distinct(), tag)
        self.states.replace(self._states(materials, units, files, failures, classes, batch_id), tag=tag)

    def _analyzed(self, materials: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
        named = materials.select("material_id", corpus.material_name("root_path", F.lit(None)).alias("name"), F.lit(None).cast("string").alias("version"), F.col("type").alias("material_type"), "subtype")
        placed = numbered(units, ["material_id"], ["path", "line_start"]).select("material_id", F.col("number").alias("pos"), F.col("section").alias("title"), F.col("content").alias("text"))
        listed = numbered(files, ["material_id"], ["path"]).select("material_id", "path", F.col("number").alias("pos"), "text")
        found = profile.analyzed(named, placed, listed, "material_id", self.analyzer)
        sizes = units.groupBy("material_id").agg(F.sum(T.token_count("content")).alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("deep"))
        j = found.join(named.select("material_id", "material_type", "subtype"), "material_id").join(sizes, "material_id", "left").na.fill(0, ["tokens", "n", "deep"])
        j = j.join(listed.filter(corpus.eligible("path")).groupBy("material_id").agg(F.count(F.lit(1)).alias("scanned")), "material_id", "left").na.fill(0, ["scanned"])
        kind = F.when(F.coalesce("subtype", F.lit("")).isin(*corpus.ARTIFACTS), "artifact").otherwise(F.col("material_type"))
        return j.withColumn("c", profile.coverage(kind, F.col("tokens"), F.col("deep"), F.col("scanned"), F.col("n"))).withColumns({"mode": F.col("c.mode"), "ratio": F.col("c.ratio")}).select(*schema(ANALYSES).names)

    def _points(self, materials: DataFrame, units: DataFrame, analyses: DataFrame) -> DataFrame:
        unit = T.unit_id("path", F.lit(None).cast("int"), "line_start", "line_end")
        own = units.select("material_id", unit.alias("unit"), "path", "section", "line_start", "line_end", "content")
        card = index.card_text("root_path", "keywords", "topics")
        none = lambda kind: F.lit(None).cast(kind)
        cards = materials.join(analyses, "material_id").select("material_id", F.lit(CARD).alias("unit"), none("string").alias("path"), none("string").alias("section"), none("int").alias("line_start"), none("int").alias("line_end"), card.alias("content"))
        return own.unionByName(cards).withColumn("point_key", T.point_key("material_id", "unit"))

    def _states(self, materials: DataFrame, units: DataFrame, files: DataFrame, failures: DataFrame, classes: DataFrame, batch_id: int) -> DataFrame:
        counts = units.groupBy("material_id").agg(F.count(F.lit(1)).alias("units"))
        ready = materials.join(counts, "material_id", "left").select(
            "material_id", F.lit("ready").alias("status"), F.col("type").alias("material_type"), "subtype", "files", F.coalesce("units", F.lit(0).cast("long")).alias("units"), "digest", "run_key", F.lit(None).cast("string").alias("error")
        )
        first = failures.groupBy("material_id").agg(F.min(F.struct("path", "error"))["error"].alias("error"))
        lost = files.groupBy("material_id").agg(F.count(F.lit(1)).alias("files"), F.first("digest").alias("digest"), F.first("run_key").alias("run_key")).join(first, "material_id").join(classes, "material_id")
        failed = lost.select("material_id", F.lit("failed").alias("status"), F.col("type").alias("material_type"), "subtype", "files", F.lit(0).cast("long").alias("units"), "digest", "run_key", "error")
        return ready.unionByName(failed).withColumn("batch_id", F.lit(batch_id).cast("long")).select(*schema(STATES).names)

    def run(self, stream: DataFrame) -> None:
        """Process what has arrived on a stream of files; its checkpoint lies beside the stores."""
        ingest.each_batch(stream, self.process, f"{self.path}/checkpoint")
