"""Pipeline state as tables: latest rows, upserts, claims, snapshots, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLAIMABLE = ("processing", "discovered", "failed", "ready")
OPEN = ("claimed", "running")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key: one aggregate, no window over whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mutable: list[str], keep: list[str]) -> DataFrame:
    """Full outer join on identity: ``mutable`` from the new row if there is one, ``keep`` from the old."""
    same = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in mutable + keep], F.lit(True).alias("_old"))
    fresh = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in mutable + keep], F.lit(True).alias("_new"))
    j = same.join(fresh, keys, "full_outer")
    put = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in mutable]
    held = [F.when(F.col("_old"), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in keep]
    return j.select(*keys, *put, *held)


def claim_oldest(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The oldest ``limit`` discovered rows, as processing. Spark keeps ``limit`` rows per task before merging."""
    return rows.filter("status = 'discovered'").orderBy("created_at", key).limit(limit).withColumn("status", F.lit("processing"))


def claimable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status").isin(*CLAIMABLE))


def open_run_check(wanted: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Wanted runs whose material has no claimed or running latest run."""
    busy = latest(runs, [key], ["created_at", "run_no"]).filter(F.col("status").isin(*OPEN))
    return wanted.join(busy.select(key), key, "left_anti")


def snapshot_diff(now: DataFrame, before: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows whose mark is new or changed since the snapshot ``before``."""
    return now.join(before.select(F.col(key), F.col(mark)), [key, mark], "left_anti")


def register_new(batch: DataFrame, known: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """First row of each digest in the batch that is not known yet."""
    rest = [c for c in batch.columns if c != digest]
    first = batch.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(digest, "_r.*")
    return first.join(known.select(digest), digest, "left_anti")


def duplicate_groups(rows: DataFrame, digest: str, key: str) -> DataFrame:
    return rows.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first"))


def quality_errors(rows: DataFrame, key: list[str], rules: dict[str, object]) -> DataFrame:
    """(key, rule) for every aggregated rule that holds: all rules in one aggregate, then exploded."""
    checked = rows.groupBy(*key).agg(*[F.bool_or(cond).alias(name) for name, cond in rules.items()])
    hits = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in rules]), lambda x: x.isNotNull())
    return checked.select(*key, F.explode(hits).alias("rule"))


def expected_missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key).distinct(), key, "left_anti")


def processing_errors(units: DataFrame, expected: DataFrame, material: str) -> DataFrame:
    """(material, rule) where the units of a material break what is expected of it.

    units(material, pos, path, page, content), expected(material, deep, scanned, mode: what its profile says; want_mode, max_files,
    min_scanned, min_pages, first_phrase, phrase, one_unit: what must hold, null where nothing is asked). All rules
    come from one aggregate per material.
    """
    page, path = F.col("page"), F.coalesce("path", F.lit(""))
    asked = expected.select(material, *[c for c in expected.columns if c != material])
    known = units.join(asked.select(material, "first_phrase", "phrase"), material)
    seen = known.groupBy(material).agg(
        F.count(F.lit(1)).alias("units"), F.count_distinct(F.nullif(path, F.lit(""))).alias("files"), F.count_distinct("page").alias("pages"),
        F.bool_or(path.startswith("tests/") | path.contains("/tests/")).alias("tests"), F.bool_or(F.coalesce("content", F.lit("")).contains(F.col("phrase"))).alias("has_phrase"),
        F.min_by(F.coalesce("content", F.lit("")).contains(F.col("first_phrase")), F.when(page == 1, F.col("pos"))).alias("has_first"),  # of the first unit on page 1
    )
    j = asked.join(seen, material, "left").na.fill(0, ["units", "files", "pages"])
    rules = {
        "deep_cap": F.col("deep") > F.col("max_files"), "scanned": F.col("min_scanned").isNotNull() & (F.coalesce("scanned", F.lit(0)) <= F.col("min_scanned")),
        "indexed_cap": F.col("files") > F.col("max_files"), "tests_indexed": F.col("max_files").isNotNull() & F.col("tests"), "pages": F.col("pages") < F.col("min_pages"),
        "first_phrase": F.col("first_phrase").isNotNull() & ~F.coalesce("has_first", F.lit(False)), "phrase": F.col("phrase").isNotNull() & ~F.coalesce("has_phrase", F.lit(False)),
        "mode": F.col("want_mode").isNotNull() & ~F.col("want_mode").eqNullSafe(F.col("mode")), "one_unit": F.coalesce("one_unit", F.lit(False)) & (F.col("units") != 1),
    }
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return j.select(material, F.explode(hits).alias("rule"))


def citation_errors(citations: DataFrame, card: str) -> DataFrame:
    """Citations(citation, path, ...) that name a material's ``card`` instead of a unit of it."""
    return citations.filter((F.coalesce("citation", F.lit("")) == card) | (F.coalesce("path", F.lit("")) == card))
