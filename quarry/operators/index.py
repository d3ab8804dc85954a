"""Hashed sparse and dense index over text units, and its replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def postings(units: DataFrame, key: str, text: str, dim: int, fill_empty: bool = False) -> DataFrame:
    """(key, idx, tf): counts by hashed token. Grouped after the modulus, so collisions add up.

    ``fill_empty`` gives units without tokens the entry (0, 1), as the sparse vector has it.
    """
    found = units.select(key, F.explode(T.tokens(text)).alias("token")).select(key, T.token_bucket("token", dim).alias("idx"))
    counted = found.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("tf"))
    if not fill_empty:
        return counted
    empty = units.filter(T.token_count(text) == 0).select(key, F.lit(0).cast("long").alias("idx"), F.lit(1).cast("long").alias("tf"))
    return counted.unionByName(empty)


def normed(posts: DataFrame, key: str) -> DataFrame:
    """Postings with the squared norm of their unit (exact, as counts are whole numbers)."""
    norms = posts.groupBy(key).agg(F.sum(F.col("tf") * F.col("tf")).alias("norm2"))
    return posts.join(norms, key)


def merge_sparse(weights: DataFrame, key: str, token: str, weight: str, dim: int) -> DataFrame:
    """Token weights folded to hashed indices."""
    return weights.groupBy(key, T.token_bucket(token, dim).alias("idx")).agg(F.sum(weight).alias("weight"))


def unit_text(metadata: dict[str, str | Column], lists: dict[str, str | Column], content: str | Column) -> Column:
    """Non-blank metadata values, up to 24 items of each list, then the content."""
    own = [F.nullif(F.trim(T.col(v)), F.lit("")) for v in metadata.values()]
    many = [F.array_join(F.filter(F.slice(T.col(v), 1, 24), lambda x: x != ""), " ") for v in lists.values()]
    return F.regexp_replace(F.concat_ws(" ", *own, *[F.nullif(m, F.lit("")) for m in many], T.col(content)), r"(?U)^\s+|\s+$", "")


def merge_metadata(units: DataFrame, extra: DataFrame, path: str, metadata: str) -> DataFrame:
    """Units with the fields of ``extra(path, fields map)`` of their file; these win over fields of the same name."""
    j = units.join(extra.select(path, F.col("fields").alias("_f")), path, "left")
    given = F.coalesce("_f", F.create_map().cast("map<string,string>"))
    return j.withColumn(metadata, F.map_concat(F.map_filter(metadata, lambda k, _: ~F.map_contains_key(given, k)), given)).drop("_f")


def card_text(root: str | Column, keywords: str | Column, topics: str | Column) -> Column:
    """A material's card: root path, first 24 keywords, first 12 topics."""
    parts = F.concat(F.array(T.col(root)), F.slice(T.col(keywords), 1, 24), F.slice(T.col(topics), 1, 12))
    return F.trim(F.array_join(parts, " "))


def replace_points(old: DataFrame, new: DataFrame, key: str = "material_id") -> DataFrame:
    """All points of the materials in ``new`` are replaced, the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def count_points(points: DataFrame, key: str = "material_id") -> DataFrame:
    """Points of every material."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("points"))


def wipe(points: DataFrame) -> DataFrame:
    """The empty index with the same columns."""
    return points.filter(F.lit(False))
