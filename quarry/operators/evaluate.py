"""Retrieval scoring: matches, hit@1, recall, MRR."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of cases in one automaton.
BLOCK_CHARS = 2_000_000


def containing(cases: DataFrame, docs: DataFrame, case: str, doc: str, text: str = "text") -> DataFrame:
    """(case, doc) pairs where the document contains the case's text; nulls on either side give no pair.

    The texts of all cases are one Aho-Corasick automaton, and every document is read once against it, whatever their script or
    length; an empty text is in every document. Cases of more than ``BLOCK_CHARS`` characters take a pass for each block of
    that size. Nothing is shuffled.
    """
    asked = cases.filter(F.col(text).isNotNull() & F.col(case).isNotNull()).select(case, F.col(text).alias("_t")).distinct()
    slim = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).filter("t is not null and d is not null")
    size = asked.agg(F.sum(F.length("_t") + 1)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        part = _scanned(asked.filter(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == k), slim, case, doc, dict(docs.dtypes)[doc])
        out = part if out is None else out.unionByName(part)
    return out


def automaton(texts: dict[str, list]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for own, ids in texts.items():
        if own:
            found.add_word(own, ids)
    if len(found):
        found.make_automaton()
    return found


def _scanned(cases: DataFrame, docs: DataFrame, case: str, doc: str, doc_type: str) -> DataFrame:
    texts: dict[str, list] = {}
    for r in cases.collect():  # about BLOCK_CHARS characters
        texts.setdefault(r["_t"], []).append(r[case])
    known, name = docs.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = sys.modules.setdefault("_quarry_automata", types.ModuleType("_quarry_automata")).__dict__
        if kept.get("name") != name:  # one automaton a worker, shared by its tasks
            kept.update(name=name, found=automaton(known.value))
        found, everywhere = kept["found"], known.value.get("", [])
        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"], strict=True):
                met = {id(ids): ids for _, ids in found.iter(t)} if len(found) else {}
                rows += [(c, d) for ids in (*met.values(), everywhere) for c in ids]
            yield pd.DataFrame(rows, columns=[case, doc])

    return docs.mapInPandas(run, f"{case} {dict(cases.dtypes)[case]}, {doc} {doc_type}")


def score_citations(cases: DataFrame, expect: DataFrame, hits: DataFrame) -> DataFrame:
    """Scores of cited hits against expectations: expected, found, rank of the first match (0: none), hit_at_1, recall.

    cases(case_id, k, ...), expect(case_id, expect_no, expected struct), hits(case_id, rank, path, citation, page,
    line_start, section); only the first ``k`` hits of a case count.
    """
    top = hits.join(cases.select("case_id", "k"), "case_id").filter("rank <= k")
    met = expect.join(top, "case_id").filter(matches("path", "citation", "page", "line_start", "section", F.col("expected")))
    found = met.groupBy("case_id").agg(F.count_distinct("expect_no").alias("found"), F.min("rank").alias("rank"))
    total = expect.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    out = cases.join(total, "case_id", "left").join(found, "case_id", "left").na.fill(0, ["expected", "found", "rank"])
    return out.withColumn("hit_at_1", F.col("rank") == 1).withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0))


def score_selector(cases: DataFrame, expect: DataFrame, select: Callable[[DataFrame], DataFrame], modes: tuple[str, ...] | None = None) -> DataFrame:
    """Selector hook: ``select(cases)`` answers a table of cases (case_id, query, k, material_type) with the hits that
    :func:`score_citations` takes; only cases of ``modes`` are asked."""
    asked = cases if modes is None else cases.filter(F.col("mode").isin(*modes))
    return score_citations(asked, expect, select(asked))


def matches(path: str | Column, citation: str | Column, page: str | Column, line_start: str | Column, section: str | Column, expected: Column) -> Column:
    """Whether a citation meets ``expected`` (struct path, page, lines, section; nulls ask nothing)."""
    haystack = F.concat_ws(" ", F.coalesce(T.col(path), F.lit("")), T.col(citation))
    return (
        haystack.contains(expected["path"])
        & (expected["page"].isNull() | T.col(page).eqNullSafe(expected["page"]))
        & (~F.coalesce(expected["lines"], F.lit(False)) | T.col(line_start).isNotNull())
        & (expected["section"].isNull() | T.col(section).eqNullSafe(expected["section"]))
    )


def score_cases(cases: DataFrame, expect: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: expected, found, rank of the first match (0: none), hit_at_1, recall."""
    met = expect.join(hits.select("case_id", "doc_id", "rank"), ["case_id", "doc_id"], "left")
    counted = met.groupBy("case_id").agg(F.countDistinct("doc_id").alias("expected"), F.countDistinct(F.when(F.col("rank").isNotNull(), F.col("doc_id"))).alias("found"), F.min("rank").alias("rank"))
    out = cases.join(counted, "case_id", "left").na.fill(0, ["expected", "found", "rank"])
    return out.withColumn("hit_at_1", F.col("rank") == 1).withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0))


def by_mode(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Cases, hits at rank 1 and mean reciprocal rank per group."""
    reciprocal = F.when(F.col("rank") > 0, F.lit(1.0) / F.col("rank")).otherwise(0.0)
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if("hit_at_1").alias("hits_at_1"), F.avg(reciprocal).alias("mrr"))
