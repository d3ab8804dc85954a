"""Evidence budgets, findings, coverage, validation, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# Calls, evidence per question and in total, by mode.
BUDGETS = {"quick": (3, 8, 24), "standard": (8, 20, 80), "deep": (16, 20, 160)}
NO_EVIDENCE = "No evidence retrieved."
LOCATION = ["material_id", "path", "page", "line_start", "line_end"]


def budget(hits: DataFrame, run: str, question: str, order: list[str], mode: str = "standard") -> DataFrame:
    """At most the mode's calls per run, items per question, then items per run, in order."""
    calls, per_question, total = BUDGETS[mode]
    asked = F.dense_rank().over(Window.partitionBy(run).orderBy(question))
    nth = F.row_number().over(Window.partitionBy(run, question).orderBy(*order))
    some = hits.withColumn("_q", asked).filter(F.col("_q") <= calls).withColumn("_n", nth).filter(F.col("_n") <= per_question)
    overall = F.row_number().over(Window.partitionBy(run).orderBy("_q", "_n"))
    return some.withColumn("_t", overall).filter(F.col("_t") <= total).withColumn("evidence_no", F.col("_n")).drop("_q", "_n", "_t")


def normalized(text: str | Column) -> Column:
    return F.lower(T.collapse(text))


def findings(evidence: DataFrame, question: str, pos: str) -> DataFrame:
    """Per question with evidence: claim of up to four distinct findings with citations, id lists, confidence.

    evidence(question, pos, evidence_id, finding, citation, stance).
    """
    against = F.col("stance") == "contradicts"
    counted = evidence.withColumn("_s", F.count_if(~against).over(Window.partitionBy(question)))
    used = counted.filter(~against | (F.col("_s") == 0))
    first = used.groupBy(question, normalized("finding").alias("_k")).agg(F.min(F.struct(pos, "finding", "citation")).alias("f"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(f"f.{pos}"))).filter("_n <= 4")
    claim = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("f.finding", F.lit(" ("), "f.citation", F.lit(")")).alias("c")))), lambda x: x["c"]), "; ")
    claims = ranked.groupBy(question).agg(claim.alias("claim"))
    ids = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(pos, "evidence_id")))), lambda x: x["evidence_id"].cast("string")), ",")
    lists = evidence.groupBy(question).agg(ids(~against).alias("supporting"), ids(against).alias("contradicting"), F.when(F.bool_or(against), 0.5).otherwise(0.9).alias("confidence"))
    return claims.join(lists, question)


def question_coverage(questions: DataFrame, evidence: DataFrame, run: str, question: str) -> DataFrame:
    """covered, gap, pending or unresolved per question(run, question, comparative, iterations)."""
    per = evidence.groupBy(run, question).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("material_id").alias("materials"))
    total = evidence.groupBy(run).agg(F.countDistinct("material_id").alias("available"))
    q = questions.join(per, [run, question], "left").join(total, run, "left").na.fill(0, ["items", "materials", "available"])
    one_sided = F.col("comparative") & (F.col("materials") < 2) & (F.col("available") > 1) & (F.col("iterations") < 2)
    status = F.when((F.col("items") > 0) & one_sided, "gap").when(F.col("items") > 0, "covered").when(F.col("iterations") == 0, "pending").when(F.col("iterations") < 2, "gap").otherwise("unresolved")
    return q.withColumn("status", status)


#: Fixed value: the id under which a material's card is stored beside its units.
CARD = "__material__"


def unit_ok(citation: str, path: str, page: str, line_start: str, line_end: str, card: str = CARD) -> Column:
    """Not a material card, and has a page, both line bounds or a path."""
    c, p = F.coalesce(F.col(citation), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    return ~((F.trim(c) == card) | (p == card)) & (F.col(page).isNotNull() | (F.col(line_start).isNotNull() & F.col(line_end).isNotNull()) | (p != ""))


def allowed_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Report citations whose location occurs in the evidence; null-safe on page and lines."""
    ok = unit_ok("citation", "path", "page", "line_start", "line_end")
    keys = evidence.filter(ok).select(*[F.col(c).alias(f"e_{c}") for c in LOCATION]).distinct()
    same = F.lit(True)
    for c in LOCATION:
        same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return citations.filter(ok).join(keys, same, "left_semi")


def valid_findings(found: DataFrame, evidence: DataFrame, finding: str) -> DataFrame:
    """Findings with at least one eligible item among their evidence.

    found(finding, supporting array, contradicting array, ...), evidence(evidence_id and the location columns).
    """
    ok = evidence.filter(unit_ok("citation", "path", "page", "line_start", "line_end")).select(F.col("evidence_id").alias("_e")).distinct()
    cited = found.select(finding, F.explode(F.array_distinct(F.concat("supporting", "contradicting"))).alias("_e"))
    return found.join(cited.join(ok, "_e").select(finding).distinct(), finding, "left_semi")


def valid_sections(sections: DataFrame, evidence: DataFrame, citations: DataFrame, run: str, section: str) -> DataFrame:
    """Sections with their eligible citation keys only; one that is left without keys, in a run without any eligible
    citation, has the fixed body.

    sections(run, section, keys array, body, ...), evidence(evidence_id and locations), citations(run, ...): the report's
    citations after :func:`allowed_citations`.
    """
    ok = evidence.filter(unit_ok("citation", "path", "page", "line_start", "line_end")).select(F.col("evidence_id").alias("_e")).distinct()
    keyed = sections.select(run, section, F.posexplode("keys").alias("_p", "_e")).join(ok, "_e")
    kept = keyed.groupBy(run, section).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_e"))), lambda x: x["_e"]).alias("_keys"))
    cited = citations.filter(unit_ok("citation", "path", "page", "line_start", "line_end")).select(run, F.lit(True).alias("_cited")).distinct()
    j = sections.join(kept, [run, section], "left").join(cited, run, "left")
    bare = F.col("_keys").isNull() & F.col("_cited").isNull() & ~F.col("body").contains("No evidence")
    j = j.withColumn("body", F.when(bare, F.lit(NO_EVIDENCE)).otherwise(F.col("body")))
    return j.withColumn("keys", F.coalesce("_keys", F.slice("keys", 1, 0))).drop("_keys", "_cited")


def sections(questions: DataFrame, found: DataFrame, question: str) -> DataFrame:
    """Body of each question's section: its claim, or the fixed line without evidence."""
    return questions.join(found.select(question, "claim"), question, "left").withColumn("body", F.coalesce("claim", F.lit(NO_EVIDENCE))).drop("claim")


def report(parts: DataFrame, run: str, question: str, heading: str, objective: str) -> DataFrame:
    """Objective, sections in order and summary as one text per run."""
    text = F.concat(F.lit("## "), F.col(question).cast("string"), F.lit(" "), heading, F.lit("\n"), "body")
    listed = parts.groupBy(run, objective).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(question).alias("q"), text.alias("t")))), lambda x: x["t"]), "\n\n").alias("middle"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("body").contains("No evidence"), F.struct(F.col(question).alias("q"), F.col(heading).alias("h"))))), lambda x: x["h"]), "; ").alias("covered"),
    )
    summary = F.when(F.col("covered") == "", F.concat(objective, F.lit(". Insufficient evidence."))).otherwise(F.concat(objective, F.lit(". Covered: "), "covered", F.lit(".")))
    return listed.select(run, F.concat(F.lit("# "), objective, F.lit("\n\n"), "middle", F.lit("\n\n## Summary\n"), summary, F.lit("\n")).alias("report"))


def trim_questions(questions: DataFrame, run: str, question: str, pos: str, limit: int) -> DataFrame:
    """First row of each question id per run (blank ids are numbered), the first ``limit``."""
    numbered = questions.withColumn(question, F.when(F.trim(question) == "", F.concat(F.lit("Q"), F.row_number().over(Window.partitionBy(run).orderBy(pos)).cast("string"))).otherwise(F.col(question)))
    first = numbered.withColumn("_n", F.row_number().over(Window.partitionBy(run, question).orderBy(pos))).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(pos))).filter(F.col("_n") <= limit).drop("_n")
