"""Queries that cut documents and conversations into units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluate, search, segment
from quarry.plans.common import lines_sql, query, tokens_sql
from quarry.session import table, written

SHORT = "[A-Za-z]+[.]?"


@query(f"""
WITH l AS (
  SELECT doc_id, unnest({lines_sql('text')}) AS line, generate_subscripts({lines_sql('text')}, 1) AS n FROM documents),
m AS (SELECT *, regexp_full_match(line, '{SHORT}') AS mark FROM l),
s AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section_no FROM m)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(line) FILTER (WHERE mark) AS heading, sha256(string_agg(line, chr(10) ORDER BY n)) AS digest,
       min(n) AS line_start, max(n) AS line_end FROM s GROUP BY ALL
UNION ALL SELECT doc_id, 0, NULL, sha256(''), 1, 1 FROM documents WHERE coalesce(text, '') = ''
""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: sections at one-word lines of every document."""
    cut = segment.sections(table(spark, sf_dir, "documents"), "doc_id", "text", lambda line: line.rlike(f"^{SHORT}$"), lambda line: line)
    return cut.select("doc_id", "section_no", "heading", F.sha2("content", 256).alias("digest"), "line_start", "line_end")


@query()
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9: windows of 512 tokens with an overlap of 64 over every document."""
    cut = segment.token_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", "window_no", "line_start", "line_end", "tokens", F.sha2("content", 256).alias("digest"))


GROUP_SQL = """
WITH RECURSIVE u AS (
  SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {pos}) AS n, {pos} AS pos, {size} AS size, {flag} AS flag FROM {tbl}),
g AS (
  SELECT k, n, pos, size AS used, 0 AS group_no FROM u WHERE n = 1
  UNION ALL
  SELECT u.k, u.n, u.pos,
         CASE WHEN g.used + u.size > {target} OR (u.flag AND g.used >= {early}) THEN u.size ELSE g.used + u.size END,
         CASE WHEN g.used + u.size > {target} OR (u.flag AND g.used >= {early}) THEN g.group_no + 1 ELSE g.group_no END
  FROM g JOIN u ON u.k = g.k AND u.n = g.n + 1)
SELECT k AS {key}, pos AS {out}, group_no FROM g
"""


@query(GROUP_SQL.format(key="conv_id", pos="turn", out="turn", size=f"greatest(len({tokens_sql('text')}), 1)", flag=r"regexp_matches(ltrim(CASE WHEN role = 'user' THEN [' ## ', 'Chapter 7 ', 'section 12: ', '#', 'Chapter '][turn % 5 + 1] ELSE '' END || coalesce(text, '')), '(?i)^(#{1,6}\s|chapter\s+\d|section\s+\d)')", tbl="conversations", target=120, early=72))
def unit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: turns packed to 120 tokens; a turn that begins like a heading starts a section (user turns are given such words)."""
    led = F.when(F.col("role") == "user", F.element_at(F.array(*map(F.lit, (" ## ", "Chapter 7 ", "section 12: ", "#", "Chapter "))), (F.col("turn") % 5 + 1).cast("int"))).otherwise("")
    starts = segment.section_start(F.concat(led, F.coalesce("text", F.lit(""))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(T.token_count("text"), F.lit(1)).alias("size"), starts.alias("start"))
    return segment.greedy_groups(turns, "conv_id", "turn", "size", 120, "start")


@query(GROUP_SQL.format(key="conv_id", pos="turn", out="turn", size="greatest(coalesce(length(text), 0), 1)", flag="false", tbl="conversations", target=800, early=0))
def evidence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: consecutive texts packed to 800 characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).alias("size"))
    return segment.greedy_groups(turns, "conv_id", "turn", "size", 800)


@query(f"""
WITH l AS (SELECT doc_id, source || '/' || lang AS material_id, unnest({lines_sql('text')}) AS line, generate_subscripts({lines_sql('text')}, 1) AS n FROM documents)
SELECT material_id, doc_id, n AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index,
 CASE WHEN material_id LIKE '%/en' THEN CASE doc_id % 4 WHEN 0 THEN 'document.window' WHEN 1 THEN 'stub' WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'document.sections' ELSE 'document.window' END ELSE 'document.pages' END
  WHEN material_id LIKE '%/de' THEN CASE WHEN doc_id % 4 = 1 THEN 'stub' ELSE 'table' END WHEN doc_id % 4 = 1 THEN 'stub' WHEN material_id LIKE '%/fr' THEN CASE WHEN doc_id % 8 = 2 THEN 'code.symbol' ELSE 'code.file' END ELSE 'passthrough' END AS strategy FROM l
""")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: strategy by type, running number per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("material_id"), "lang", "text")
    kind = F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "dataset").when(F.col("lang") == "fr", "code").otherwise("unknown")
    subtype = F.element_at(F.array(*map(F.lit, ("text", "doc", "markdown", "pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    some = F.col("doc_id") % 8 == 2
    split = d.select("material_id", "doc_id", segment.strategy(kind, subtype, some, some).alias("strategy"), F.posexplode(T.lines("text")).alias("p", "line"))
    return segment.number_chunks(split.withColumn("line_no", F.col("p") + 1), "doc_id", ["line_no"]).select("material_id", "doc_id", "line_no", "chunk_index", "strategy")


@query()
def unit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: every document as a unit of one of five types, cut by its strategy, small pieces passed through."""
    types = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(x).alias("x")) for t, s, x in (("document", "text", ".txt"), ("document", "markdown", ".md"), ("code", "py", ".py"), ("dataset", "csv", ".csv"), ("code", "python_wheel", ".whl"))]), (F.col("doc_id") % 5 + 1).cast("int"))
    marked = F.array_join(F.transform(T.lines("text"), lambda line, i: F.when(i % 5 == 3, F.concat(F.lit("## "), line)).otherwise(line)), "\n")
    coded = F.array_join(F.transform(T.lines("text"), lambda line, i: F.when(i % 4 == 2, F.concat(F.lit("def f"), i.cast("string"), F.lit("():"))).otherwise(F.concat(F.lit("  "), line))), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("material_id"), types.alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    content = F.when(F.col("y.s") == "markdown", marked).when(F.col("y.s") == "py", coded).otherwise(F.col("text"))
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.col("y.x"))
    none = F.lit(None)
    units = d.select("doc_id", "material_id", F.col("y.t").alias("material_type"), F.col("y.s").alias("subtype"), path.alias("path"), none.cast("int").alias("page"), none.cast("string").alias("section"), F.lit(1).alias("line_start"), content.alias("content"))
    return segment.cut_units(units, "doc_id", "material_id", ["doc_id"], 256, 32).withColumn("content", F.sha2("content", 256))


def _as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: the first words of every line become a symbol, a decorator or a body line."""
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".go"), F.lit(".js")), (F.col("doc_id") % 3 + 1).cast("int"))
    word = lambda line: F.regexp_replace(F.regexp_extract(line, r"[A-Za-z]+", 0), "^$", "x")
    start = F.when(F.col("doc_id") % 3 == 0, "def ").when(F.col("doc_id") % 3 == 1, "func ").otherwise("function ")
    code = F.transform(T.lines("text"), lambda line, i: F.when(i % 4 == 2, F.concat(start, word(line), F.lit("():"))).when(i % 4 == 1, F.concat(F.lit("@"), word(line))).otherwise(F.concat(F.lit("  "), line)))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext).alias("path"), F.array_join(code, "\n").alias("code"))


@query(f"""
WITH l AS (SELECT doc_id, unnest({lines_sql('text')}) AS line, generate_subscripts({lines_sql('text')}, 1) AS n, len({lines_sql('text')}) AS total FROM documents),
s AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN n ELSE n - 1 END AS line_start, total,
         CASE WHEN regexp_extract(line, '[A-Za-z]+') = '' THEN 'x' ELSE regexp_extract(line, '[A-Za-z]+') END AS symbol FROM l WHERE (n - 1) % 4 = 2),
u AS (
  SELECT doc_id, symbol, line_start, coalesce(lead(line_start) OVER (PARTITION BY doc_id ORDER BY line_start) - 1, total) AS line_end FROM s)
SELECT * FROM u
UNION ALL SELECT doc_id, NULL, 1, min(line_start) - 1 FROM u GROUP BY doc_id
""")
def symbol_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8: symbols with their decorators in documents written as code."""
    return segment.symbols(_as_code(spark, sf_dir), "doc_id", "path", "code").select("doc_id", "symbol", "line_start", "line_end")


@query(f"""
WITH l AS (SELECT doc_id, unnest({lines_sql('text')}) AS line, generate_subscripts({lines_sql('text')}, 1) AS n FROM documents),
s AS (SELECT *, CAST(floor((n - 1 + 2) / 5) AS BIGINT) AS section_no FROM l)
SELECT doc_id, section_no, trim(max(line) FILTER (WHERE (n - 1) % 5 = 3)) AS heading, min(n) AS line_start, max(n) AS line_end FROM s GROUP BY ALL
UNION ALL SELECT doc_id, 0, NULL, 1, 1 FROM documents WHERE coalesce(text, '') = ''
""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7 for markdown: every fifth line of a document made a heading."""
    marked = F.array_join(F.transform(T.lines("text"), lambda line, i: F.when(i % 5 == 3, F.concat(F.lit("## "), line)).otherwise(line)), "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", marked.alias("md"))
    return segment.markdown_sections(docs, "doc_id", "md").select("doc_id", "section_no", "heading", "line_start", "line_end")


@query(f"""
WITH b AS (SELECT conv_id, turn, role = 'user' AS h, text, greatest(len({lines_sql('text')}), 1) AS n FROM conversations),
s AS (SELECT *, sum(h::INT) OVER w AS section_no, sum(n) OVER w AS last FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(section_no AS BIGINT) AS section_no, trim(max(text) FILTER (WHERE h)) AS heading, CAST(min(last - n) + 1 AS BIGINT) AS line_start, CAST(max(last) AS BIGINT) AS line_end
FROM s GROUP BY ALL
""")
def block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN22: turns as blocks, user turns as headings."""
    turns = table(spark, sf_dir, "conversations").withColumn("h", F.col("role") == "user")
    return segment.block_sections(turns, "conv_id", "turn", "h", "text").drop("content")


def _scored(spark: SparkSession, sf_dir: str, size: int, cases: DataFrame, expect: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits at 1, mean reciprocal rank and units of one chunk size, by mode."""
    windows = segment.token_windows(table(spark, sf_dir, "documents"), "doc_id", "text", size).select((F.col("doc_id") * 1_000_000 + F.col("window_no")).alias("unit"), "content")
    windows = written(spark, windows, "windows")
    top = search.top_points(windows, "unit", "content", asked, "item_id", "asked", 5, lists=("dense",))
    hits = top.groupBy(F.col("item_id").alias("case_id"), F.expr("unit div 1000000").alias("doc_id")).agg(F.min("rank").alias("rank"))
    scored = evaluate.by_mode(evaluate.score_cases(cases, expect, hits), ["mode"])
    return scored.crossJoin(F.broadcast(windows.agg(F.count(F.lit(1)).alias("units")))).withColumn("chunk_tokens", F.lit(size))  # one row


@query()
def chunk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: for each chunk size, units rebuilt, retrieval scored again, one row per size and mode."""
    b = table(spark, sf_dir, "benchmark")
    cases = b.select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("semantic").alias("mode"), "text")
    expect = written(spark, evaluate.containing(cases, table(spark, sf_dir, "documents"), "case_id", "doc_id"), "expected")
    asked = b.select("item_id", F.col("text").alias("asked"))
    parts = [_scored(spark, sf_dir, size, cases.select("case_id", "mode"), expect, asked) for size in (256, 1024)]
    return parts[0].unionByName(parts[1])
