"""Queries over single texts: tokens, postings, keys, fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evidence, index
from quarry.plans.common import bucket_sql, clip_sql, keywords_sql, lines_sql, query, tokens_sql
from quarry.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS tokens, greatest(len({lines_sql('text')}), 1) AS lines FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, FN2, FN9."""
    return _docs(spark, sf_dir).select("doc_id", T.token_count("text").alias("tokens"), T.line_count("text").alias("lines"))


@query(f"SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1: occurrences and documents of every token, which is one row per document before it counts."""
    per = _docs(spark, sf_dir).select("doc_id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("docs"))


@query(f"SELECT doc_id, {bucket_sql('token', T.SPARSE_DIM)} AS idx, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE len({tokens_sql('text')}) = 0")
def hashed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3, FN4: sparse vectors."""
    return index.postings(_docs(spark, sf_dir), "doc_id", "text", T.SPARSE_DIM, fill_empty=True)


@query(f"SELECT source AS k, {bucket_sql('lang', 16)} AS idx, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY ALL")
def sparse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5: token weights folded to indices."""
    return index.merge_sparse(_docs(spark, sf_dir).withColumnRenamed("source", "k"), "k", "lang", "n_chars", 16)


@query(f"""SELECT doc_id, {clip_sql('text')} AS snippet, {clip_sql('text', 80)} AS short, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[^.]+[.]'), lambda x: x)[:1], '') AS first_sentence,
 CASE WHEN len({lines_sql('text')}) <= 4 THEN array_to_string(list_transform({lines_sql('text')}, lambda x: length(x)::VARCHAR), ', ') ELSE length({lines_sql('text')}[1]) || ' … ' || length({lines_sql('text')}[-1]) END AS line_lengths FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN10, FN20."""
    # The first run without a full stop is the first sentence or there is none; a search from every place would be quadratic.
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"\A\.*+([^.]++\.)", 1)
    lengths = F.transform("_lines", lambda x: F.length(x).cast("string"))
    d = _docs(spark, sf_dir).withColumn("_lines", T.lines("text")).withColumn("_lengths", lengths)
    return d.select("doc_id", T.clip("text").alias("snippet"), T.clip("text", 80).alias("short"), first.alias("first_sentence"), T.compact_list("_lengths").alias("line_lengths"))


@query("""WITH u AS (SELECT doc_id, source || '/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 END AS page, CASE WHEN doc_id % 3 = 1 THEN 1 END AS a, CASE WHEN doc_id % 3 = 1 THEN doc_id % 9 + 1 END AS b FROM documents),
i AS (SELECT *, CASE WHEN page IS NOT NULL THEN path || ':page:' || page WHEN a IS NOT NULL THEN path || ':lines:' || a || '-' || b ELSE path END AS unit_id FROM u)
SELECT doc_id, unit_id || ':' || (doc_id % 2) AS unit_id, CASE WHEN page IS NOT NULL THEN path || ' page ' || page WHEN a IS NOT NULL THEN path || ' lines ' || a || '-' || b ELSE path END AS location,
 sha256('m' || doc_id || ':' || unit_id || ':v1') AS point_key, doc_id || ':v2' AS run_key FROM i""")
def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN6, FN7, FN8 (as a plain hash), FN15."""
    d = F.col("doc_id")
    u = _docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", d.cast("string")).alias("path"), F.when(d % 3 == 0, d % 7).alias("page"), F.when(d % 3 == 1, F.lit(1)).alias("a"), F.when(d % 3 == 1, d % 9 + 1).alias("b"))
    plain = T.unit_id("path", "page", "a", "b")
    return u.select("doc_id", T.unit_id("path", "page", "a", "b", d % 2).alias("unit_id"), T.format_location("path", "page", "a", "b").alias("location"), T.point_key(F.concat(F.lit("m"), d.cast("string")), plain).alias("point_key"), T.run_key("doc_id", F.lit("v2")).alias("run_key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, least(greatest(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.4), 0), 1) AS relevance FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16, FN18."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), T.clamp_relevance(k, 0.4).alias("relevance"))


@query("SELECT page_id, contains(url, '..') OR starts_with(url, '/') AS unsafe, array_to_string(list_transform(regexp_extract_all('Host: ' || split_part(split_part(url, '//', 2), '/', 1) || chr(10) || 'Other: x', '(?m)^Host:\\s*(.+)$', 1), lambda x: trim(x)), '|') AS host FROM pages")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14, FN17: header lines built from each page's host."""
    host = F.split(F.get(F.split("url", "//"), F.lit(1)), "/")[0]
    text = F.concat(F.lit("Host: "), host, F.lit("\nOther: x"))
    return table(spark, sf_dir, "pages").select("page_id", T.unsafe_path("url").alias("unsafe"), F.array_join(T.header_fields(text, "Host"), "|").alias("host"))


CODE_LINES = f"array_to_string(list_transform({lines_sql('text')}, lambda x, i: CASE i % 5 WHEN 1 THEN '# ' || x WHEN 2 THEN 'def ' || regexp_extract(x, '[A-Za-z]+') || '():' WHEN 3 THEN 'import ' || regexp_extract(x, '[A-Za-z]+') || '.a' WHEN 4 THEN 'class ' || regexp_extract(x, '[A-Za-z]+') ELSE x END), chr(10))"


@query(f"""WITH c AS (SELECT doc_id, {CODE_LINES} AS code FROM documents)
SELECT doc_id, len(regexp_extract_all(code, '(?m)^#{{1,6}}[ \\t]+(.+)$', 1)) AS headings, len(regexp_extract_all(code, '(?m)^def[ ]+([A-Za-z_]\\w*)', 1)) AS functions,
 len(regexp_extract_all(code, '(?m)^class[ ]+([A-Za-z_]\\w*)', 1)) AS classes, len(regexp_extract_all(code, '(?m)^import[ ]+([\\w.]+)', 1)) AS imports FROM c""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11, FN12 on documents written as code."""
    word = lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).when(i % 5 == 1, F.concat(F.lit("def "), word(x), F.lit("():"))).when(i % 5 == 2, F.concat(F.lit("import "), word(x), F.lit(".a"))).when(i % 5 == 3, F.concat(F.lit("class "), word(x))).otherwise(x)
    c = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.lines("text"), line), "\n").alias("code"))
    many = lambda p: F.size(F.regexp_extract_all("code", F.lit(p), F.lit(1)))
    return c.select("doc_id", F.size(T.headings("code")).alias("headings"), many(r"(?m)^def[ ]+([A-Za-z_]\w*)").alias("functions"), many(r"(?m)^class[ ]+([A-Za-z_]\w*)").alias("classes"), F.size(T.imports("code")).alias("imports"))


@query("""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '__material__' WHEN doc_id % 5 = 1 THEN 'material' ELSE source END AS citation, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS path, CASE WHEN doc_id % 3 = 0 THEN 1 END AS page FROM documents)
SELECT doc_id FROM u WHERE citation <> '__material__' AND (page IS NOT NULL OR path <> '')""")
def eligible_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ11."""
    d, none = F.col("doc_id"), F.lit(None).cast("int")
    u = _docs(spark, sf_dir).select("doc_id", F.when(d % 5 == 0, evidence.CARD).when(d % 5 == 1, "material").otherwise(F.col("source")).alias("citation"), F.when(d % 2 == 0, F.col("source")).otherwise("").alias("path"), F.when(d % 3 == 0, 1).alias("page"), none.alias("a"), none.alias("b"))
    return u.filter(evidence.unit_ok("citation", "path", "page", "a", "b")).select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CASE lang WHEN 'en' THEN 'document' WHEN 'de' THEN 'project' ELSE 'dataset' END END AS type, lang AS language,
 CASE WHEN doc_id % 50 % 2 = 0 THEN 'file' || (doc_id % 50) ELSE source END AS origin FROM documents""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10, PRJ18: normalised and checked type; fields of the file at the unit's path override its own."""
    d = F.col("doc_id")
    path = F.concat(F.lit("p"), (d % 50).cast("string"))
    raw = F.when(d % 3 == 0, " ").otherwise(F.when(F.col("lang") == "en", " Document").when(F.col("lang") == "de", "PROJECT ").otherwise("dataset"))
    units = _docs(spark, sf_dir).select("doc_id", T.checked_type(raw).alias("type"), path.alias("path"), F.create_map(F.lit("language"), F.col("lang"), F.lit("origin"), F.col("source")).alias("m"))
    files = _docs(spark, sf_dir).filter(d % 50 % 2 == 0).select(path.alias("path"), F.create_map(F.lit("origin"), F.concat(F.lit("file"), (d % 50).cast("string"))).alias("fields"))
    m = index.merge_metadata(units, files.dropDuplicates(["path"]), "path", "m")
    return m.select("doc_id", "type", F.col("m")["language"].alias("language"), F.col("m")["origin"].alias("origin"))


UNIT_TEXT = f"regexp_replace(array_to_string(list_filter([CASE WHEN doc_id % 3 = 1 THEN 'Title ' || doc_id END, lang, nullif(array_to_string(({keywords_sql('text')})[:24], ' '), ''), text], lambda x: x IS NOT NULL), ' '), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256({UNIT_TEXT}) AS digest, length({UNIT_TEXT}) AS chars FROM documents")
def unit_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: metadata values, the first 24 keywords and the content of every unit."""
    title = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Title "), F.col("doc_id").cast("string")))
    text = index.unit_text({"title": title, "language": "lang", "author": F.lit(" ")}, {"keywords": T.plain_keywords("text")}, "text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).alias("chars"))
