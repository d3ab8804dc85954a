"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import clustering, decontaminate, html_text, linededup, neardup, packing, quality_classifier, quality_rules, sharding, simhash, tokenfiles, whitening, wordpiece
from quarry.llm.shared import fresh_dir
from quarry.session import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files in the shared folder and read the files back."""
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"))
    return tokenfiles.read(manifest).drop("ids")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n_words=2)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of op4 by themselves, for their SQL."""
    return quality_rules.base_stats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_files, op2_near_duplicates, op3_html_text, op4_quality_rules, op5_token_counts, op6_line_dedup,
            op7_virtual_slots, op8_benchmark_hits, op9_quality_scores, op10_best_fit, op11_centroids, op12_simhash, op13_whitening, base_statistics,
        )
    }


BASE_SQL = r"""
WITH d AS (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda p: w[p] || chr(1) || w[p + 1] || chr(1) || w[p + 2])) AS g FROM d),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS place FROM r WHERE k > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(2, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM n),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
m AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept, coalesce(class_id, doc_id) AS class_id
FROM documents JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (
  SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone
  FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width,
         array_to_string(w[p : p + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
d AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[p : p + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p
        FROM dw, (SELECT DISTINCT width FROM i) WHERE len(w) >= width)),
h AS (
  SELECT d.doc_id, i.item_id, count(*) AS shared_shingles FROM d JOIN i USING (width, g) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
FROM h JOIN n USING (item_id) WHERE 100 * shared_shingles >= 80 * item_shingles
"""

# Whole-number k-means, a round at a time: a = nearest centroid of each vector, c = floors of the means.
_OP11_NEAREST = """a{t} AS MATERIALIZED (
  SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT rid, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{t}) GROUP BY rid)"""
_OP11_MEANS = """c{n} AS MATERIALIZED (
  SELECT c{t}.k, coalesce(m.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY dim)::BIGINT[] AS c
    FROM (SELECT k, dim, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS dim FROM a{t} JOIN v USING (rid)) GROUP BY k, dim)
    GROUP BY k) m ON m.k = c{t}.k)"""
_OP11_ROUNDS = ",\n".join(part for t in range(clustering.ROUNDS) for part in (_OP11_NEAREST.format(t=t), _OP11_MEANS.format(t=t, n=t + 1)))
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < 40),
{_OP11_ROUNDS},
{_OP11_NEAREST.format(t=clustering.ROUNDS)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{clustering.ROUNDS} JOIN v USING (rid) JOIN c{clustering.ROUNDS} USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"base_statistics": BASE_SQL, "op2_near_duplicates": OP2_SQL, "op6_line_dedup": OP6_SQL, "op8_benchmark_hits": OP8_SQL, "op11_centroids": OP11_SQL}
