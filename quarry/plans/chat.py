"""Queries over ``conversations(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chat as C
from quarry.operators import index
from quarry.plans.common import bucket_sql, collapse_sql, cut_sql, lines_sql, query, tokens_sql
from quarry.session import table

FLAT = f"array_to_string(list_filter(list_transform({lines_sql('text')}, lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> ''), ' ')"


def pairs_sql(source: str = "conversations", key: str = "conv_id", ordinal: str = "turn") -> str:
    """CTEs up to ``p``: key, turn_no, query, answer."""
    return f"""s AS (SELECT {key}, {ordinal}, role, coalesce(text, '') AS text, lag(role) OVER w AS pr, lag(coalesce(text, '')) OVER w AS query FROM {source} WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY {key} ORDER BY {ordinal})),
fl AS (SELECT *, {FLAT} AS flat FROM s WHERE role = 'assistant' AND pr = 'user'),
p AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {ordinal}) - 1 AS turn_no, query, CASE WHEN flat = '' THEN '(no report)' ELSE {cut_sql('flat', C.ANSWER)} END AS answer FROM fl)"""


PAIRS = pairs_sql()


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {PAIRS} SELECT * FROM p")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16."""
    return _turns(spark, sf_dir)


def fold_sql(key: str, recent: int, previous: str) -> str:
    """CTEs from ``p`` up to ``f``: the fold with ``previous``, a query of key, pg, pf, pd, scope."""
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY turn_no DESC) AS b FROM p),
nw AS (SELECT {key}, list('User asked ' || query || '. Assistant: ' || answer ORDER BY turn_no) AS fresh FROM b WHERE b > {recent} AND b <= {recent + 12} GROUP BY {key}),
o AS (SELECT {key}, trim(arg_min(query, turn_no)) AS g, trim(arg_max(query, turn_no)) AS fo FROM b WHERE b > {recent} GROUP BY {key}),
pv AS ({previous}),
k AS (SELECT {key}, count(*) FILTER (WHERE b <= {recent}) AS recent, count(*) AS turns FROM b GROUP BY {key}),
x0 AS (SELECT k.*, coalesce(nullif(trim(pg), ''), g) AS goal, coalesce(nullif(fo, ''), trim(pf)) AS focus, list_concat(coalesce(pd, []), coalesce(fresh, [])) AS al, coalesce(scope, []) AS scope, g IS NOT NULL OR pg IS NOT NULL AS known
  FROM k LEFT JOIN nw USING ({key}) LEFT JOIN o USING ({key}) LEFT JOIN pv USING ({key})),
x1 AS (SELECT *, al[greatest(len(al) - 11, 1):] AS dl FROM x0),
x2 AS (SELECT *, array_to_string(list_filter([coalesce(goal, ''), coalesce(focus, ''), array_to_string(dl, '; '), array_to_string(scope, '; ')], lambda v: v <> ''), ' ') AS t FROM x1),
f AS (SELECT {key}, recent, turns, CASE WHEN known THEN {cut_sql("coalesce(goal, '')", 800)} END AS goal, CASE WHEN known THEN {cut_sql("coalesce(focus, '')", 800)} END AS focus,
  list_transform(list_filter(dl, lambda v: trim(v) <> ''), lambda v: {cut_sql('v', 800)}) AS decisions, scope, CASE WHEN known THEN {cut_sql('t', 800)} END AS summary FROM x2)"""


# Ten conversations in a row are one long thread; a third of the threads has an earlier summary.
def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.expr("conv_id div 10").alias("thread"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), "role", "text")


def _earlier(threads: DataFrame) -> DataFrame:
    t = F.col("thread")
    some = threads.select("thread").distinct().filter(t % 3 == 0)
    scope = F.when(t % 2 == 0, F.array(F.lit("scope a"), F.lit("scope b"))).otherwise(F.array().cast("array<string>"))
    return some.select("thread", F.when(t % 2 == 0, F.concat(F.lit(" Goal of "), t.cast("string"))).alias("goal"), F.lit("Focus").alias("focus"), F.array(F.lit("first decision"), F.lit("second decision")).alias("decisions"), scope.alias("scope"))


THREADS = "c AS (SELECT conv_id // 10 AS thread, conv_id * 1000 + turn AS ordinal, role, text FROM conversations)"
EARLIER = """SELECT DISTINCT thread, CASE WHEN thread % 2 = 0 THEN 'Goal of ' || thread END AS pg, 'Focus' AS pf, ['first decision', 'second decision'] AS pd, CASE WHEN thread % 2 = 0 THEN ['scope a', 'scope b'] ELSE [] END AS scope FROM c WHERE thread % 3 = 0"""
FOLD = f"WITH {THREADS}, {pairs_sql('c', 'thread', 'ordinal')}, {fold_sql('thread', C.RECENT, EARLIER)}"


def _folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads, their turns and their fold."""
    threads = _threads(spark, sf_dir)
    turns = C.turn_pairs(threads, "thread", "ordinal", "role", "text")
    return threads, turns, C.fold(turns, "thread", previous=_earlier(threads))


@query(FOLD + " SELECT thread, recent, turns, goal, focus, array_to_string(decisions, '; ') AS decisions, array_to_string(scope, '; ') AS scope, summary FROM f")
def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN17: five recent turns, older ones merged into an earlier summary."""
    return _folded(spark, sf_dir)[2].withColumns({c: F.array_join(c, "; ") for c in ("decisions", "scope")})


@query(f"""WITH {PAIRS}, t AS (SELECT *, trim(lag(query) OVER (PARTITION BY conv_id ORDER BY turn_no)) AS topic FROM p)
SELECT conv_id, turn_no, CASE WHEN topic <> '' AND NOT contains(lower(trim(query)), lower(topic)) THEN topic || ': ' || trim(query) ELSE trim(query) END AS standalone FROM t""")
def standalone_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN18."""
    return C.standalone(_turns(spark, sf_dir), "conv_id").select("conv_id", "turn_no", "standalone")


@query("SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), 'New chat') AS title, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY conv_id")
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21."""
    return C.thread_list(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("""WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE turn < 2 GROUP BY conv_id)
SELECT c.conv_id, c.turn, coalesce(m, -1) + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS ordinal FROM conversations c LEFT JOIN m USING (conv_id) WHERE c.turn >= 2""")
def message_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN19: later turns appended to the first two of each thread."""
    c = table(spark, sf_dir, "conversations")
    return C.next_ordinals(c.filter("turn < 2").withColumn("ordinal", F.col("turn")), c.filter("turn >= 2"), "conv_id", ["turn"]).select("conv_id", "turn", "ordinal")


REFERS = f"(regexp_matches(lower(coalesce(text, '')), '{'|'.join(C.REFERENCE)}') OR regexp_matches(coalesce(text, ''), '{C.PRONOUN}'))"


@query(f"SELECT conv_id, turn, {REFERS} AS refers FROM conversations WHERE role = 'user'")
def back_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", C.refers_back("text").alias("refers"))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    threads = C.thread_list(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").join(C.fold(turns, "conv_id", 1).select("conv_id", "summary"), "conv_id", "left")
    return C.memories(threads, turns, "conv_id")


MEMORY = (
    f"WITH {PAIRS}, {fold_sql('conv_id', 1, 'SELECT NULL::BIGINT AS conv_id, NULL::VARCHAR AS pg, NULL::VARCHAR AS pf, NULL::VARCHAR[] AS pd, NULL::VARCHAR[] AS scope WHERE false')}"
    + """, th AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), 'New chat') AS title FROM conversations GROUP BY conv_id),
mem AS (SELECT conv_id, 'request' AS key, 'request' AS kind, title AS text FROM th
  UNION ALL SELECT conv_id, 'summary', 'summary', summary FROM f WHERE trim(coalesce(summary, '')) <> ''
  UNION ALL SELECT conv_id, 'finding-' || turn_no, 'finding', answer FROM p)"""
)


@query(MEMORY + " SELECT conv_id, key, kind, CASE WHEN conv_id % 2 = 0 AND key <> 'summary' THEN text ELSE 'old ' || text END AS text FROM mem")
def thread_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: memory rows keyed by thread and key; new ones of half the threads replace stored ones."""
    new = _memories(spark, sf_dir)
    return C.remember(new.withColumn("text", F.concat(F.lit("old "), "text")), new.filter("conv_id % 2 = 0 and key <> 'summary'"), "conv_id")


@query(
    MEMORY
    + f""", q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND {REFERS}),
qt AS (SELECT conv_id, turn, {bucket_sql('tok', T.SPARSE_DIM)} AS idx, count(*) AS tf FROM (SELECT conv_id, turn, unnest({tokens_sql('text')}) AS tok FROM q) GROUP BY ALL),
mt AS (SELECT conv_id, key, {bucket_sql('tok', T.SPARSE_DIM)} AS idx, count(*) AS tf FROM (SELECT conv_id, key, unnest({tokens_sql('text')}) AS tok FROM mem) GROUP BY ALL),
sc AS (SELECT qt.conv_id, turn, key, CAST(sum(qt.tf * mt.tf) AS BIGINT) AS score FROM qt JOIN mt ON qt.conv_id = mt.conv_id AND qt.idx = mt.idx GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, key) AS rank FROM sc)
SELECT conv_id, turn, key, score, rank FROM r WHERE rank <= 5"""
)
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: five memories of the same thread for each user turn that refers back."""
    mem = _memories(spark, sf_dir).withColumn("mid", F.struct("conv_id", "key"))
    asked = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").filter(C.refers_back("text")).withColumn("qid", F.struct("conv_id", "turn"))
    q = index.postings(asked, "qid", "text", T.SPARSE_DIM).select("qid.conv_id", "qid.turn", "idx", F.col("tf").alias("qtf"))
    m = index.postings(mem, "mid", "text", T.SPARSE_DIM).select("mid.conv_id", "mid.key", "idx", "tf")
    scores = q.join(m, ["conv_id", "idx"]).groupBy("conv_id", "turn", "key").agg(F.sum(F.col("qtf") * F.col("tf")).alias("score"))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


@query("""WITH m AS (SELECT source, source || '/' || lang AS material, CASE WHEN count(*) % 2 = 0 THEN 'ready' ELSE 'failed' END AS status FROM documents GROUP BY source, lang)
SELECT 'source' AS lookup, material AS key, 1::BIGINT AS n FROM m WHERE source = 'src3' UNION ALL SELECT 'status', material, 1 FROM m WHERE status = 'failed'
UNION ALL SELECT 'run', event_type, count(*) FROM events WHERE user_id % 50 = 7 GROUP BY event_type
UNION ALL SELECT 'anonymous', conv_id::VARCHAR, count(*) FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id UNION ALL SELECT 'owner', conv_id::VARCHAR, count(*) FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id""")
def keyed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19: materials of a source and by status, nodes of a run, messages of the anonymous and of one owner."""
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.when(F.count(F.lit(1)) % 2 == 0, "ready").otherwise("failed").alias("status")).withColumn("key", F.concat_ws("/", "source", "lang"))
    owned = table(spark, sf_dir, "conversations").withColumn("owner", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") % 3))
    found = lambda name, df, key: df.groupBy(F.lit(name).alias("lookup"), F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        found("source", m.filter("source = 'src3'"), "key"), found("status", m.filter("status = 'failed'"), "key"), found("run", table(spark, sf_dir, "events").filter("user_id % 50 = 7"), "event_type"),
        found("anonymous", C.visible_to(owned, "owner", F.lit(None).cast("long")), "conv_id"), found("owner", C.visible_to(owned, "owner", F.lit(2)), "conv_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    FOLD
    + f""", lt AS (SELECT thread, arg_max(text, ordinal) AS latest FROM c WHERE role = 'user' GROUP BY thread),
la AS (SELECT thread, arg_max(text, ordinal) AS text FROM c WHERE role = 'assistant' AND thread % 2 = 1 GROUP BY thread),
pr AS (SELECT thread, {collapse_sql('text')} AS flat FROM la), pc AS (SELECT thread, {cut_sql('flat', C.PRIOR)} AS research FROM pr),
rt AS (SELECT thread, string_agg('Past user: ' || query || chr(10) || 'Past assistant: ' || answer, chr(10) ORDER BY turn_no) AS turns FROM b WHERE b <= 5 GROUP BY thread)
SELECT lt.thread, array_to_string(list_filter(['<thread>', CASE WHEN trim(coalesce(goal, '')) <> '' THEN 'Main goal: ' || trim(goal) END, CASE WHEN trim(coalesce(focus, '')) <> '' THEN 'Current focus: ' || trim(focus) END,
 CASE WHEN len(decisions) > 0 THEN 'Important decisions: ' || array_to_string(decisions, '; ') END, CASE WHEN len(scope) > 0 THEN 'Current scope: ' || array_to_string(scope, '; ') END,
 CASE WHEN trim(coalesce(goal, '')) = '' AND trim(coalesce(focus, '')) = '' AND trim(coalesce(summary, '')) <> '' THEN 'Conversation summary: ' || trim(summary) END,
 CASE WHEN rt.turns IS NOT NULL THEN 'Recent turns:' || chr(10) || rt.turns END, CASE WHEN trim(coalesce(research, '')) <> '' THEN 'Previous research: ' || trim(research) END,
 'Latest user message: ' || coalesce(latest, ''), '</thread>'], lambda x: x IS NOT NULL), chr(10)) AS context
FROM lt LEFT JOIN f USING (thread) LEFT JOIN rt USING (thread) LEFT JOIN pc USING (thread)"""
)
def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21: labelled lines of summary, recent turns, earlier research and latest message."""
    threads, turns, folded = _folded(spark, sf_dir)
    back = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("turn_no")))
    recent = turns.withColumn("_b", back).filter(F.col("_b") <= C.RECENT)
    latest = threads.filter("role = 'user'").groupBy("thread").agg(F.max_by("text", "ordinal").alias("message"))
    last = threads.filter("role = 'assistant' and thread % 2 = 1").groupBy("thread").agg(F.max_by("text", "ordinal").alias("text"))
    prior = last.select("thread", T.cut_off(T.collapse("text"), C.PRIOR).alias("research"))
    return C.context(folded, recent, latest, prior, "thread")
