"""Conversations: turn pairs, folding, standalone questions, thread lists, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# Phrases and pronouns that refer back to the conversation.
REFERENCE = (
    "as we", "as you", "you said", "we said", "we discussed", "earlier", "previously", "the conclusion", "that finding", "remind",
    "as before", "what else", "tell me more", "go deeper", "the same", "that paper", "this paper", "the paper",
)
PRONOUN = r"(?i)\b(it|this|that|those|them|they|its|their|same)\b"
RECENT, DECISIONS, SUMMARY, ANSWER, PRIOR = 5, 12, 800, 240, 400


def refers_back(text: str | Column) -> Column:
    t = F.coalesce(T.col(text), F.lit(""))
    return F.lower(t).rlike("|".join(REFERENCE)) | t.rlike(PRONOUN)


def turn_pairs(messages: DataFrame, thread: str, ordinal: str, role: str, text: str) -> DataFrame:
    """(thread, turn_no, query, answer): each assistant message with the user message right before it.

    Later user messages overwrite an unanswered one, so only a directly preceding user row pairs.
    """
    w = Window.partitionBy(thread).orderBy(ordinal)
    said = messages.filter(F.col(role).isin("user", "assistant")).withColumn(text, F.coalesce(text, F.lit("")))
    asked = said.withColumn("_r", F.lag(role).over(w)).withColumn("query", F.lag(text).over(w))
    paired = asked.filter((F.col(role) == "assistant") & (F.col("_r") == "user"))
    lines = F.filter(F.transform(T.lines(text), lambda x: F.trim(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")
    flat = F.array_join(lines, " ")
    answer = F.when(flat == "", "(no report)").otherwise(T.cut_off(flat, ANSWER))
    return paired.select(thread, (F.row_number().over(w) - 1).alias("turn_no"), "query", answer.alias("answer"))


def fold(turns: DataFrame, thread: str, recent: int = RECENT, previous: DataFrame | None = None) -> DataFrame:
    """Per thread: turns, number of recent ones, and of the older ones goal, focus, decisions, scope and summary text.

    ``previous(thread, goal, focus, decisions, scope)`` is an earlier summary: its goal stays, its decisions come
    before the new ones, its scope is carried on; a thread without older turns keeps it as it is. The last
    ``DECISIONS`` decisions stay.
    """
    back = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc("turn_no")))
    placed = turns.withColumn("_b", back)
    old = placed.filter(F.col("_b") > recent)
    late = old.filter(F.col("_b") <= recent + DECISIONS)
    said = F.concat(F.lit("User asked "), "query", F.lit(". Assistant: "), "answer")
    new = late.groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", said.alias("d")))), lambda x: x["d"]).alias("_new"))
    ends = old.groupBy(thread).agg(F.trim(F.min_by("query", "turn_no")).alias("_goal"), F.trim(F.max_by("query", "turn_no")).alias("_focus"))
    none = F.array().cast("array<string>")
    empty = turns.sparkSession.createDataFrame([], f"{thread} {dict(turns.dtypes)[thread]}, goal string, focus string, decisions array<string>, scope array<string>")
    earlier = (empty if previous is None else previous).select(thread, F.trim("goal").alias("_pg"), F.trim("focus").alias("_pf"), F.coalesce("decisions", none).alias("_pd"), F.coalesce("scope", none).alias("scope"))
    kept = placed.groupBy(thread).agg(F.count_if(F.col("_b") <= recent).alias("recent"), F.count(F.lit(1)).alias("turns"))
    j = kept.join(ends, thread, "left").join(new, thread, "left").join(earlier, thread, "left")
    both = F.concat(F.coalesce("_pd", none), F.coalesce("_new", none))
    last = F.slice(both, F.greatest(F.size(both) - DECISIONS + 1, F.lit(1)), F.lit(DECISIONS))
    j = j.withColumn("goal", F.coalesce(F.nullif("_pg", F.lit("")), "_goal")).withColumn("focus", F.coalesce(F.nullif("_focus", F.lit("")), "_pf")).withColumn("decisions", last).withColumn("scope", F.coalesce("scope", none))
    known = F.col("_goal").isNotNull() | F.col("_pg").isNotNull()
    words = F.array(F.coalesce("goal", F.lit("")), F.coalesce("focus", F.lit("")), F.array_join("decisions", "; "), F.array_join("scope", "; "))
    text = T.cut_off(F.array_join(F.filter(words, lambda x: x != ""), " "), SUMMARY)
    short = lambda c: F.when(known, T.cut_off(F.coalesce(c, F.lit("")), SUMMARY))
    own = F.transform(F.filter("decisions", lambda x: F.trim(x) != ""), lambda x: T.cut_off(x, SUMMARY))
    return j.select(thread, "recent", "turns", short("goal").alias("goal"), short("focus").alias("focus"), own.alias("decisions"), "scope", F.when(known, text).alias("summary"))


def context(folded: DataFrame, recent: DataFrame, latest: DataFrame, prior: DataFrame, thread: str) -> DataFrame:
    """(thread, context): labelled lines of a thread's summary, recent turns, earlier research and latest message.

    folded as from :func:`fold`, recent(thread, turn_no, query, answer), latest(thread, message), prior(thread, research).
    """
    said = F.concat(F.lit("Past user: "), "query", F.lit("\nPast assistant: "), "answer")
    turns = recent.groupBy(thread).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", said.alias("s")))), lambda x: x["s"]), "\n").alias("_turns"))
    j = latest.join(folded.select(thread, "goal", "focus", "decisions", "scope", "summary"), thread, "left").join(turns, thread, "left").join(prior.select(thread, "research"), thread, "left")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    line = lambda label, c: F.when(filled(c), F.concat(F.lit(label), F.trim(c)))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, "; ")))
    text = F.concat_ws(
        "\n", F.lit("<thread>"), line("Main goal: ", "goal"), line("Current focus: ", "focus"), listed("Important decisions: ", "decisions"), listed("Current scope: ", "scope"),
        F.when(~filled("goal") & ~filled("focus"), line("Conversation summary: ", "summary")), F.when(F.col("_turns").isNotNull(), F.concat(F.lit("Recent turns:\n"), "_turns")),
        line("Previous research: ", "research"), F.concat(F.lit("Latest user message: "), F.coalesce("message", F.lit(""))), F.lit("</thread>"),
    )
    return j.select(thread, text.alias("context"))


def standalone(turns: DataFrame, thread: str) -> DataFrame:
    """Each query with the previous query as its topic unless it already holds it (case-folded)."""
    topic = F.trim(F.lag("query").over(Window.partitionBy(thread).orderBy("turn_no")))
    own = F.trim("query")
    return turns.withColumn("_t", topic).withColumn("standalone", F.when((F.col("_t") != "") & ~F.contains(F.lower(own), F.lower("_t")), F.concat("_t", F.lit(": "), own)).otherwise(own)).drop("_t")


def thread_list(messages: DataFrame, thread: str, ordinal: str, role: str, text: str) -> DataFrame:
    """Title (first user message or a default), message count and last ordinal, in one pass."""
    title = F.min_by(text, F.when(F.col(role) == "user", F.col(ordinal)))
    return messages.groupBy(thread).agg(F.coalesce(title, F.lit("New chat")).alias("title"), F.count(F.lit(1)).alias("messages"), F.max(ordinal).alias("last"))


def next_ordinals(stored: DataFrame, batch: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """Ordinals of new messages: after the largest stored one of their thread, from 0 without any."""
    top = stored.groupBy(thread).agg(F.max("ordinal").alias("_m"))
    n = F.row_number().over(Window.partitionBy(thread).orderBy(*order))
    return batch.join(top, thread, "left").withColumn("ordinal", F.coalesce("_m", F.lit(-1)) + n).drop("_m")


def visible_to(messages: DataFrame, owner: str, user: Column) -> DataFrame:
    """Rows of the user's threads; anonymous rows for an anonymous user."""
    return messages.filter(F.col(owner).eqNullSafe(user))


def memories(threads: DataFrame, turns: DataFrame, thread: str) -> DataFrame:
    """(thread, key, kind, text): the request, the summary and one finding per turn of each thread."""
    request = threads.select(thread, F.lit("request").alias("key"), F.lit("request").alias("kind"), F.col("title").alias("text"))
    summary = threads.filter("trim(coalesce(summary, '')) <> ''").select(thread, F.lit("summary").alias("key"), F.lit("summary").alias("kind"), F.col("summary").alias("text"))
    found = turns.select(thread, F.concat(F.lit("finding-"), F.col("turn_no").cast("string")).alias("key"), F.lit("finding").alias("kind"), F.col("answer").alias("text"))
    return request.unionByName(summary).unionByName(found)


def remember(stored: DataFrame, new: DataFrame, thread: str) -> DataFrame:
    """Memory rows after a keyed write: a row of ``new`` replaces the stored one of its thread and key."""
    return stored.join(new.select(thread, "key"), [thread, "key"], "left_anti").unionByName(new)
