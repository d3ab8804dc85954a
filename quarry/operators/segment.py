"""Cutting text into citable units: sections, symbols, token windows, groups, batches."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.corpus import HINT_TYPES
from quarry.operators.numbering import numbered
from quarry.session import scratch_dir, text_batches

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What starts a symbol in each language.
MARKS = {
    ".py": r"^(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_]\w*)",
    ".go": r"^(?:func[ \t]+(?:\([^)]*\)[ \t]+)?|type[ \t]+)([A-Za-z_]\w*)",
    ".js": r"^(?:export[ \t]+(?:default[ \t]+)?)?(?:(?:async[ \t]+)?function|class)[ \t]+([A-Za-z_$][\w$]*)",
}
DECORATED = (".py", ".js")
DECORATOR = re.compile(r"[ \t]*@")
WRAP = 16
#: Units that one task packs.
PART_ROWS = 200_000


def sections(docs: DataFrame, key: str, text: str, marker: Callable[[Column], Column], heading: Callable[[Column], Column]) -> DataFrame:
    """Sections starting at lines where ``marker`` holds: section_no, heading, content, line_start, line_end.

    Lines before the first marker are section 0; a text without markers is one section 0; an empty text is one
    empty section on line 1. All of it happens inside the text's row.
    """
    lines = docs.select(key, T.lines(text).alias("_l")).withColumn("_n", F.size("_l"))
    at = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    marked = lines.withColumn("_s", F.filter(at, lambda i: marker(F.get("_l", i))))
    led = marked.withColumn("_lead", (F.get("_s", F.lit(0)).isNull() | (F.get("_s", F.lit(0)) > 0)).cast("int"))
    led = led.withColumn("_a", F.when(F.col("_lead") == 1, F.concat(F.array(F.lit(0)), "_s")).otherwise(F.col("_s")))

    def one(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_a", j + 1), F.col("_n"))
        head = F.when((F.col("_lead") == 0) | (j > 0), heading(F.get("_l", start)))
        return F.struct(
            (j + 1 - F.col("_lead")).cast("long").alias("section_no"), head.alias("heading"), F.array_join(F.slice("_l", start + 1, end - start), "\n").alias("content"),
            (start + 1).alias("line_start"), F.greatest(end, F.lit(1)).alias("line_end"),
        )

    return led.select(key, F.inline(F.transform("_a", one)))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections at lines ``# ...`` or ``## ...``."""
    pattern = r"^(#{1,2})[ \t]+(.+?)\s*$"
    return sections(docs, key, text, lambda line: line.rlike(pattern), lambda line: F.trim(F.regexp_extract(line, pattern, 2)))


def symbol_units(lines: list[str], mark: re.Pattern, decorated: bool) -> Iterator[tuple[int, str | None, int, int]]:
    """(part, symbol, first line, last line), counted from 1: a symbol begins behind the last line in front of it that is no
    decorator; what stands in front of the first one is part 0. Nothing for a text without symbols."""
    starts, plain = [], 0  # plain: lines up to and with the last one that is no decorator
    for n, line in enumerate(lines):
        if m := mark.search(line):
            starts.append((plain, m[1]))
        if not (decorated and DECORATOR.match(line)):
            plain = n + 1
    for part, (start, name) in enumerate(starts):
        if part == 0 and start > 0:
            yield 0, None, 1, start
        end = starts[part + 1][0] if part + 1 < len(starts) else len(lines)
        yield part + 1, name, start + 1, end


def symbols(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Top-level symbols of Python, Go and JavaScript files with the lines of their decorators: key, part, symbol, content,
    line_start, line_end.

    The first line of a symbol is the line after the last line before it that is no decorator.
    A non-blank part before the first symbol is a unit of its own; files without symbols give no rows. One fold over the
    lines that a row holds: nothing is exploded or shuffled.
    """
    p = F.lower(F.col(path))
    kind = F.when(p.endswith(".py"), ".py").when(p.endswith(".go"), ".go").when(p.rlike(r"\.(js|mjs|cjs|jsx)$"), ".js")
    slim = files.select(F.col(key).alias("_key"), kind.alias("_kind"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).filter("_kind is not null")
    text_batches(files.sparkSession)
    marks = {k: re.compile(v, re.A) for k, v in MARKS.items()}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            rows = []
            for at, (own, text) in enumerate(zip(b["_kind"], b["_text"], strict=True)):
                lines = lines_of(text)
                for part, name, first, last in symbol_units(lines, marks[own], own in DECORATED):
                    content = "\n".join(lines[first - 1 : last])
                    if part == 0:
                        content = content.rstrip(" \t\n\x0b\f\r")
                    if part or content.strip(" "):
                        rows.append((at, part, name, content, first, last))
            out = pd.DataFrame(rows, columns=["at", "part", "symbol", "content", "line_start", "line_end"])
            yield pd.concat([b["_key"].iloc[out["at"]].reset_index(drop=True), out.drop(columns="at")], axis=1)

    found = slim.mapInPandas(run, f"_key {dict(files.dtypes)[key]}, part long, symbol string, content string, line_start int, line_end int")
    return found.withColumnRenamed("_key", key)


LINE_END, TOKEN, STOP = re.compile(T.LINE_END), re.compile(T.TOKEN), frozenset(T.TOKEN_STOP)
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Texts whose pieces a worker holds at once.
TEXTS = 64


def sliced(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), TEXTS):
            yield b.iloc[at : at + TEXTS].reset_index(drop=True)


def lines_of(text: str) -> list[str]:
    """``T.lines`` of a text."""
    lines = LINE_END.split(text)
    if not lines[-1]:
        lines.pop()
    return lines


def n_tokens(text: str) -> int:
    return sum(t not in STOP for t in TOKEN.findall(text.lower()))


def pieces(text: str, size: int) -> list[tuple[str, int]]:
    """Lines of a text with their tokens; lines of more than ``size`` tokens are split between words into pieces of at
    most ``min(16, size)`` tokens. An empty text is one empty piece."""
    lines = LINE_END.split(text)
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    out = []
    for line in lines:
        n = n_tokens(line)
        if n <= size:
            out.append((line, n))
            continue
        held, used = [], 0
        for word in filter(None, SPACE.split(line)):
            more = n_tokens(word)
            if held and used + more > min(WRAP, size):
                out.append((" ".join(held), used))
                held, used = [], 0
            held.append(word)
            used += more
        out.append((" ".join(held), used))
    return out


def windows_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(first line, last line, tokens, content) of every window: two binary searches in the running sum of tokens."""
    own = pieces(text, size)
    sums = np.concatenate([[0], np.cumsum([n for _, n in own])]).tolist()
    at, n = 0, len(own)
    while at < n:
        end = max(bisect_right(sums, sums[at] + size) - 1, at + 1)
        yield at + 1, end, sums[end] - sums[at], "\n".join(line for line, _ in own[at:end])
        if end >= n:
            return
        at = max(at + 1, min(end, bisect_left(sums, sums[at] + max(sums[end] - sums[at] - overlap, 1))))


def token_windows(docs: DataFrame, key: str | list[str], text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of whole pieces with at most ``size`` tokens (or one piece): window_no, line_start, line_end,
    tokens, content. The next window starts after at least ``used - overlap`` tokens (one at least).

    A sequential rule inside each text, linear in it: one Arrow pass without a shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    overlap = min(max(overlap, 0), size - 1)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            rows = [(i, k, *w) for i, t in enumerate(b["_text"]) for k, w in enumerate(windows_of(t, size, overlap))]
            out = pd.DataFrame(rows, columns=["i", "window_no", "line_start", "line_end", "tokens", "content"])
            yield pd.concat([b[keys].iloc[out["i"]].reset_index(drop=True), out.drop(columns="i")], axis=1)

    slim = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kinds = dict(slim.dtypes)
    text_batches(docs.sparkSession)
    return slim.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", window_no int, line_start int, line_end int, tokens int, content string")


class Greedy:
    """The packing rule: a unit opens a new group if it does not fit, or starts a section when the group is early full."""

    def __init__(self, target: int, early: float):
        self.target, self.flush = target, max(int(target * early), 1)

    def through(self, sizes: np.ndarray, flags: np.ndarray) -> list[tuple[int, int, int]]:
        """What a run of units makes of every state of the group before it (tokens used, ``target`` + 1 for any more):
        (first state, tokens used after, groups opened) for ranges of states."""
        used, opened = np.arange(self.target + 2), np.zeros(self.target + 2, np.int64)
        for size, flag in zip(sizes.tolist(), flags.tolist(), strict=True):
            new = used + size > self.target
            if flag:
                new |= used >= self.flush
            used = np.minimum(np.where(new, size, used + size), self.target + 1)
            opened += new
        change = np.flatnonzero(np.append(True, (np.diff(used) != 0) | (np.diff(opened) != 0)))
        return [(int(i), int(used[i]), int(opened[i])) for i in change]

    def groups(self, sizes: np.ndarray, flags: np.ndarray, start: tuple[int, int] | None) -> tuple[list[int], int, int]:
        """Group of every unit of one key after ``start`` (used, group), and the state at the end."""
        used, group = start or (0, 0)
        out, any_before = [], start is not None
        for size, flag in zip(sizes.tolist(), flags.tolist(), strict=True):
            if any_before and (used + size > self.target or (flag and used >= self.flush)):
                used, group = 0, group + 1
            used, any_before = used + size, True
            out.append(group)
        return out, min(used, self.target + 1), group


def _runs(part: pd.DataFrame) -> Iterator[tuple[object, pd.DataFrame]]:
    """Consecutive rows of one key, in order."""
    ordered = part.sort_values(["k", "pos"], kind="stable", na_position="first")
    code = pd.factorize(ordered["k"])[0]  # null is one key, with code -1
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    for a, b in zip(first, np.append(first[1:], len(ordered)), strict=True):
        yield ordered["k"].iloc[a], ordered.iloc[a:b]


def greedy_groups(units: DataFrame, key: str, pos: str, size: str, target: int, boundary: str | None = None, early: float = 0.6) -> DataFrame:
    """(key, pos, group_no): consecutive units packed to at most ``target``; with ``boundary`` a group
    also ends before a unit that starts a section once it is ``early`` full.

    Units are range partitioned by (key, pos), so a key with most of the units lies in many parts. A first pass
    tells what each part's first key makes of every state that it may find open; these tables (a few rows a part)
    are joined one after the other into the state at each part's start, and a second pass numbers the groups.
    """
    spark = units.sparkSession
    flag = F.coalesce(F.col(boundary), F.lit(False)) if boundary else F.lit(False)
    # Keys go as strings, so that one with nulls keeps its type in pandas.
    slim = units.select(F.col(key).cast("string").alias("k"), F.col(pos).alias("pos"), F.col(size).cast("long").alias("size"), flag.alias("flag"))
    dealt = slim.repartitionByRange(max(1, -(-slim.count() // PART_ROWS)), "k", "pos")
    path = scratch_dir(spark, "units")
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    kinds, rule = dict(rows.dtypes), Greedy(target, early)

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        runs = list(_runs(part))
        (first, head), (last, tail) = runs[0], runs[-1]
        table = rule.through(head["size"].to_numpy(), head["flag"].to_numpy())
        _, used, group = rule.groups(tail["size"].to_numpy(), tail["flag"].to_numpy(), None)
        return pd.DataFrame({"part": [part["part"].iloc[0]], "first": [first], "last": [last], "one": [len(runs) == 1], "used": [used], "grp": [group], "states": [[list(x) for x in table]]})

    found = rows.groupBy("part").applyInPandas(ends, f"part int, first {kinds['k']}, last {kinds['k']}, one boolean, used long, grp long, states array<array<bigint>>")
    starts: dict[int, tuple[int, int]] = {}
    last, state = None, None
    for r in sorted(found.collect(), key=lambda r: r.part):  # one row a part
        follows = state is not None and r.first == last
        if follows:
            starts[r.part] = state
        if follows and r.one:
            _, used, opened = r.states[bisect_right([x[0] for x in r.states], state[0]) - 1]
            state = used, state[1] + opened
        else:
            state = r.used, r.grp
        last = r.last
    known = spark.sparkContext.broadcast(starts)

    def number(part: pd.DataFrame) -> pd.DataFrame:
        start, out = known.value.get(int(part["part"].iloc[0])), []
        for _, own in _runs(part):
            groups, _, _ = rule.groups(own["size"].to_numpy(), own["flag"].to_numpy(), start)
            out.append(own[["k", "pos"]].assign(group_no=groups))
            start = None
        return pd.concat(out)

    grouped = rows.groupBy("part").applyInPandas(number, f"k {kinds['k']}, pos {kinds['pos']}, group_no int")
    return grouped.select(F.col("k").cast(dict(units.dtypes)[key]).alias(key), F.col("pos").alias(pos), "group_no")


def section_start(text: str | Column) -> Column:
    """First line of a unit looks like a heading."""
    return F.ltrim(T.col(text)).rlike(r"(?i)^(#{1,6}\s|chapter\s+\d|section\s+\d)")


def number_chunks(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chunk_index from 0 per material, whatever a material's share of the units."""
    return numbered(units, [key], order, "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))


def strategy(material_type: str | Column, subtype: str | Column, headed: str | Column, symbols: str | Column) -> Column:
    """How a unit is cut; ``headed``: its material has sections, ``symbols``: it has top-level symbols."""
    t, s = T.col(material_type), F.coalesce(T.col(subtype), F.lit(""))
    sections = F.when(T.col(headed), "document.sections").otherwise("document.window")
    return (
        F.when(s.isin(*HINT_TYPES["code"]), "artifact")
        .when(s.isin(*HINT_TYPES["unknown"], "xlsx", "pptx", "doc"), "stub")
        .when((t == "document") & (s == "pdf"), "document.pages")
        .when((t == "document") & s.isin("docx", "docm", "markdown"), sections)
        .when(t == "document", "document.window")
        .when(t == "dataset", "table")
        .when(t.isin("project", "code"), F.when(T.col(symbols), "code.symbol").otherwise("code.file"))
        .otherwise("passthrough")
    )


def cut_units(units: DataFrame, key: str, material: str, order: list[str], size: int = 512, overlap: int = 64) -> DataFrame:
    """Units cut by the strategy of their material and numbered per material: the key and material, strategy, section,
    part, chunk_key, line_start, line_end, content, chunk_index.

    units(key, material, material_type, subtype, path, page, section, line_start, content and the ``order`` columns).
    Markdown texts are split into sections and code into symbols first; what then has at most ``size`` tokens passes
    through, the rest is cut into windows. Lines count from the unit's first line; a page keeps its number.
    """
    own = units.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("line_start", F.coalesce("line_start", F.lit(1)))
    markdown = (F.col("material_type") == "document") & (F.col("subtype") == "markdown")
    code = F.col("material_type").isin("project", "code") & ~F.coalesce("subtype", F.lit("")).isin(*HINT_TYPES["code"], *HINT_TYPES["unknown"])
    piece = lambda df, n, name, text: df.select(key, F.col(n).cast("long").alias("part"), F.col(name).alias("_section"), F.col(text).alias("_text"), F.col("line_start").alias("_from"), F.col("line_end").alias("_to"))
    split = piece(markdown_sections(own.filter(markdown), key, "content"), "section_no", "heading", "content")
    split = split.unionByName(piece(symbols(own.filter(code), key, "path", "content"), "part", "symbol", "content"))
    j = own.join(split, key, "left")
    headed = F.max(F.coalesce(F.when(markdown, F.col("_section")), F.when(~markdown & ~code, F.col("section"))).isNotNull())
    j = j.join(j.groupBy(key).agg(headed.alias("_own")), key).join(j.groupBy(material).agg(headed.alias("_headed")), material)
    # A markdown unit is headed by itself, other documents by any unit of their material.
    j = j.withColumn("strategy", strategy("material_type", "subtype", F.when(markdown, F.col("_own")).otherwise(F.col("_headed")), code & F.col("_text").isNotNull()))
    j = j.withColumn("section", F.coalesce(F.col("_section"), F.col("section"))).withColumn("_base", F.col("line_start") + F.coalesce("_from", F.lit(1)) - 1)
    j = j.withColumn("content", F.coalesce("_text", "content")).withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    fits = (T.token_count("content") <= size) | F.col("strategy").isin("artifact", "stub", "passthrough")
    columns = [key, material, "strategy", "section", "part", "page", *[c for c in order if c not in (key, material)]]
    whole = j.filter(fits).select(*columns, F.lit(0).alias("chunk_key"), F.col("_base").alias("line_start"), (F.col("_base") + F.coalesce(F.col("_to") - F.col("_from") + 1, T.line_count("content")) - 1).alias("line_end"), "content")
    wide = j.filter(~fits)
    windows = token_windows(wide, [*columns, "_base"], "content", size, overlap)
    cut = windows.select(*columns, F.col("window_no").alias("chunk_key"), (F.col("_base") + F.col("line_start") - 1).alias("line_start"), (F.col("_base") + F.col("line_end") - 1).alias("line_end"), "content")
    return number_chunks(whole.unionByName(cut), material, [*order, "part", "chunk_key"]).select(key, material, "strategy", "section", "part", "page", "chunk_key", "line_start", "line_end", "content", "chunk_index")


def block_sections(blocks: DataFrame, key: str, pos: str, is_heading: str, text: str) -> DataFrame:
    """Ordered blocks to sections starting at headings, with line ranges from a running line count: key, section_no, heading,
    content, line_start, line_end.

    Blocks are dealt by key and sorted, on disk where they do not fit; a fold reads them in order and hands each section on
    as it closes, so a task holds one section.
    """
    kinds = dict(blocks.dtypes)
    slim = blocks.select(F.col(key).cast("string").alias("k"), F.col(pos).alias("p"), F.col(is_heading).alias("h"), F.col(text).alias("t"), T.line_count(text).cast("long").alias("n"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, began, number, line, heading, parts, first = None, False, 0, 0, None, [], 1

        def closed() -> tuple:
            return key, number, heading, "\n".join(parts), first, line

        for b in batches:
            done = []
            for k, h, t, n in zip(b["k"], b["h"], b["t"], b["n"], strict=True):
                if not began or k != key:
                    if began:
                        done.append(closed())
                    key, began, number, line, heading, parts, first = k, True, 0, 0, None, [], 1
                    started = False
                if h:
                    if started:
                        done.append(closed())
                    number, heading, parts, first = number + 1, None if t is None else t.strip(" "), [], line + 1
                started = True
                if t is not None:
                    parts.append(t)
                line += n
            yield pd.DataFrame(done, columns=SECTION)
        if began:
            yield pd.DataFrame([closed()], columns=SECTION)

    found = slim.repartition("k").sortWithinPartitions("k", "p").mapInPandas(run, "k string, section_no long, heading string, content string, line_start long, line_end long")
    return found.select(F.col("k").cast(kinds[key]).alias(key), *SECTION[1:])


SECTION = ["k", "section_no", "heading", "content", "line_start", "line_end"]
