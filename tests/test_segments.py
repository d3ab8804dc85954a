"""Sequential rules against plain statements of them, on whole tables and on small cases."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import segment
from quarry.session import table


def tokens(s):
    return [t for t in re.findall(T.TOKEN, s.lower()) if t not in T.TOKEN_STOP]


def plain_pieces(text, size):
    out = []
    for line in text.splitlines() or [text]:
        if len(tokens(line)) <= size:
            out.append(line)
            continue
        now, used = [], 0
        for word in line.split():
            n = len(tokens(word))
            if now and used + n > min(16, size):
                out.append(" ".join(now))
                now, used = [], 0
            now.append(word)
            used += n
        out.append(" ".join(now))
    return out


def plain_windows(text, size, overlap):
    pieces = plain_pieces(text, size)
    counts, at, out = [len(tokens(p)) for p in pieces], 0, []
    while True:
        end, used = at, 0
        while end < len(pieces) and (end == at or used + counts[end] <= size):
            used += counts[end]
            end += 1
        out.append((at + 1, end, used, "\n".join(pieces[at:end])))
        if end == len(pieces):
            return out
        gone, nxt = 0, at
        while nxt < end and gone < max(used - overlap, 1):
            gone += counts[nxt]
            nxt += 1
        at = max(nxt, at + 1)


def test_token_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for size, overlap in ((512, 64), (24, 6)):
        got = {}
        for r in segment.token_windows(docs, "doc_id", "text", size, overlap).collect():
            got.setdefault(r.doc_id, []).append((r.window_no, r.line_start, r.line_end, r.tokens, r.content))
        for d in docs.collect():
            assert [x[1:] for x in sorted(got[d.doc_id])] == plain_windows(d.text or "", size, overlap)


def test_greedy_groups_do_not_depend_on_parts(spark):
    """Hot and small keys, units larger than the target, section starts: parts from one to many."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice([0, 1, 5, 17, 40, 90]), rng.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, pos long, size int, start boolean")
    want, state = {}, {}
    for key, pos, size, start in sorted(rows, key=lambda r: (r[0], r[1])):
        used, group = state.get(key, (None, 0))
        if used is not None and (used + size > 60 or (start and used >= 36)):
            used, group = 0, group + 1
        state[key] = (used or 0) + size, group
        want[key, pos] = group
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "6", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.key, r.pos): r.group_no for r in segment.greedy_groups(df, "key", "pos", "size", 60, "start").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert segment.greedy_groups(df.limit(0), "key", "pos", "size", 60).count() == 0


def test_long_text_keeps_head_and_tail(spark):
    text = "HEAD_MARK\n" + "\n".join(" ".join(f"word{i * 16 + j}" for j in range(16)) for i in range(750)) + "\nTAIL_MARK"
    rows = segment.token_windows(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("window_no").collect()
    assert "HEAD_MARK" in rows[0].content and "TAIL_MARK" in rows[-1].content
    assert all(r.tokens <= 512 for r in rows)


def test_symbols(spark):
    code = "import os\n\n@wraps\n@other\ndef first():\n    pass\n\nclass Second:\n    def inner(self): ...\n"
    rows = segment.symbols(spark.createDataFrame([(1, "a/b.py", code), (2, "c.txt", code), (3, "d.go", "package x\nfunc (r R) Go() {}\ntype T int")], "id int, p string, t string"), "id", "p", "t").collect()
    assert sorted((r.id, r.symbol or "", r.line_start, r.line_end) for r in rows) == [(1, "", 1, 2), (1, "Second", 8, 9), (1, "first", 3, 7), (3, "", 1, 1), (3, "Go", 2, 2), (3, "T", 3, 3)]


def test_markdown_sections(spark):
    md = "intro\n# One\ntext\n### deep\n## Two\nlast"
    rows = segment.markdown_sections(spark.createDataFrame([(1, md), (2, ""), (3, "plain\ntext")], "id int, t string"), "id", "t").collect()
    assert sorted((r.id, r.section_no, r.heading or "", r.line_start, r.line_end) for r in rows) == [(1, 0, "", 1, 1), (1, 1, "One", 2, 4), (1, 2, "Two", 5, 6), (2, 0, "", 1, 1), (3, 0, "", 1, 2)]


def test_sections_with_a_key_of_any_name(spark):
    for key in ("n", "l", "s", "a", "lead", "i"):
        rows = segment.markdown_sections(spark.createDataFrame([(7, "x\n# One\ny"), (9, "")], f"{key} int, t string"), key, "t").collect()
        assert sorted((r[key], r.section_no, r.line_start, r.line_end) for r in rows) == [(7, 0, 1, 1), (7, 1, 2, 3), (9, 0, 1, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A b\tc \n", ["B ", "b", " ", "a", "A", "c"], "x y", 3, None, None)], "t string, l array<string>, p string, page int, a int, b int")
    r = df.select(T.clip("t").alias("c"), T.unique("l", 2).alias("u"), T.format_location("p", "page", "a", "b").alias("loc"), T.clip(F.lit("abc def ghi"), 5).alias("cut"), T.lines(F.lit("a\r\nb c\n")).alias("lines")).first()
    assert (r.c, r.u, r.loc, r.cut, r.lines) == ("A b c", ["B", "a"], "x y page 3", "abc…", ["a", "b", "c"])
