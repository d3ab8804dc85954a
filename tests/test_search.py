"""Search, evaluation suites and chunking on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluate, index, profile, retrieve, search, segment
from quarry.session import table


@pytest.fixture(scope="module")
def small(spark):
    texts = ["alpha beta beta", "beta gamma", "", None, "delta alpha alpha alpha", "Alpha, the BETA!", "omega", "alpha beta beta"]
    points = spark.createDataFrame([(i, t, f"m{i % 3}") for i, t in enumerate(texts)], "point long, text string, grp string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma"), (3, ""), (4, None), (5, "none of these")], "query long, asked string")
    return points, queries


@pytest.mark.parametrize("restricted", [False, True])
def test_blocks_of_queries_give_the_rows_of_one_scan(spark, small, monkeypatch, restricted):
    points, queries = small
    hop1 = spark.createDataFrame([(1, "m0"), (1, "m2"), (2, "m0")], "query long, grp string") if restricted else None
    ask = lambda: sorted(map(tuple, search.top_points(points, "point", "text", queries, "query", "asked", 3, group="grp", hop1=hop1).select("list", "query", "rank", "point", "score").collect()))
    scanned = ask()
    monkeypatch.setattr(search, "QUERY_VALUES", 2000)
    assert ask() == scanned and len(scanned) >= 4


def test_an_embedder_of_ones_own_takes_any_number_of_queries(spark, monkeypatch):
    def embed(texts):
        dense = np.array([[len(t), t.count("a"), t.count("b") + 1] for t in texts], float).reshape(-1, 3)
        return dense, [(np.array([len(t) % 7]), np.array([1.0])) for t in texts]

    points = spark.createDataFrame([(i, "ab" * (i % 5) + "b" * (i % 3)) for i in range(60)], "point long, text string")
    queries = spark.createDataFrame([(i, "a" * (i % 4) + "b") for i in range(40)], "query long, asked string")
    ask = lambda: sorted(map(tuple, search.top_points(points, "point", "text", queries, "query", "asked", 4, embed).collect()))
    scanned = ask()
    monkeypatch.setattr(search, "QUERY_VALUES", 30)  # about ten queries a block
    assert ask() == scanned
    dense = {(r.query, r.point): r for r in search.top_points(points, "point", "text", queries, "query", "asked", 4, embed, lists=("dense",)).collect()}
    texts = [r.text for r in points.orderBy("point").collect()]
    for q in queries.collect():
        x, y = embed([q.asked])[0], embed(texts)[0]
        cosine = (y @ x[0]) / np.sqrt((y * y).sum(axis=1) * (x * x).sum())
        best = sorted(range(60), key=lambda i: (-cosine[i], i))[:4]
        assert [p for _, p in sorted((r.rank, p) for (k, p), r in dense.items() if k == q.query)] == best


def test_only_the_best_of_a_task_is_shuffled(spark, small):
    points, queries = small
    plan = search.top_points(points.repartition(4), "point", "text", queries, "query", "asked", 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and plan.count("MapInPandas") == 1


def test_best_keeps_ties_by_point():
    best = search.Best(2, 3)
    rng = np.random.default_rng(1)
    every = []
    for at in range(0, 400, 20):
        scores = rng.integers(0, 4, (20, 2)).astype(float)
        points = np.arange(at, at + 20)[::-1].copy()
        best.add(scores, points)
        every += [(q, -scores[i, q], points[i]) for i in range(20) for q in range(2) if scores[i, q] > 0]
        best.cut()
    query, score, point = best.cut()
    want = [x for q in range(2) for x in sorted(e for e in every if e[0] == q)[:3]]
    assert [(q, -s, p) for q, s, p in zip(query, score, point, strict=True)] == want


def test_containing_finds_short_and_foreign_cases(spark):
    cases = spark.createDataFrame([(1, "two words"), (2, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440"), (3, "a longer case of words"), (4, None), (5, "x")], "case_id long, text string")
    docs = spark.createDataFrame([(1, "some two words here"), (2, "\u043d\u0443, \u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440!"), (3, "this is a longer case of words, extra"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted(map(tuple, evaluate.containing(cases, docs, "case_id", "doc_id").collect()))
    want = sorted((c.case_id, d.doc_id) for c in cases.collect() for d in docs.collect() if c.text and d.text and c.text in d.text)
    assert got == want


def test_containing_against_every_pair(spark, monkeypatch):
    """Overlapping, repeated, empty and foreign cases, as one automaton and in blocks; nothing is joined."""
    texts = ["ab", "abc", "bc", "b", "", "ab", "\u0430\u0431", "line\nbreak", "x" * 50]
    cases = spark.createDataFrame([*enumerate(texts), (99, None)], "case_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcab", "bcb", "", "\u0430\u0431\u0432", "a line\nbreak", "x" * 60, None])], "doc_id long, text string")
    want = sorted((c, d.doc_id) for c, t in enumerate(texts) for d in docs.collect() if d.text is not None and t in d.text)
    for size in (2_000_000, 4):
        monkeypatch.setattr(evaluate, "BLOCK_CHARS", size)
        found = evaluate.containing(cases, docs, "case_id", "doc_id")
        assert sorted(map(tuple, found.collect())) == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert evaluate.containing(cases.limit(0), docs, "case_id", "doc_id").count() == 0


def test_a_scorer_is_built_once_a_task(spark, tmp_path):
    """UDF2: construction is counted in files; batches are many."""
    hits = spark.createDataFrame([(q, p, float(p), p + 1) for q in range(2) for p in range(40)], "query long, point long, score double, rank int")
    asked = spark.createDataFrame([(q, f"query {q}") for q in range(2)], "query long, query_text string")
    found = spark.createDataFrame([(p, f"text {p % 7}") for p in range(40)], "point long, point_text string")

    def build(folder=str(tmp_path)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return lambda a, b: b.str[-1].astype(float) + a.str[-1].astype(float)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = retrieve.rerank_with(hits.coalesce(1), asked, found, "query", "point", build=build).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.point % 7 for r in sorted(got, key=lambda r: (r.query, r.rank)) if r.query == 0][:6] == [6, 6, 6, 6, 6, 5]
    assert len(list(tmp_path.iterdir())) <= 8 < 80 / 5  # tasks, not batches


# Evaluation suites, restated as rows: (path, page, content) of each corpus and the lexical cases.

PROJECT = [("backend/pyproject.toml", None, "[project]\nname = 'backend'\n"), ("backend/src/main.py", None, "print('ok')\n"), ("backend/src/api.py", None, "def handle_request(path):\n    return 'ok'\n")]
DATA = [("dataset/rows.csv", None, "a,b\n1,2\n")]
HARD_API = "def handle_request(path: str) -> str:\n    return 'ok'\n\ndef retry_failed_request(path: str) -> str:\n    delay = 0.1\n    return 'backoff'\n"
TREATISE = "headmark_alpha appears at the start of the treatise.\n" + "".join(" ".join(f"bodyw{i}" for i in range(k, k + 16)) + "\n" for k in range(0, 2000, 16)) + "tailmark_omega appears at the end of the treatise.\n"
SUITES = {
    "simple_mix": (
        [("paper.pdf", 1, "Introduction to materials"), *PROJECT, *DATA],
        [("Introduction to materials", "paper.pdf", 1, False, None), ("handle_request", "src/api.py", None, True, None), ("print", "src/main.py", None, True, None)],
    ),
    "eval_hard": (
        [
            ("README.md", None, "# Research dump\n"), ("notes.txt", None, "todo: plot results\n"), ("stats.csv", None, "n,value\n1,3.2\n"), ("lab_notes.md", None, "# Lab notes\nWe measured thermal runaway of a cell on a hot plate.\n"),
            ("batteries.pdf", 1, "Introduction to battery materials. Thermal properties of lithium cells are reviewed at a high level."),
            ("batteries.pdf", 2, "Separator swelling under fast charge leads to thermal runaway. The failure starts at the separator."),
            PROJECT[0], PROJECT[1], ("backend/src/api.py", None, HARD_API), *DATA, ("tools/cli/requirements.txt", None, "pandas==2.2.0\n"), ("tools/cli/cli.py", None, "def main() -> None:\n    print('ok')\n"),
        ],
        [("separator swelling", "batteries.pdf", 2, False, None), ("handle_request", "src/api.py", None, True, "handle_request"), ("retry_failed_request", "src/api.py", None, True, "retry_failed_request"), ("hot plate", "lab_notes.md", None, True, None)],
    ),
    "eval_long": (
        [("treatise.txt", None, TREATISE), *PROJECT, *DATA],
        [("headmark_alpha", "treatise.txt", None, True, None), ("tailmark_omega", "treatise.txt", None, True, None), ("handle_request", "src/api.py", None, True, None)],
    ),
}


def chunks_of(spark, files, size):
    """Chunks of a corpus: material by top folder, type by suffix."""
    kind = {".pdf": ("document", "pdf"), ".md": ("document", "markdown"), ".txt": ("document", "text"), ".csv": ("dataset", "csv"), ".py": ("project", "python"), ".toml": ("project", "python")}
    rows = [(i, p.split("/")[0], *kind[p[p.rindex(".") :]], p, page, None, 1, text) for i, (p, page, text) in enumerate(files)]
    units = spark.createDataFrame(rows, "n long, material string, material_type string, subtype string, path string, page int, section string, line_start int, content string")
    cut = segment.cut_units(units, "n", "material", ["path", "n"], size, 32).join(units.select("n", "path"), "n")
    return cut.withColumn("unit", F.col("n") * 1_000_000 + F.col("chunk_index"))


def score(spark, name, size=512):
    files, asked = SUITES[name]
    chunks = chunks_of(spark, files, size).cache()
    words = profile.material_keywords(chunks.withColumn("pos", F.col("unit")), "material", "pos", "content")
    cards = words.select("material", index.card_text("material", "terms", F.slice("terms", 1, 12)).alias("card"))
    cases = spark.createDataFrame([(i, q, "lexical", 5) for i, (q, *_) in enumerate(asked)], "case_id long, query string, mode string, k int")
    hit = "struct<path:string,page:int,lines:boolean,section:string>"
    expect = spark.createDataFrame([(i, 0, tuple(e)) for i, (_, *e) in enumerate(asked)], f"case_id long, expect_no int, expected {hit}")

    def select(cases):
        found = search.two_hop(chunks, "unit", "content", cards, "material", "card", cases, "case_id", "query", 5)
        paged = F.when(F.col("page").isNull(), F.col("line_start"))
        cited = found.join(chunks.select("unit", "path", "page", "line_start", "line_end", "section"), "unit")
        return cited.select("case_id", "rank", "path", T.format_location("path", "page", "line_start", "line_end").alias("citation"), "page", paged.alias("line_start"), "section")

    return evaluate.score_selector(cases, expect, select, ("lexical",)).orderBy("case_id").collect(), chunks.count()


@pytest.mark.parametrize("name", sorted(SUITES))
def test_lexical_cases_hit_at_1(spark, name):
    scored, _ = score(spark, name)
    assert [r.hit_at_1 for r in scored] == [True] * len(SUITES[name][1]), scored


def test_chunk_sweep_keeps_the_hits(spark):
    runs = [score(spark, "eval_long", size) for size in (256, 1024)]
    assert runs[0][1] > runs[1][1] and all(r.hit_at_1 for scored, _ in runs for r in scored)


def test_cut_units(spark):
    long = "\n".join(" ".join(f"word{i}x{k}" for k in range(10)) for i in range(20))
    rows = [
        (1, "a", "document", "markdown", "a.md", None, None, 5, "intro\n# One\nbody\n## Two\n" + long), (2, "a", "document", "doc", "a.doc", None, None, None, "stub"),
        (3, "b", "code", "py", "b.py", None, None, 1, "import x\n\n@d\ndef f():\n    pass\n\nclass G:\n    pass\n"), (4, "b", "code", "py", "c.py", None, None, 1, "x = 1\n"),
        (5, "c", "document", "pdf", "p.pdf", 7, None, None, long), (6, "d", "document", "docx", "d.docx", None, "Head", 1, "t"), (7, "d", "document", "docx", "d.docx", None, None, 3, "u"),
        (8, "e", "code", "java_jar", "e.jar", None, None, None, long), (9, "f", "unknown", None, "f", None, None, None, None), (10, "g", "document", "markdown", "g.md", None, None, 1, "no heading"),
    ]
    units = spark.createDataFrame(rows, "n long, m string, material_type string, subtype string, path string, page int, section string, line_start int, content string")
    got = segment.cut_units(units, "n", "m", ["n"], 64, 8).orderBy("n", "part", "chunk_key").collect()
    by = {n: list(g) for n, g in itertools.groupby(got, lambda r: r.n)}
    assert set(by) == set(range(1, 11))
    assert [(r.section, r.line_start, r.line_end) for r in by[1][:3]] == [(None, 5, 5), ("One", 6, 7), ("Two", 8, 14)]
    assert {r.strategy for r in by[1]} == {"document.sections"} and len(by[1]) > 4 and by[1][-1].line_end == 28
    assert all(T_count(r.content) <= 64 for r in by[1])
    assert [(r.strategy, r.section, r.content.split("\n")[0]) for r in by[3]] == [("code.symbol", None, "import x"), ("code.symbol", "f", "@d"), ("code.symbol", "G", "class G:")]
    assert [r.strategy for n in (2, 4, 6, 7, 8, 9, 10) for r in by[n]] == ["stub", "code.file", "document.sections", "document.sections", "artifact", "passthrough", "document.window"]
    assert len(by[5]) > 2 and {(r.strategy, r.page) for r in by[5]} == {("document.pages", 7)}
    for m in "abcdefg":
        own = [r.chunk_index for r in got if r.m == m]
        assert sorted(own) == list(range(len(own)))


def T_count(text):
    return len(search.HashedEmbedder().numbers(text))


def test_unknown_type_is_an_error(spark):
    df = spark.createDataFrame([(" Document ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.checked_type("t")).collect()] == ["document", None, None]
    with pytest.raises(Exception, match="unknown material_type"):
        spark.createDataFrame([("novel",)], "t string").select(T.checked_type("t")).collect()


def test_analyses_of_no_rows(spark):
    m = spark.createDataFrame([], "material_id long, name string, version string, material_type string, subtype string")
    units = spark.createDataFrame([], "material_id long, pos long, title string, text string")
    files = spark.createDataFrame([], "material_id long, path string, pos long, text string")
    assert profile.analyzed(m, units, files, "material_id").count() == 0
    assert table(spark, "/root/testdata/sf0.001", "documents").count() == 200
