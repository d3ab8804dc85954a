"""Findings of the third review, each on rows that showed it."""

import sys

from compare import connect, difference
from pyspark import cloudpickle

from quarry.plans import registry
from quarry.plans.common import REGISTRY

registry.queries()
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def agrees(spark, tmp_path, name, **tables):
    """What a query and its SQL differ in on these tables."""
    for table, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"file://{tmp_path}/written-{table}")
        next((tmp_path / f"written-{table}").glob("*.parquet")).rename(tmp_path / f"{table}.parquet")
    f, sql = REGISTRY[name]
    return difference(spark, connect(str(tmp_path)), f, sql, str(tmp_path))


def test_a_split_material_may_have_the_number_of_a_whole_one(spark, tmp_path):
    rows = [(i, "text") for i in (*range(40, 50), *range(4000, 4020))]
    assert agrees(spark, tmp_path, "material_classes", documents=(rows, "doc_id long, text string")) == ""


def test_a_url_of_several_pages_comes_through_page_by_page(spark, tmp_path):
    urls = ["a", "a", "b", "b", None, "c", "a", "b", None, "c", "c", "d"]
    rows = [(i, url, None if i == 5 else "x" * (i % 3 + 1)) for i, url in enumerate(urls * 5)]
    assert agrees(spark, tmp_path, "stream_new_items", pages=(rows, "page_id long, url string, html string")) == ""


def test_snippets_and_lines_of_long_texts_take_time_in_proportion(spark, tmp_path):
    import time

    odd = ["", None, "\n", "\r\n", "a\r\n", "\r", "a\n\n", "...", "..a. b.", "a" * 180, "a" * 181, "  a \t b  " * 60, " " * 500, " \n" * 300 + "x", "no stop", "." * 5 + "x"]
    rows = [*enumerate(odd), (100, "a b " * 100_000), (101, "one. " + "word " * 100_000)]
    began = time.monotonic()
    assert agrees(spark, tmp_path, "text_functions", documents=(rows, "doc_id long, text string")) == ""
    assert time.monotonic() - began < 30


def test_digests_carry_the_heads_of_texts_alone(spark):
    from pyspark.sql import functions as F

    from quarry.operators import profile as P

    odd = ["", None, " \n\t", "One. Two! Three?", "a" * 900, "  x.  \n y? z", "w " * 5000 + ". end", "  a.   b.", "long " * 70 + "stop. Then. More.", ". . a. b", "# T\n" + "word. " * 3000]
    units = spark.createDataFrame([*enumerate(odd)], "k long, text string").withColumn("pos", F.lit(1))
    parts = P.unit_parts(units, ["k"], "pos", "text")
    assert max(len(r._t or "") for r in parts.collect()) < 1000 and "text" not in parts.columns
    got = {r.k: r.summary for r in P.summaries(parts, ["k"], "pos").collect()}
    whole = units.select("k", P.summary(F.when(F.col("text").rlike(P.VISIBLE), F.col("text")).otherwise("")).alias("s"))
    assert got == {r.k: r.s or "" for r in whole.collect()}


def test_workers_take_texts_in_slices(spark):
    import pandas as pd

    from quarry.operators import segment

    parts = list(segment.sliced(iter([pd.DataFrame({"x": range(segment.TEXTS + 3)})])))
    assert [len(p) for p in parts] == [segment.TEXTS, 3] and parts[1].index[0] == 0
    assert [segment.lines_of(t) for t in ("", "\n", "a\r\nb\n")] == [[], [""], ["a", "b"]]


def test_only_the_first_names_of_a_manifest_leave_its_row(spark, monkeypatch):
    from quarry.operators import profile as P

    names = [f"{'Pkg' if i % 3 else 'pKG'}{i % 250}" for i in range(2000)]
    lists = [(1, 5, names), (1, 5, ["other", "PKG7", *names[100:]]), (1, 2, ["Pkg249", "late", "LATE"]), (2, 1, [])]  # two files at one place
    lists += [(3, k, [f"n{j}" for j in range(40 * k, 40 * k + 60)]) for k in range(4)]
    rows = [(m, p, "requirements.txt", "\n".join(f"{x} >= 1" for x in own)) for m, p, own in lists] + [(4, 1, "Cargo.toml", "x"), (5, 1, "requirements.txt", None)]
    rows += [(6, 1, "requirements.txt", "a\n>= 1\n# c\nA\nb\n[extra]\nB ; x"), (6, 1, "requirements.txt", "c\nd\ne\nb")]  # lines without a name keep their number
    lists += [(6, 1, ["a", "", "A", "b", "", "B"]), (6, 1, ["c", "d", "e", "b"])]
    sent, whole = [], P.ordered_unique
    monkeypatch.setattr(P, "ordered_unique", lambda items, *a: sent.append(items) or whole(items, *a))
    files = spark.createDataFrame(rows, "m long, pos long, path string, text string")
    got = {r.m: r.terms for r in P.dependencies(files, "m", "path", "text", "pos").collect()}
    first = {}
    for m, p, own in lists:
        for i, x in enumerate(own):
            if x:
                first[m, x.lower()] = min(first.get((m, x.lower()), (p, i, x)), (p, i, x))
    want = {m: [f[2] for f in sorted(f for (k, _), f in first.items() if k == m)][:30] for m in (1, 3, 6)}
    assert got == want
    assert sent[0].count() <= 30 * len(rows)


def test_a_scorer_gets_small_batches(spark):
    import pandas as pd

    from quarry.operators import retrieve
    from quarry.session import BATCH

    chosen = spark.conf.get(BATCH) if BATCH in spark.conf.getAll else None
    spark.conf.unset(BATCH)
    try:
        hits = spark.range(1200).selectExpr("1L as q", "id as p", "0D as score", "cast(id as int) as rank").coalesce(1)
        texts = spark.range(1200).selectExpr("id as p", "'t' as point_text").coalesce(1)
        asked = spark.createDataFrame([(1, "a")], "q long, query_text string")
        got = retrieve.rerank_with(hits, asked, texts, "q", "p", lambda a, b: pd.Series([float(len(a))] * len(a))).collect()
        assert len(got) == 1200 and 0 < max(r.score for r in got) <= 500
    finally:
        spark.conf.unset(BATCH)
        if chosen:
            spark.conf.set(BATCH, chosen)


def test_a_search_behind_a_rerank_runs_once(spark):
    import pandas as pd

    from quarry.operators import retrieve

    met = spark.sparkContext.accumulator(0)

    def search(batches):
        for b in batches:
            met.add(len(b))
            yield b

    ranks = spark.range(50).selectExpr("id % 2 as q", "id as p", "0D as score", "cast(id div 2 + 1 as int) as rank")
    hits = ranks.mapInPandas(search, ranks.schema)
    texts = spark.range(50).selectExpr("id as p", "repeat('t', cast(id as int)) as point_text")
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "q long, query_text string")
    got = retrieve.rerank_with(hits, asked, texts, "q", "p", lambda a, b: b.str.len().astype(float)).collect()
    assert sorted((r.q, r.rank, r.p, r.score) for r in got) == sorted((p % 2, 25 - p // 2, p, float(p)) for p in range(50))
    assert met.value == 50


def test_long_texts_come_in_small_batches(spark):
    import numpy as np

    from quarry.operators import search
    from quarry.session import BATCH, BATCH_BYTES

    def embed(texts):
        if sum(map(len, texts)) > 16_000_000:
            raise ValueError("too much text at once")
        return np.array([[float(len(t))] for t in texts]), [(np.array([0]), np.array([float(t[-1] == "c")])) for t in texts]

    chosen = {k: v for k, v in spark.conf.getAll.items() if k in (BATCH, BATCH_BYTES)}
    for k in (BATCH, BATCH_BYTES):
        spark.conf.unset(k)
    try:
        points = spark.range(64).selectExpr("id as p", "repeat('ab c', 250000) as t").coalesce(1)
        asked = spark.createDataFrame([(1, "c")], "q long, asked string")
        got = search.top_points(points, "p", "t", asked, "q", "asked", 64, embed=embed).collect()
        assert sorted((r.list, r.p) for r in got) == [(name, p) for name in ("dense", "sparse") for p in range(64)]
    finally:
        for k in (BATCH, BATCH_BYTES):
            spark.conf.unset(k)
        for k, v in chosen.items():
            spark.conf.set(k, v)


def test_nothing_stays_of_very_many_or_very_long_tokens():
    from quarry.operators.search import CACHE_CHARS, CACHE_TOKENS, HashedEmbedder

    embedder = HashedEmbedder()
    for text in (" ".join(f"t{i}" for i in range(CACHE_TOKENS + 10)), " ".join(str(i) * 100_000 for i in range(10, 60)), "a b2 b2 the c3"):
        assert (embedder.numbers(text) == HashedEmbedder().numbers(text)).all()
        assert len(embedder.cache) <= CACHE_TOKENS and sum(map(len, embedder.cache)) <= CACHE_CHARS
    assert sorted(embedder.cache) == ["b2", "c3", "the"]


def test_a_task_hands_on_terms_of_many_materials(spark, monkeypatch):
    from quarry.operators import profile as P

    sent, whole = [], P.ordered_unique
    monkeypatch.setattr(P, "ordered_unique", lambda items, *a: sent.append(items) or whole(items, *a))
    units = spark.range(6000).selectExpr("cast(id % 3000 as string) as m", "id as pos", "array_join(transform(sequence(0, 39), x -> concat('term', x, 'of', id % 3000)), ' ') as text").coalesce(1)
    got = {r.m: r.terms for r in P.material_keywords(units, "m", "pos", "text").collect()}
    assert got == {str(m): [f"term{x}of{m}" for x in range(40)] for m in range(3000)}
    assert sent[0].count() > 3000 * 40  # 120,000 terms are more than a task holds, so some were handed on before they came again
