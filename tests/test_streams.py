"""Streams over restarts: changed and expired items, and the processing chain with failures and repeats."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.operators import numbering, segment
from quarry.operators.evidence import CARD
from quarry.streaming import ingest
from quarry.streaming.materials import FILES, MaterialPipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ITEMS = "path string, fingerprint string"


@pytest.fixture
def drop(spark, tmp_path):
    """Puts rows into the watched folder and returns what a stream started anew lets through."""
    seen = set()

    def run(rows, ttl_ms=3_600_000):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = ingest.changed_items(ingest.arriving(spark, f"file://{tmp_path}/in", ITEMS), "path", "fingerprint", None, ttl_ms)
        ingest.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        files = {f for f in spark.read.schema(ITEMS).parquet(f"file://{tmp_path}/out").inputFiles()}
        new = files - seen
        seen.update(files)
        return sorted(map(tuple, spark.read.schema(ITEMS).parquet(*new).collect()), key=str) if new else []

    return run


def test_changed_items_come_through_across_restarts(drop):
    assert drop([("a", "1"), ("b", "1"), ("a", "1"), ("c", None)]) == [("a", "1"), ("b", "1"), ("c", None)]
    assert drop([("a", "1"), ("b", "2"), ("c", None), ("d", "")]) == [("b", "2"), ("d", "")]
    assert drop([("a", "1"), ("b", "2")]) == []
    assert drop([("b", "1"), ("d", None)]) == [("b", "1"), ("d", None)]  # back to an earlier mark is a change


def test_expired_items_count_as_new_and_seen_ones_live_on(spark, drop):
    own = {k: spark.conf.get(k, None) for k in ingest.CONF}
    assert drop([("a", "1"), ("b", "1")], ttl_ms=25_000) == [("a", "1"), ("b", "1")]
    time.sleep(14)
    assert drop([("a", "1")], ttl_ms=25_000) == []  # seen again: its time starts anew
    time.sleep(14)
    assert drop([("a", "1"), ("b", "1")], ttl_ms=25_000) == [("b", "1")]
    assert {k: spark.conf.get(k, None) for k in ingest.CONF} == own  # the session is as it was


def lines(path, text):
    if "broken" in text:
        raise ValueError("broken file")
    return [(None, i + 1, i + 1, line) for i, line in enumerate(text.split("\n"))]


def put(spark, rows):
    return spark.createDataFrame([(m, "s", f"{m}/", p, t) for m, p, t in rows], FILES)


def held(pipeline):
    points = {}
    for r in pipeline.points.read().collect():
        points.setdefault(r.material_id, set()).add(r.content if r.unit != CARD else CARD)
    return points, {r.material_id: (r.status, r.error, r.batch_id) for r in pipeline.states.read().collect()}, sorted((r.material_id, r.path, r.stage, r.error) for r in pipeline.quarantine.read().collect())


def test_a_failing_material_is_quarantined_and_the_others_are_indexed(spark, tmp_path):
    p = MaterialPipeline(spark, f"file://{tmp_path}", 4, extract=lines)
    p.process(put(spark, [("good", "a.md", "one\ntwo"), ("bad", "a.md", "fine"), ("bad", "b.md", "broken"), ("odd", "../x.md", "text"), ("none", "n.md", None)]), 0)
    points, states, lost = held(p)
    assert points == {"good": {"one", "two", CARD}}
    assert states["good"][0] == "ready" and {m: s[:2] for m, s in states.items() if m != "good"} == {"bad": ("failed", "broken file"), "odd": ("failed", "unsafe path"), "none": ("failed", "no text")}
    assert lost == [("bad", "b.md", "extract", "broken file"), ("none", "n.md", "load", "no text"), ("odd", "../x.md", "load", "unsafe path")]

    # the same batch again, as after a lost driver: nothing changes
    versions = [s.version() for s in (p.points, p.analyses, p.quarantine, p.states)]
    p.process(put(spark, [("good", "a.md", "other")]), 0)
    assert [s.version() for s in (p.points, p.analyses, p.quarantine, p.states)] == versions and held(p) == (points, states, lost)

    # a mended material leaves quarantine; an unchanged one is not claimed; one that breaks keeps its points
    p.process(put(spark, [("good", "a.md", "one\ntwo"), ("bad", "b.md", "mended")]), 1)
    points, states, lost = held(p)
    assert points["bad"] == {"mended", CARD} and states["bad"] == ("ready", None, 1) and states["good"][2] == 0
    assert [x[0] for x in lost] == ["none", "odd"]
    p.process(put(spark, [("good", "a.md", "broken")]), 2)
    points, states, lost = held(p)
    assert points["good"] == {"one", "two", CARD} and states["good"] == ("failed", "broken file", 2)


def test_a_batch_cut_off_between_stores_is_finished_by_its_repeat(spark, tmp_path, monkeypatch):
    p = MaterialPipeline(spark, f"file://{tmp_path}", 4, extract=lines)
    batch = put(spark, [("m", "a.md", "one"), ("x", "a.md", "broken")])
    with monkeypatch.context() as c:
        c.setattr(p.quarantine, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            p.process(batch, 0)
    assert p.points.version() == 1 and p.states.version() == 0
    p.process(batch, 0)
    points, states, lost = held(p)
    assert p.points.version() == 1 and points == {"m": {"one", CARD}} and states["m"][0] == "ready" and [x[0] for x in lost] == ["x"]


def test_the_built_in_extraction_and_analysis(spark, tmp_path):
    p = MaterialPipeline(spark, f"file://{tmp_path}", 4)
    p.process(put(spark, [("doc", "a.md", "# Head\nbody of text\n## Next\nmore words here"), ("proj", "pyproject.toml", "name = 'tool'\n"), ("proj", "src/main.py", "import os\n\ndef run():\n    pass\n"), ("data", "rows.csv", "a,b\n1,2\n")]), 0)
    points, states, _ = held(p)
    assert {m: s[0] for m, s in states.items()} == {"doc": "ready", "proj": "ready", "data": "ready"}
    assert {r.material_id: (r.material_type, r.subtype) for r in p.states.read().collect()} == {"doc": ("document", "markdown"), "proj": ("project", "python"), "data": ("dataset", "csv")}
    assert "a, b" in points["data"] and any("def run" in c for c in points["proj"]) and len(points["doc"]) == 3
    found = {r.material_id: r for r in p.analyses.read().collect()}
    assert "Head" in found["doc"].keywords and found["proj"].purpose == "software project" and found["doc"].mode == "direct"


@pytest.mark.parametrize("rows", [10, 1000])
def test_one_key_with_all_rows_is_numbered_by_many_tasks(spark, monkeypatch, rows):
    monkeypatch.setattr(numbering, "PART_ROWS", rows)
    data = [("hot", i * 7919 % 500, "x" * 50) for i in range(500)] + [(None, i, "n") for i in range(30)] + [("small", 3, "s"), ("small", 1, "s"), ("tie", 1, "a"), ("tie", 1, "b")]
    got = numbering.numbered(spark.createDataFrame(data, "k string, pos int, content string"), ["k"], ["pos"]).collect()
    assert len(got) == len(data)
    for key in ("hot", None, "small"):
        own = sorted((r.pos, r.number) for r in got if r.k == key)
        assert [n for _, n in own] == list(range(len(own)))
    assert sorted(r.number for r in got if r.k == "tie") == [0, 1]


@pytest.mark.parametrize("rows", [3, 200])
def test_greedy_groups_take_null_as_a_key(spark, monkeypatch, rows):
    monkeypatch.setattr(segment, "PART_ROWS", rows)
    units = spark.createDataFrame([(k, i, 5) for k in (None, 2**60 + 1, 7) for i in range(6)], "k long, pos int, size int")
    got = segment.greedy_groups(units, "k", "pos", "size", 12).collect()
    for k in (None, 2**60 + 1, 7):
        assert [r.group_no for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == [0, 0, 1, 1, 2, 2]


def test_section_start_flushes_an_early_full_group(spark):
    texts = ["words", "# Head", "plain", "Chapter 3 begins", "#no heading", "section 9"]
    units = spark.createDataFrame([("m", i, 4, t) for i, t in enumerate(texts)], "k string, pos int, size int, text string").withColumn("start", segment.section_start("text"))
    assert [r.start for r in units.orderBy("pos").collect()] == [False, True, False, True, False, True]
    got = segment.greedy_groups(units, "k", "pos", "size", 20, "start", 0.3).orderBy("pos").collect()
    assert [r.group_no for r in got] == [0, 0, 0, 1, 1, 2]
    assert units.select(F.count_if("start")).first()[0] == 3
