"""Bucketed stores: what a change touches, repeats and cut-off changes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.sources.store import BucketStore

SCHEMA = "material string, unit int, text string"


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 40}", i, f"text {i}") for i in range(400)], SCHEMA)
    made = BucketStore(spark, f"file://{tmp_path}/points", rows.schema, "material", 16)
    made.replace(rows)
    return made


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in Path(tmp_path).rglob("data/*/bucket=*/*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_replacing_one_material_leaves_other_buckets(spark, store, tmp_path):
    before, old, held = files(tmp_path), rows_of(store.read()), store.manifest()
    new = spark.createDataFrame([("m7", 1000, "new"), ("m7", 1001, None)], SCHEMA)
    assert store.replace(new) == 2
    after = files(tmp_path)
    assert {k: v for k, v in after.items() if k in before} == before  # nothing rewritten
    assert len({Path(k).parent for k in after.keys() - before.keys()}) == 1  # one bucket written
    assert sum(store.manifest()[b] != f for b, f in held.items()) == 1
    assert rows_of(store.read()) == sorted([r for r in old if r[0] != "m7"] + [("m7", 1000, "new"), ("m7", 1001, None)], key=lambda r: (r[0], r[1]))
    assert rows_of(store.read(1)) == old  # earlier versions stay


def test_reads_only_touched_buckets(spark, store):
    seen = []

    def apply(old):
        seen.append({f.rsplit("/", 2)[1] for f in old.inputFiles()})
        return old

    store.change(spark.createDataFrame([("m3",)], "material string"), apply)
    assert [len(s) for s in seen] == [1]


def test_tag_makes_a_change_once(spark, store, tmp_path):
    new = spark.createDataFrame([("m1", 5, "once")], SCHEMA)
    assert store.replace(new, tag="batch 1") == 2 and store.has("batch 1")
    listed = files(tmp_path)
    assert store.replace(spark.createDataFrame([("m1", 6, "twice")], SCHEMA), tag="batch 1") == 2
    assert files(tmp_path) == listed and store.read().filter("material = 'm1'").collect()[0].text == "once"


def test_emptied_buckets_and_null_keys(spark, store):
    everything = store.read().select("material")
    store.delete(everything)
    assert store.read().count() == 0 and store.manifest() == {}
    store.replace(spark.createDataFrame([(None, 1, "x"), ("a", 2, "y")], SCHEMA))
    assert rows_of(store.read().filter("material is null")) == [(None, 1, "x")]


def test_cut_off_change_can_be_made_again(spark, store, monkeypatch):
    old = rows_of(store.read())
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.replace(spark.createDataFrame([("m1", 5, "lost")], SCHEMA))
    assert rows_of(store.read()) == old and store.version() == 1
    assert store.replace(spark.createDataFrame([("m1", 5, "kept")], SCHEMA)) == 2


def test_second_change_of_a_version_raises(spark, store):
    other = BucketStore(spark, store.path, store.schema, "material", 16)

    def late(old):
        other.replace(spark.createDataFrame([("m2", 1, "first")], SCHEMA))
        return old

    with pytest.raises(RuntimeError, match="came first"):
        store.change(spark.createDataFrame([("m1",)], "material string"), late)
    assert store.version() == 2


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], "id long, value string, created long")
    store = BucketStore(spark, f"file://{tmp_path}/state", rows.schema, "id", 32)
    store.replace(rows)
    before = files(tmp_path)
    new = spark.createDataFrame([(5, "changed", 999), (500, "new", 7)], rows.schema)
    store.upsert(new, ["value"], ["created"])
    got = {r.id: r for r in store.read().collect()}
    assert len(got) == 101 and (got[5].value, got[5].created) == ("changed", 5) and (got[500].value, got[500].created) == ("new", 7)
    assert len({Path(k).parent for k in files(tmp_path).keys() - before.keys()}) <= 2
    assert store.read().agg(F.count_distinct("id")).first()[0] == 101
