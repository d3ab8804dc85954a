"""File and project rules on the fixtures' trees."""

import hashlib
import random

from quarry.operators import corpus as C
from quarry.operators import profile as P
from quarry.sources import files


def listing(spark, paths, material="m"):
    return spark.createDataFrame([(material, i, p, "def handle_request(): ..." if p.endswith("hook.py") else "") for i, p in enumerate(paths)], "m string, pos int, path string, text string")


def test_classes(spark):
    cases = {
        "py": ["pyproject.toml", "src/main.py"], "go": ["go.mod", "main.go"], "data": ["a.csv", "b/c.tsv"], "md": ["a.md", "b.txt"], "pdf": ["x.pdf"],
        "code": ["a.py", "b.js"], "wheel": ["x-1.whl"], "tgz": ["n.tgz"], "zip": ["n.zip"], "mixed": ["a.py", "b.csv"],
    }
    df = None
    for k, v in cases.items():
        df = listing(spark, v, k) if df is None else df.union(listing(spark, v, k))
    got = {r.m: (r.type, r.subtype, r.confidence) for r in C.classify(df, "m", "path").collect()}
    assert got == {
        "py": ("project", "python", 0.98), "go": ("project", "go", 0.98), "data": ("dataset", "csv", 0.9), "md": ("document", "markdown", 0.9), "pdf": ("document", "pdf", 0.95),
        "code": ("code", "py", 0.85), "wheel": ("code", "python_wheel", 0.9), "tgz": ("code", "node_tarball", 0.9), "zip": ("unknown", None, 0.0), "mixed": ("unknown", None, 0.0),
    }


def test_boundaries(spark):
    paths = ["paper.pdf", "backend/pyproject.toml", "backend/src/main.py", "backend/data/x.csv", "data/2023/a.csv", "data/2024/b.csv", "rows/a.csv", "rows/b.tsv", "other/a.csv", "other/n.txt"]
    got = {r.path: (r.root, r.hint) for r in C.assign(listing(spark, paths), "path").collect()}
    assert got["paper.pdf"] == ("paper.pdf", None)
    assert got["backend/src/main.py"] == got["backend/data/x.csv"] == ("backend/", "python_project")
    assert got["data/2023/a.csv"] == ("data/", "csv_dataset")
    assert got["rows/b.tsv"] == ("rows/", "csv_dataset")
    assert got["other/a.csv"] == ("other/a.csv", None)


def test_wide_project_keeps_twenty_files(spark):
    paths = ["pyproject.toml", "src/main.py", "src/api.py", "src/util.py"] + [f"src/api_{i:02d}.py" for i in range(40)] + [f"tests/test_{i:02d}.py" for i in range(25)]
    rows = C.deep_files(listing(spark, paths), "m", "path", "text", "pos", 20).orderBy("pick").collect()
    chosen = [r.path for r in rows]
    assert len(chosen) == 20 and chosen[:3] == ["pyproject.toml", "src/main.py", "src/api.py"]
    assert "src/util.py" not in chosen and not any(p.startswith("tests/") for p in chosen)


def test_dependencies_and_csv(spark):
    rows = [("p", 0, "package.json", '{"name":"x","dependencies":{"react":"1"},"peerDependencies":{"vue":"2","React":"3"}}'), ("p", 1, "requirements.txt", "# c\npandas==2.2\n-r a\nnumpy>=1; x"), ("p", 2, "go.mod", "module m\n\texample.com/a v1.2.3\n")]
    df = spark.createDataFrame(rows, "m string, pos int, path string, text string")
    assert P.dependencies(df, "m", "path", "text", "pos").first().terms == ["react", "vue", "pandas", "numpy", "example.com/a"]
    csv = spark.createDataFrame([(1, "a.tsv", "a\t b \t\n1\t2\t3\n"), (2, "b.csv", "")], "id int, path string, text string")
    assert {r.id: (r.rows, r.columns) for r in P.csv_profile(csv, "id", "path", "text").collect()} == {1: (1, ["a", "b"]), 2: (0, [])}


def test_tree_digest_is_one_running_hash(spark):
    """A material with most of the files, null and repeated entries, keys with null: the digest of the sorted list."""
    rows = [("big", f"p{i:05d}", f"s{i % 7}") for i in range(5000)] + [("small", "b", "2"), ("small", "a", "1"), (None, "x", "9"), ("small", "a", "1"), ("holes", None, "3"), ("holes", "c", "4")]
    got = {r.m: (r.digest, r.files) for r in C.tree_digest(spark.createDataFrame(rows, "m string, path string, sha string").repartition(7), "m", "path", "sha").collect()}
    for key in ("big", "small", None, "holes"):
        own = sorted((p, s) for m, p, s in rows if m == key and p is not None)
        assert got[key] == (hashlib.sha256("".join(f"{p}\x00{s}\n" for p, s in own).encode()).hexdigest(), sum(m == key for m, _, _ in rows))
    plan = C.tree_digest(spark.createDataFrame(rows, "m string, path string, sha string"), "m", "path", "sha")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no array of the entries


def test_manifest_entries_are_rows(spark, tmp_path):
    rows = [("m", "b", "2", 5), ("m", "a", "1", 3), ("n", "c", "3", 4)]
    df = spark.createDataFrame(rows, "material string, path string, sha string, size long")
    files.manifest_entries(df, "material", f"file://{tmp_path}/manifest")
    assert sorted(map(tuple, spark.read.json(f"file://{tmp_path}/manifest").select("material", "path", "sha", "size").collect())) == sorted(rows)
    assert {r.material: (r.files, r.bytes) for r in files.manifest(df, "material").collect()} == {"m": (2, 8), "n": (1, 4)}


def test_package_contents_as_listed(spark):
    names = ["requests/__init__.py", "requests-2.0.dist-info/METADATA", "zlib.py", "requests/api.py", "x.data/scripts/run", "org/app/Main.class", "META-INF/x/Y.class", "Top.class", "org/app/Other.class", "/odd", *[f"m{i:02d}/a" for i in range(25)]]
    got = C.package_contents(spark.createDataFrame([("a", n, i) for i, n in enumerate(names)] + [("b", "n.txt", 0)], "archive string, name string, pos int"))
    by = {r.archive: r for r in got.collect()}
    tops = ["requests", "zlib.py", "org", "META-INF", "Top.class"]
    assert by["a"].modules.split(",") == [*tops, *[f"m{i:02d}" for i in range(15)]] and by["a"].packages.split(",") == ["org.app", "Top.class"]
    assert (by["a"].py, by["a"].classes, by["b"].modules, by["b"].packages) == (3, 4, "n.txt", "")


def test_discovery_asks_for_any_wheel(spark):
    expected = spark.createDataFrame([("packages/x-1.whl", "code"), ("docs/", None)], "path string, material_type string")
    found = lambda *roots: sorted(tuple(r) for r in C.discovery_errors(spark.createDataFrame([(r, "code") for r in roots], "root_path string, material_type string"), expected).collect())
    assert found("docs/") == [("wheel", "packages/", "")]
    assert found("docs/", "packages/x-2.whl") == []
    assert found("packages/x-1.whl") == [("missing", "docs/", "")]


def test_first_terms_of_a_task_are_those_of_all(spark, monkeypatch):
    """Keywords of materials over many tasks, with little held at a time, against one list after the other."""
    rng = random.Random(4)
    words = [f"{c}word{i}" for i in range(60) for c in ("x", "X", "y")]
    rows = [(m, i, " ".join(rng.choices(words, k=30))) for m in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "m string, pos long, text string").repartition(6)
    for held in (10, 1_000_000):
        monkeypatch.setattr(P, "HELD_TERMS", held)
        got = {r.m: r.terms for r in P.material_keywords(df, "m", "pos", "text", 25, 8).collect()}
        for key in ("a", "b", None):
            seen: dict[str, str] = {}
            for _, _, text in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                own: dict[str, str] = {}
                for w in text.split():
                    own.setdefault(w.lower(), w)
                for low, w in list(own.items())[:8]:
                    seen.setdefault(low, w)
            assert got[key] == list(seen.values())[:25]


def test_summary_of_units_after_blank_ones(spark):
    rows = [("a", 1, " "), ("a", 2, ""), ("a", 3, "First one. Second"), ("a", 4, " \n"), ("a", 5, "goes on. Third."), ("b", 1, "\t"), ("b", 2, "Only this. And that. Not this."), ("c", 1, ""), ("d", 1, ""), ("d", 2, ""), *[("d", 3 + i, "x") for i in range(600)]]
    got = {r.m: r.summary for r in P.leaf_digests(spark.createDataFrame(rows, "m string, pos int, text string"), ["m"], "pos", "text").collect()}
    assert got == {"a": "First one. Second\ngoes on.", "b": "Only this. And that.", "c": "", "d": "\n".join("x" * 600)[:400]}
