"""Files of a corpus: formats, boundaries, materials, digests, selections.

Listings are tables with a ``path`` column; ancestry is by exploded path prefixes, never by recursion.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.numbering import numbered

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Suffix to (action, format), compound suffixes first.
COMPOUND = {".tar.gz": "tar.gz", ".tar.bz2": "tar.bz2", ".tar.xz": "tar.xz"}
EXPAND = {".zip": "zip", ".tar": "tar", ".tgz": "tar.gz", ".7z": "7z", ".gz": "gzip"}
ARTIFACT = {".whl": "python_wheel", ".egg": "python_egg", ".jar": "java_jar", ".war": "java_war", ".nupkg": "nuget"}
PLAIN = {
    ".docx": "docx", ".docm": "docm", ".doc": "doc", ".xlsx": "xlsx", ".pptx": "pptx", ".apk": "android_apk", ".ipa": "ios_ipa",
    ".appx": "appx", ".exe": "installer", ".msi": "installer", ".msix": "installer", ".dmg": "installer", ".pkg": "installer",
}
SUFFIXES = {s: ("expand", f) for s, f in EXPAND.items()} | {s: ("artifact", f) for s, f in ARTIFACT.items()} | {s: ("file", f) for s, f in PLAIN.items()}
# Format hint to material type; the subtype is the hint itself.
HINT_TYPES = {
    "code": ("python_wheel", "python_egg", "java_jar", "java_war", "nuget", "node_tarball"),
    "document": ("docx", "docm", "doc"), "spreadsheet": ("xlsx",), "presentation": ("pptx",),
    "unknown": ("android_apk", "ios_ipa", "appx", "installer", "binary"),
}
# Project markers by priority.
MARKERS = {
    "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "Pipfile": "python", "package.json": "node",
    "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java",
}
# Names that are skipped, and file suffixes by class.
SKIP_DIRS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__MACOSX", "__pycache__", "build", "dist", "node_modules", "venv")
JUNK_FILES = (".DS_Store", "Thumbs.db")
DATA_DIRS = ("data", "dataset", "datasets")
CSV, PDF, TEXT = (".csv", ".tsv"), (".pdf",), (".txt", ".md", ".rst")
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".ipynb")
LOCKFILES = ("package-lock.json", "poetry.lock", "uv.lock", "yarn.lock", "pnpm-lock.yaml")
PROJECT_SKIP = ("tests", "test", "examples", "__pycache__", "node_modules", "dist", "build", ".git", "docs")
PROJECT_SUFFIXES = CODE + TEXT + (".toml", ".json", ".xml", ".gradle", ".mod")
IDENTITY = ("pyproject.toml", "go.mod", "package.json", "cargo.toml", "pom.xml", "pipfile", "setup.py", "build.gradle")
CONFIG = ("setup.cfg", "setup.py", "cargo.toml")
ENTRY = ("main.py", "main.go", "main.rs", "index.js", "index.ts", "index.mjs", "app.js", "app.ts", "app.jsx", "app.tsx", "cli.py")
API_STEMS = ("api", "routes", "router", "handler", "endpoint")
CORE_NAMES = ("core", "lib", "service", "internal")
# How many files of a role are read in depth, and the order of roles.
ROLE_BUDGET = {"identity": 2, "config": 2, "entry": 2, "api": 4, "core": 5}
ROLE_RANK = {"identity": 0, "config": 1, "entry": 2, "api": 3, "core": 4, "subsystem": 5}
# First bytes of a file, in order of precedence.
MAGIC = {
    "377ABCAF271C": "7z", "1F8B": "gzip", "504B": "zip", "7F454C46": "elf", "4D5A": "pe", "D0CF11E0": "ole",
    "FEEDFACE": "macho", "FEEDFACF": "macho", "CEFAEDFE": "macho", "CFFAEDFE": "macho", "CAFEBABE": "macho",
}


def mapped(key: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """The value of a literal map; null or ``default`` for other keys."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return out if default is None else F.coalesce(out, default)


def parts(path: str | Column) -> Column:
    return F.split(T.col(path), "/")


def is_skipped(name: Column) -> Column:
    return name.isin(*SKIP_DIRS, *JUNK_FILES) | name.startswith(".")


def visible(path: str | Column) -> Column:
    """No part of the path is hidden, a cache or a vendor name."""
    return ~F.exists(parts(path), is_skipped)


def suffix_format(path: str | Column) -> Column:
    """struct(action, format) by compound suffix, then by last suffix; null for none."""
    compound = F.regexp_extract(F.lower(T.file_name(path)), r"(\.tar\.(?:gz|bz2|xz))$", 1)
    pair = lambda action, fmt: F.struct(F.lit(action).alias("action"), F.lit(fmt).alias("format"))
    known = F.create_map(*[x for s, v in SUFFIXES.items() for x in (F.lit(s), pair(*v))], *[x for s, f in COMPOUND.items() for x in (F.lit(s), pair("expand", f))])
    return F.try_element_at(known, F.when(compound != "", compound).otherwise(T.suffix(path)))


def sniff(content: str | Column) -> Column:
    """Format by first bytes; tar by ``ustar`` at offset 257."""
    head = F.hex(F.substring(T.col(content), 1, 16))
    return F.coalesce(*[F.when(head.startswith(k), F.lit(v)) for k, v in MAGIC.items()], F.when(F.hex(F.substring(T.col(content), 258, 5)) == "7573746172", F.lit("tar")))


def decide(path: str | Column, sniffed: str | Column) -> Column:
    """struct(action, format): suffix result, else sniffed archive or binary, else a plain file."""
    s = T.col(sniffed)
    pair = lambda action, fmt: F.struct(F.lit(action).alias("action"), fmt.alias("format"))
    return F.coalesce(
        suffix_format(path),
        F.when(s.isin("7z", "gzip", "zip", "tar"), pair("expand", s)),
        F.when(s.isin("elf", "pe", "macho"), pair("file", F.lit("binary"))),
        F.when(s == "ole", pair("file", F.lit("installer"))),
        pair("file", F.lit("file")),
    )


def hint_type(hint: str | Column) -> Column:
    """struct(type, subtype) of a format hint; null for an unknown one."""
    h = T.col(hint)
    pair = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("subtype"))
    return F.coalesce(
        F.when(h.endswith("_project"), pair("project", F.regexp_replace(h, "_project$", ""))),
        F.when(h == "csv_dataset", pair("dataset", F.lit("csv"))),
        *[F.when(h.isin(*hints), pair(t, h)) for t, hints in HINT_TYPES.items()],
    )


def eligible(path: str | Column) -> Column:
    """Project files worth reading: no lockfiles, tests, docs or build output."""
    name = T.file_name(path)
    return (
        ~F.arrays_overlap(parts(path), F.array(*map(F.lit, PROJECT_SKIP))) & ~name.isin(*LOCKFILES) & ~name.startswith("test_")
        & (name.isin("go.mod", "Pipfile") | T.suffix(path).isin(*PROJECT_SUFFIXES))
    )


def role(path: str | Column, content: str | Column) -> Column:
    name, stem, own = F.lower(T.file_name(path)), F.lower(T.stem(path)), parts(path)
    folders = F.transform(F.slice(own, F.lit(1), F.size(own) - 1), F.lower)
    text = F.coalesce(T.col(content), F.lit(""))
    return (
        F.when(name.isin(*IDENTITY), "identity")
        .when(name.isin(*CONFIG), "config")
        .when(name.isin(*ENTRY) | (own[0] == "cmd"), "entry")
        .when(stem.isin(*API_STEMS) | stem.startswith("api_") | stem.startswith("routes"), "api")
        .when(text.contains("handle_request") | text.contains("HandleRequest"), "api")
        .when(stem.isin(*CORE_NAMES) | F.arrays_overlap(folders, F.array(*map(F.lit, CORE_NAMES))), "core")
        .otherwise("subsystem")
    )


def subsystem(path: str | Column) -> Column:
    own = parts(path)
    return F.when((F.size(own) >= 2) & own[0].isin("src", "lib", "pkg"), F.get(own, F.lit(1))).otherwise(own[0])


def deep_files(files: DataFrame, material: str, path: str, content: str, pos: str, cap: int = 20) -> DataFrame:
    """Files of each material that are read in depth, in order (``pick``).

    Inside a role whose files exceed its share, files are taken round-robin over subsystems in the
    order in which these are first seen; what is left fills up to ``cap`` by role, then position.
    """
    f = files.filter(eligible(path)).select(material, path, pos, role(path, content).alias("role"), subsystem(path).alias("sub"))
    f = f.withColumn("rank", mapped(F.col("role"), ROLE_RANK)).withColumn("budget", mapped(F.col("role"), ROLE_BUDGET, F.lit(0)))
    by_role, by_sub = Window.partitionBy(material, "role"), Window.partitionBy(material, "role", "sub")
    f = f.withColumn("n", F.count(F.lit(1)).over(by_role)).withColumn("round", F.row_number().over(by_sub.orderBy(pos))).withColumn("seen", F.min(pos).over(by_sub))
    roles = f.groupBy(material, "rank").agg(F.least(F.first("budget"), F.first("n")).alias("want"))
    before = Window.partitionBy(material).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    # Earlier roles take what they want until the cap is used up, so their sum up to the cap is what is gone.
    roles = roles.withColumn("take", F.greatest(F.least(F.col("want"), F.lit(cap) - F.coalesce(F.sum("want").over(before), F.lit(0))), F.lit(0))).drop("want")
    f = f.join(roles, [material, "rank"])
    whole = F.col("take") >= F.col("n")
    turn = F.row_number().over(by_role.orderBy("round", "seen", pos))
    f = f.withColumn("place", F.when(whole, F.row_number().over(by_role.orderBy(pos))).otherwise(turn))
    phase = F.when(F.col("place") <= F.col("take"), 0).otherwise(1)
    order = Window.partitionBy(material).orderBy("phase", "rank", F.when(F.col("phase") == 0, F.col("place")).otherwise(F.col(pos)), pos)
    return f.withColumn("phase", phase).withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= cap).select(material, path, "role", "pick")


def sample_members(members: DataFrame, archive: str, name: str, pos: str, cap: int, prefer: tuple[str, ...] = ("src/", "tests/", "examples/")) -> DataFrame:
    """First ``cap`` members by priority: identity files at the root, preferred prefixes, the rest."""
    n = F.col(name)
    root = ~n.contains("/") & F.lower(n).isin(*IDENTITY)
    priority = F.when(root, 0)
    for i, p in enumerate(prefer):
        priority = priority.when(n.startswith(p), i + 1)
    order = Window.partitionBy(archive).orderBy("priority", pos)
    return members.withColumn("priority", priority.otherwise(len(prefer) + 1)).withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= cap)


def classify(files: DataFrame, material: str, path: str) -> DataFrame:
    """type, subtype, confidence per material from its relative paths."""
    s, name = T.suffix(path), T.file_name(path)
    ranks = {m: i for i, m in enumerate(MARKERS)}
    marker = F.when(~F.col(path).contains("/") & name.isin(*MARKERS), name)
    # The two branches of artifact forms need the only path of a material.
    counted = files.withColumn("_s", s).groupBy(material).agg(
        F.min_by(F.struct(marker.alias("m")), mapped(marker, ranks)).getField("m").alias("marker"),
        F.bool_and(F.col("_s").isin(*CSV)).alias("csv"), F.bool_and(F.col("_s").isin(*PDF)).alias("pdf"), F.bool_and(F.col("_s").isin(*TEXT)).alias("text"),
        F.bool_or(F.col("_s") == ".md").alias("md"), F.bool_and(F.col("_s").isin(*CODE)).alias("code"), F.count(F.lit(1)).alias("n"),
        F.min(path).alias("first"), F.min_by("_s", path).alias("first_suffix"),
    )
    found = suffix_format("first")
    artifact = F.when((F.col("n") == 1) & F.lower("first").endswith(".tgz"), F.struct(F.lit("code").alias("type"), F.lit("node_tarball").alias("subtype"))).when((F.col("n") == 1) & (found["action"] != "expand"), hint_type(found["format"]))
    out = lambda t, sub, c: F.struct(F.lit(t).alias("type"), sub.cast("string").alias("subtype"), F.lit(c).alias("confidence"))
    decision = (
        F.when(F.col("marker").isNotNull(), out("project", mapped(F.col("marker"), MARKERS), 0.98))
        .when(F.col("csv"), out("dataset", F.lit("csv"), 0.9))
        .when(F.col("pdf"), out("document", F.lit("pdf"), 0.95))
        .when(F.col("text"), out("document", F.when(F.col("md"), "markdown").otherwise("text"), 0.9))
        .when(F.col("code"), out("code", F.substring("first_suffix", 2, 20), 0.85))
        .when(artifact.isNotNull(), F.struct(artifact["type"].alias("type"), artifact["subtype"].alias("subtype"), F.lit(0.9).alias("confidence")))
        .otherwise(out("unknown", F.lit(None), 0.0))
    )
    return counted.withColumn("d", decision).select(material, "d.type", "d.subtype", "d.confidence", "n")


def ancestors(path: str | Column) -> Column:
    """All folders above a path, from the top, each ending in ``/``."""
    own = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)), F.when(F.size(own) > 1, 1).otherwise(-1)), lambda i: F.concat(F.array_join(F.slice(own, F.lit(1), i), "/"), F.lit("/")))


def with_ancestors(files: DataFrame, path: str) -> DataFrame:
    """One row per file and folder above it: dir, depth."""
    deep = files.filter(F.size(parts(path)) > 1)
    return deep.select("*", F.posexplode(ancestors(path)).alias("depth", "dir"))


def project_dirs(files: DataFrame, path: str) -> DataFrame:
    """Folders that hold a marker file: dir, subtype, markers."""
    name = T.file_name(path)
    marked = files.filter(name.isin(*MARKERS) & F.col(path).contains("/"))
    own = marked.select(F.regexp_replace(path, "[^/]+$", "").alias("dir"), name.alias("m")).withColumn("p", mapped(F.col("m"), {m: i for i, m in enumerate(MARKERS)}))
    return own.groupBy("dir").agg(F.min_by(mapped(F.col("m"), MARKERS), "p").alias("subtype"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("p", "m"))), lambda x: x["m"]), ",").alias("markers"))


def dataset_dirs(files: DataFrame, path: str) -> DataFrame:
    """Folders of CSV files without any project marker below: dir, csv_files, confidence."""
    s, name = T.suffix(path), T.file_name(path)
    own = with_ancestors(files.filter(visible(path)), path)
    direct = F.size(parts(path)) == F.col("depth") + 2
    tree = own.groupBy("dir").agg(
        F.count_if(s.isin(*CSV)).alias("csv_files"), F.bool_or(name.isin(*MARKERS)).alias("marker"),
        F.bool_or(~direct).alias("folders"), F.bool_and(s.isin(*CSV)).alias("only_csv"),
    ).filter("csv_files > 0 and not marker")
    last = F.lower(F.element_at(F.split(F.rtrim("dir", F.lit("/")), "/"), -1))
    named = tree.withColumn("named", last.isin(*DATA_DIRS)).filter("named or (not folders and only_csv)")
    return named.select("dir", "csv_files", F.when(F.col("named"), 0.9).otherwise(0.85).alias("confidence"))


def boundaries(files: DataFrame, path: str) -> DataFrame:
    """dir, hint: the first of project and dataset decisions per folder."""
    p = project_dirs(files, path).select("dir", F.concat("subtype", F.lit("_project")).alias("p"))
    d = dataset_dirs(files, path).select("dir", F.lit("csv_dataset").alias("d"))
    return p.join(d, "dir", "full_outer").select("dir", F.coalesce("p", "d").alias("hint"))


def assign(files: DataFrame, path: str) -> DataFrame:
    """Each file's material: its topmost folder that is a boundary, else the file itself."""
    above = with_ancestors(files, path).join(boundaries(files, path), "dir")
    top = above.groupBy(path).agg(F.min_by(F.struct("dir", "hint"), "depth").alias("b"))
    return files.join(top, path, "left").withColumn("root", F.coalesce("b.dir", path)).withColumn("hint", F.col("b.hint")).drop("b")


def tree_digest(files: DataFrame, material: str, path: str, content_sha: str) -> DataFrame:
    """SHA-256 over the sorted ``path NUL sha LF`` entries of each material, and how many there are.

    Entries are dealt by material and sorted on disk where they do not fit; one running hash a task reads them in order, so a
    material of any size takes the memory of one batch.
    """
    kind = dict(files.dtypes)[material]
    slim = files.select(F.col(material).cast("string").alias("k"), F.col(path).alias("p"), F.col(content_sha).alias("s"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, n = None, None, 0
        for b in batches:
            done = []
            for k, p, s in zip(b["k"], b["p"], b["s"], strict=True):
                if state is None or k != key:
                    if state is not None:
                        done.append((key, state.hexdigest(), n))
                    key, state, n = k, hashlib.sha256(), 0
                if p is not None and s is not None:  # an entry without name or content says nothing
                    state.update(f"{p}\x00{s}\n".encode())
                n += 1
            yield pd.DataFrame(done, columns=["k", "digest", "files"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest(), n)], columns=["k", "digest", "files"])

    found = slim.repartition("k").sortWithinPartitions("k", "p", "s").mapInPandas(run, "k string, digest string, files long")
    return found.select(F.col("k").cast(kind).alias(material), "digest", "files")


def audit_members(members: DataFrame, max_member: int = 512 * 1024**2, max_ratio: float = 200.0, max_files: int = 10_000, max_total: int = 2 * 1024**3) -> DataFrame:
    """Violations per archive member, and whether its archive as a whole breaks a limit.

    members(archive, name, size, compressed, is_symlink, is_encrypted). Junk names are only checked by name.
    """
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    junk = F.arrays_overlap(F.split(name, "/"), F.array(F.lit("__MACOSX"), F.lit("__pycache__"))) | T.file_name(name).isin(*JUNK_FILES)
    rules = {
        "nul": F.col("name").contains("\x00"), "absolute": name.startswith("/"), "traversal": F.array_contains(F.split(name, "/"), ".."),
        "encrypted": ~junk & F.col("is_encrypted"), "symlink": ~junk & F.col("is_symlink"), "member_size": ~junk & (F.col("size") > max_member),
        "ratio": ~junk & (F.col("compressed") > 0) & (F.col("size") / F.when(F.col("compressed") > 0, F.col("compressed")) > max_ratio),
    }
    codes = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda x: x.isNotNull())
    w = Window.partitionBy("archive")
    total = F.sum(F.when(~junk, F.col("size")).otherwise(0)).over(w)
    return members.select("archive", "name", codes.alias("codes"), junk.alias("junk"), (F.count(F.lit(1)).over(w) > max_files).alias("too_many"), (total > max_total).alias("too_large"))


def package_contents(members: DataFrame, pos: str = "pos", limit: int = 20) -> DataFrame:
    """Per archive of members(archive, name, pos): the first ``limit`` top-level names (none of ``.dist-info`` or ``.data``) and
    packages of ``.class`` members in the order of the listing, counts of .py and .class members."""
    name = F.col("name")
    top = F.split(name, "/")[0]
    module = F.when((top != "") & ~top.endswith(".dist-info") & ~top.endswith(".data"), top)
    parent = F.regexp_replace(name, "/[^/]*$", "")
    package = F.when(name.endswith(".class") & ~name.startswith("META-INF/") & (parent != ""), F.replace(parent, F.lit("/"), F.lit(".")))
    terms = members.select("archive", pos, F.inline(F.array(F.struct(F.lit("modules").alias("kind"), module.alias("term")), F.struct(F.lit("packages").alias("kind"), package.alias("term")))))
    first = terms.filter("term is not null").groupBy("archive", "kind", "term").agg(F.min(pos).alias("_p"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("archive", "kind").orderBy("_p", "term"))).filter(F.col("_n") <= limit)
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_n", "term")))), lambda x: x["term"]), ",").alias(kind)
    counts = members.groupBy("archive").agg(F.count_if(name.endswith(".py")).alias("py"), F.count_if(name.endswith(".class")).alias("classes"))
    out = counts.join(ranked.groupBy("archive").agg(listed("modules"), listed("packages")), "archive", "left").na.fill("", ["modules", "packages"])
    return out.select("archive", "modules", "packages", "py", "classes")


def material_name(root_path: str | Column, title: str | Column) -> Column:
    """The package's title, else the last part of the path."""
    path = F.rtrim(T.col(root_path), F.lit("/"))
    return F.coalesce(F.nullif(F.trim(T.col(title)), F.lit("")), F.nullif(T.file_name(path), F.lit("")), T.col(root_path))


def material_metadata(hint: str | Column, origin: str | Column, **fields: str | Column) -> Column:
    """What goes with a material's name: ``material_hint`` and ``origin_chain`` (logical paths, outermost first), and of format,
    package, version and artifact_title those that are not empty, as a map."""
    own = [F.struct(F.lit("material_hint").alias("k"), T.col(hint).cast("string").alias("v")), F.struct(F.lit("origin_chain").alias("k"), F.array_join(T.col(origin), " > ").alias("v"))]
    own += [F.struct(F.lit(k).alias("k"), F.nullif(T.col(v).cast("string"), F.lit("")).alias("v")) for k, v in fields.items()]
    entries = F.filter(F.array(*own), lambda x: x["v"].isNotNull() | x["k"].isin("material_hint", "origin_chain"))
    return F.map_from_entries(entries)


MAX_NESTING = 5


def nested_nodes(files: DataFrame, path: str, is_dir: str) -> DataFrame:
    """Files and folders found inside archives: logical_path (folders end in ``/``), depth, origin (logical paths of the
    enclosing archives, outermost first) and rejected (more than ``MAX_NESTING`` archives around it)."""
    own = parts(F.rtrim(T.col(path), F.lit("/")))
    leaf = F.when(F.col(is_dir), F.concat(F.rtrim(T.col(path), F.lit("/")), F.lit("/"))).otherwise(F.col(path))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda i: F.array_join(F.slice(own, F.lit(1), i), "/"))
    archives = F.when(F.size(own) > 1, F.filter(above, lambda x: suffix_format(x)["action"] == "expand")).otherwise(F.array().cast("array<string>"))
    out = files.withColumn("logical_path", leaf).withColumn("depth", F.size(own) - 1).withColumn("origin", archives)
    return out.withColumn("rejected", F.size("origin") > MAX_NESTING)


ARTIFACTS, BINARIES, OFFICE = HINT_TYPES["code"], HINT_TYPES["unknown"], ("xlsx", "pptx")


def unit_shape(material_type: str | Column, subtype: str | Column, suffix: str | Column) -> Column:
    """Which kind of units a file gives; the first rule that holds decides."""
    t, s, x = T.col(material_type), F.coalesce(T.col(subtype), F.lit("")), T.col(suffix)
    by_suffix = F.when(x == ".pdf", "pages").when(x.isin(*CSV), "table").when(x.isin(".docx", ".docm"), "sections").otherwise("text")
    return (
        F.when(t == "project", "project").when(t == "dataset", "table").when((t == "document") & (s == "pdf"), "pages")
        .when(s.isin("docx", "docm"), "sections").when(s == "doc", "legacy").when(s.isin(*ARTIFACTS), "artifact").when(s.isin(*OFFICE), "office").when(s.isin(*BINARIES), "binary")
        .when(t.isin("document", "code"), "text").otherwise(by_suffix)
    )


def extract_units(files: DataFrame, material: str, path: str, text: str) -> DataFrame:
    """Units of files(material, type, subtype, path, text): material, path, shape, unit_type, content, line_start, line_end.

    One CASE decides each file's shape. Projects give their eligible files, datasets their column names, texts
    themselves; packages, office and binary files one stub each. Pages and sections need a decoder's rows and
    are not among them.
    """
    own = files.withColumn("_x", T.suffix(path)).withColumn("shape", unit_shape("type", "subtype", "_x"))
    own = own.filter(~F.col("shape").isin("pages", "sections") & ((F.col("shape") != "project") | eligible(path)))
    header = F.coalesce(F.get(T.lines(text), F.lit(0)), F.lit(""))
    columns = F.filter(F.transform(F.when(F.col("_x") == ".tsv", F.split(header, "\t")).otherwise(F.split(header, ",")), lambda v: F.trim(v)), lambda x: x != "")
    stub = (
        F.when(F.col("shape") == "legacy", "Legacy Word document (doc)").when(F.col("shape") == "office", F.concat(F.lit("Office document ("), "subtype", F.lit(")")))
        .when(F.col("shape") == "binary", F.concat(F.lit("Binary or installer ("), "subtype", F.lit(")"))).when(F.col("shape") == "artifact", F.col("subtype"))
    )
    whole = F.col("shape").isin("project", "text")
    content = F.when(whole, F.col(text)).when(F.col("shape") == "table", F.array_join(columns, ", ")).otherwise(stub)
    kind = F.when(F.col("shape") == "legacy", "office").otherwise(F.col("shape"))
    return own.select(material, path, "shape", kind.alias("unit_type"), content.alias("content"), F.when(whole, F.lit(1)).alias("line_start"), F.when(whole, T.line_count(text)).alias("line_end"))


def describe(material_type: str | Column, subtype: str | Column, units: str | Column, files: str | Column) -> Column:
    """One line about a material by its type."""
    t, u, f = T.col(material_type), T.col(units), T.col(files)
    counted = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))
    return (
        F.when((t == "document") & (T.col(subtype) == "pdf"), counted(u, " page PDF", " pages PDF"))
        .when(t == "project", F.concat(F.coalesce(F.nullif(T.col(subtype), F.lit("")), F.lit("software")), F.lit(" project, "), counted(f, " citable file", " citable files")))
        .when(t == "dataset", F.concat(F.lit("CSV dataset, "), counted(f, " file", " files")))
        .otherwise(F.concat(counted(u, " content unit", " content units")))
    )


def discovery_errors(materials: DataFrame, expected: DataFrame, packages: str = "packages/") -> DataFrame:
    """(rule, key, detail) for materials(root_path, material_type) against expected(path, material_type): ``missing`` for
    a path that no material matches (wheels apart, whose names carry versions), ``wheel`` if none is under ``packages``, ``type`` for a material of another type than its path asks for, ``vendor`` and
    ``tests`` for trees that must not become materials.

    A path matches if it is equal, lies below (``/`` at the end), is one part of the other, or ends it. Every
    rule is an equi-join on the keys that a root path offers.
    """
    root = F.col("root_path")
    pairs = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))
    tails = F.transform(F.sequence(F.lit(1), F.length(root)), lambda i: F.substr(root, i))
    offered = F.concat(pairs("below", ancestors(F.concat(F.rtrim(root, F.lit("/")), F.lit("/x")))), pairs("part", F.split(root, "/")), pairs("end", tails))
    keys = materials.filter("root_path <> ''").select(F.explode(offered).alias("k")).select("k.*").distinct()
    e = F.col("path")
    asked = F.array(F.struct(F.lit("below").alias("kind"), F.when(e.endswith("/"), e).alias("key")), F.struct(F.lit("part").alias("kind"), F.rtrim(e, F.lit("/")).alias("key")), F.struct(F.lit("end").alias("kind"), e.alias("key")))
    met = expected.select("path", F.explode(asked).alias("k")).select("path", "k.*").join(keys, ["kind", "key"]).select("path").distinct()
    missing = expected.filter(~e.endswith(".whl")).join(met, "path", "left_anti").select(F.lit("missing").alias("rule"), F.col("path").alias("key"), F.lit("").alias("detail"))
    wanted = expected.filter("material_type is not null").select(F.col("path").alias("root_path"), F.col("material_type").alias("want"))
    wrong = materials.join(wanted, "root_path").filter("not material_type <=> want").select(F.lit("type"), root, F.concat(F.coalesce("material_type", F.lit("none")), F.lit(" expected "), "want"))
    vendor = materials.filter(F.arrays_overlap(F.split(root, "/"), F.array(*map(F.lit, ("node_modules", ".venv", "venv"))))).select(F.lit("vendor"), root, F.lit(""))
    tests = materials.filter(F.rtrim(root, F.lit("/")).endswith("/tests") | (root == "tests/")).select(F.lit("tests"), root, F.lit(""))
    wheels = materials.agg(F.count_if(root.startswith(packages) & root.endswith(".whl")).alias("n")).filter("n = 0").select(F.lit("wheel"), F.lit(packages), F.lit(""))
    return missing.union(wheels).union(wrong).union(vendor).union(tests)


def skipped_files(files: DataFrame, units: DataFrame, material: str, path: str, limit: int = 30) -> DataFrame:
    """Files of a material without any unit, the first ``limit`` by path."""
    none = files.join(units.select(material, path), [material, path], "left_anti")
    order = Window.partitionBy(material).orderBy(path)
    return none.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def label_nodes(nodes: DataFrame, source: str, is_material: str, pos: str) -> DataFrame:
    """M1.. for materials and C1.. for other nodes, in order."""
    placed = numbered(nodes, [source, is_material], [pos], "_n")
    return placed.withColumn("label", F.concat(F.when(F.col(is_material), "M").otherwise("C"), (F.col("_n") + 1).cast("string"))).drop("_n")


def ordered_listing(files: DataFrame, folder: str, path: str) -> DataFrame:
    """Place (from 1) of every path in its folder, without regard to case first."""
    placed = numbered(files.withColumn("_low", F.lower(path)), [folder], ["_low", path], "place")
    return placed.drop("_low").withColumn("place", (F.col("place") + 1).cast("int"))
