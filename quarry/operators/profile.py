"""Material profiles: keywords, digests, coverage, inventories, entities."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C
from quarry.session import scratch_dir, text_batches

# What tasks use travels to the workers by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Terms of all materials that a task holds before it hands them on.
HELD_TERMS = 100_000
# Language of a source suffix, relevance and purpose of a material type.
LANGUAGES = {".py": "python", ".go": "go", ".rs": "rust", ".js": "javascript", ".ts": "typescript", ".java": "java"}
RELEVANCE = {"document": 0.8, "project": 0.7, "code": 0.6, "dataset": 0.5}
PURPOSE = {"document": "document for research reading", "project": "software project", "dataset": "tabular dataset", "code": "source code"}
DIRECT_TOKENS = 20_000


def ordered_unique(items: DataFrame, key: str, term: str, order: list[str], limit: int) -> DataFrame:
    """First spelling of each case-insensitively distinct term per key, the first ``limit`` by first place.

    ``items`` has one row per occurrence; occurrences are combined before they are ranked.
    """
    own = items.withColumn("_t", F.trim(term)).filter("_t <> ''")
    first = own.groupBy(key, F.lower("_t").alias("_k")).agg(F.min(F.struct(*order, F.col("_t").alias("term"))).alias("f"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("f"))).filter(F.col("place") <= limit)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "f.term"))), lambda x: x["term"]).alias("terms"))


def material_keywords(units: DataFrame, key: str, pos: str, text: str, limit: int = 80, per_unit: int = 40) -> DataFrame:
    """Keywords of each material from the first ``per_unit`` unique keywords of every unit in order.

    A task keeps the first ``limit`` distinct terms of each material that it meets, and only these are shuffled: a term among the
    first of all is among the first of the task that holds its first place.
    """
    kinds = dict(units.dtypes)
    text_batches(units.sparkSession)
    lists = distinct_terms(units.select(F.col(key).cast("string").alias("_k"), F.col(pos).alias("_p"), T.keywords(text).alias("_w")), per_unit)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, dict[str, tuple]] = {}
        n = 0

        def cut() -> pd.DataFrame:
            rows = [(k, low, *first) for k, own in held.items() for low, first in sorted(own.items(), key=lambda x: x[1])[:limit]]
            return pd.DataFrame(rows, columns=["_k", "low", "_p", "i", "term"])

        for b in batches:
            for k, at, terms, lows in zip(b["_k"], b["_p"].tolist(), b["_terms"], b["_lows"], strict=True):
                own = held.setdefault(k, {})
                n -= len(own)
                for i, (term, low) in enumerate(zip(terms, lows, strict=True)):
                    if low not in own or own[low] > (at, i, term):
                        own[low] = (at, i, term)
                if len(own) > 4 * limit:
                    own = held[k] = dict(sorted(own.items(), key=lambda x: x[1])[:limit])
                n += len(own)
            if n > HELD_TERMS:
                yield cut()
                held, n = {}, 0
        yield cut()

    slim = lists.select("_k", "_p", F.col("_picked").alias("_terms"), F.transform("_picked", F.lower).alias("_lows"))
    found = slim.mapInPandas(run, f"_k string, low string, _p {kinds[pos]}, i int, term string")
    return ordered_unique(found.select(F.col("_k").cast(kinds[key]).alias(key), "_p", "i", "term"), key, "term", ["_p", "i"], limit)


def unit_keywords(units: DataFrame, keys: list[str], text: str, limit: int) -> DataFrame:
    """(keys, i, term): unique keywords of each unit, inside its row; each list is computed once."""
    return unique_terms(units.select(*keys, T.keywords(text).alias("_w")), keys, limit)


def unique_terms(lists: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, i, term): unique items of each list ``_w``, inside its row; each list is computed once, not once an item."""
    return distinct_terms(lists, limit).select(*keys, F.posexplode("_picked").alias("i", "term"))


def distinct_terms(lists: DataFrame, limit: int) -> DataFrame:
    """``lists`` with ``_picked``: the first ``limit`` items of ``_w`` that differ without regard to case, trimmed."""
    own = lists.withColumn("_w", F.filter(F.transform("_w", lambda v: F.trim(v)), lambda x: x != ""))
    low = own.withColumn("_l", F.transform("_w", F.lower)).withColumn("_d", F.slice(F.array_distinct("_l"), 1, limit))
    return low.withColumn("_picked", F.transform("_d", lambda k: F.element_at("_w", F.array_position("_l", k).cast("int"))))


def lift(units: DataFrame, key: str, pos: str, names: list[str]) -> DataFrame:
    """First non-blank value of each metadata column in unit order."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return units.groupBy(key).agg(*[F.min_by(blank(c), F.when(blank(c).isNotNull(), F.col(pos))).alias(c) for c in names])


def sentences(text: str | Column) -> Column:
    return F.filter(F.transform(F.split(T.col(text), r"(?<=[.!?])\s+"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


SUMMARY = 400
VISIBLE = r"(?U)\S"


def summary(text: str | Column, n: int = 2, limit: int = SUMMARY) -> Column:
    """First ``n`` sentences, cut to ``limit`` characters."""
    return F.substring(F.array_join(F.slice(sentences(text), 1, n), " "), 1, limit)


#: White space and as many visible characters as a summary can show: what follows them does not change it.
HEAD = rf"(?U)\A\s*+(?:\S\s*+){{0,{SUMMARY + 2}}}+"
TERMS, TITLES = 20, 8


def unit_parts(units: DataFrame, keys: list[str], pos: str, text: str, page: str | None = None, path: str | None = None) -> DataFrame:
    """What a digest takes of each unit, written once: the other steps never meet a whole text again."""
    slim = units.select(*keys, pos, F.col(text).alias("_x"), *([F.col(page).alias("_page")] if page else []), *([F.nullif(path, F.lit("")).alias("_path")] if path else []))
    kept = [*keys, pos, "_x", *[c for c in ("_page", "_path") if c in slim.columns]]
    headed = distinct_terms(slim.select(*kept, T.headings("_x").alias("_w")), TERMS)  # of a unit's terms no later one can be among the first of its group
    headed = headed.select(*kept, F.slice("_w", 1, TITLES).alias("_titles"), F.col("_picked").alias("_t0"))
    both = distinct_terms(headed.withColumn("_w", T.plain_keywords("_x")), TERMS)
    shown = F.when(F.col("_x").rlike(VISIBLE), F.regexp_extract("_x", HEAD, 0)).alias("_t")
    out = both.select(*[c for c in kept if c != "_x"], shown, "_titles", "_t0", F.col("_picked").alias("_t1"), T.token_count("_x").alias("_tokens"))
    folder = scratch_dir(units.sparkSession, "unit-parts")
    out.write.parquet(folder)
    return units.sparkSession.read.schema(out.schema).parquet(folder)


def summaries(parts: DataFrame, group: list[str], pos: str) -> DataFrame:
    """(group, summary): of the first two units, of all if both are blank. parts(group, pos, _t: a unit's head, null if blank)."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(pos))
    slim = parts.select(*group, pos, "_t")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_n", "_t")))), lambda x: x["_t"]), "\n")
    firsts = slim.withColumn("_n", nth).filter("_n <= 2").groupBy(*group).agg(F.coalesce(head, F.lit("")).alias("_h"))
    # Where the first two are blank the whole group's text is summed up; a unit that is not blank has a character at least, so more than
    # ``SUMMARY`` of them cannot be seen.
    rest = slim.filter("_t is not null").join(firsts.filter("_h = ''").select(*group), group, "left_semi")
    whole = rest.withColumn("_n", nth).filter(F.col("_n") <= SUMMARY + 1).groupBy(*group).agg(head.alias("_w"))
    return firsts.join(whole, group, "left").select(*group, summary(F.coalesce(F.nullif("_h", F.lit("")), "_w", F.lit(""))).alias("summary"))


def unit_heads(units: DataFrame, group: list[str], pos: str, text: str) -> DataFrame:
    """What :func:`summaries` takes of each unit."""
    return units.select(*group, pos, F.when(F.col(text).rlike(VISIBLE), F.regexp_extract(text, HEAD, 0)).alias("_t"))


def leaf_digests(units: DataFrame, group: list[str], pos: str, text: str, page: str | None = None, path: str | None = None) -> DataFrame:
    """One extractive digest per group of units: summary of the first two (of all if both are blank), first 8 headings, 12 topics and 20 keywords
    (headings of the whole group first, then its words), page range or first and last path, counts, range.
    """
    return grouped_digests(unit_parts(units, group, pos, text, page, path), group, pos)


def grouped_digests(parts: DataFrame, group: list[str], pos: str) -> DataFrame:
    """:func:`leaf_digests` of :func:`unit_parts`."""
    page, path = "_page" in parts.columns, "_path" in parts.columns
    gkey = F.struct(*group).alias("_g")
    titled = parts.select(gkey, pos, F.posexplode("_titles").alias("i", "term"))
    first = titled.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(pos, "i"))).filter(F.col("_n") <= TITLES)
    ungroup = lambda df, *c: df.select(*[F.col(f"_g.{g}").alias(g) for g in group], *c)
    headed = ungroup(first.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]).alias("headings")), "headings")
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("_t0").alias("_terms")), F.struct(F.lit(1).alias("part"), F.col("_t1").alias("_terms")))
    terms = parts.select(gkey, pos, F.inline(both)).select("_g", pos, "part", F.posexplode("_terms").alias("i", "term"))
    words = ungroup(ordered_unique(terms, "_g", "term", ["part", pos, "i"], TERMS), F.col("terms").alias("keywords"))
    ranges = [F.min("_page").alias("page_start"), F.max("_page").alias("page_end")] if page else []
    ranges += [F.min_by("_path", F.when(F.col("_path").isNotNull(), F.col(pos))).alias("path_start"), F.max_by("_path", F.when(F.col("_path").isNotNull(), F.col(pos))).alias("path_end")] if path else []
    out = parts.groupBy(*group).agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("units"), F.sum("_tokens").alias("tokens"), *ranges)
    if page and path:
        out = out.withColumns({c: F.when(F.col("page_start").isNull(), F.col(c)) for c in ("path_start", "path_end")})
    out = out.join(summaries(parts, group, pos), group, "left").join(headed, group, "left").join(words, group, "left")
    none = F.array().cast("array<string>")
    return out.withColumn("headings", F.coalesce("headings", none)).withColumn("keywords", F.coalesce("keywords", none)).withColumn("topics", F.slice("keywords", 1, 12))


def reduce_digests(leaves: DataFrame, key: str, group_no: str, fan_in: int = 8) -> DataFrame:
    """Merge ``fan_in`` consecutive digests until one remains per key: joined summaries (800 characters), 12 unique points,
    topics and titles, 40 keywords, page range.

    The number of rounds follows from the largest number of groups: one small aggregate, then a plan
    of that many levels.
    """
    fan_in = max(fan_in, 2)
    most = (leaves.agg(F.max(group_no)).first()[0] or 0) + 1
    now = leaves.withColumnRenamed(group_no, "g").withColumn("points", F.col("headings")).withColumnRenamed("headings", "titles")
    pages = [f(c).alias(c) for c, f in (("page_start", F.min), ("page_end", F.max)) if c in leaves.columns]
    lists = {"points": 12, "topics": 12, "titles": 12, "keywords": 40}
    columns = ["summary", "first", "last", "units", "tokens", *[c for c in ("page_start", "page_end") if c in leaves.columns], *lists]
    for _ in range(math.ceil(round(math.log(most, fan_in), 9)) if most > 1 else 0):
        parent = F.floor(F.col("g") / fan_in)
        listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("g", c))), lambda x: x[c])
        merged = now.groupBy(key, parent.alias("p")).agg(
            F.count(F.lit(1)).alias("n"), listed("summary").alias("ss"), *[F.flatten(listed(c)).alias(f"_{c}") for c in lists], *[F.first(c).alias(f"one_{c}") for c in lists],
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("units").alias("units"), F.sum("tokens").alias("tokens"), *pages,
        )
        joined = F.substring(F.array_join(F.filter(F.transform("ss", lambda s: F.trim(s)), lambda s: s != ""), " "), 1, 800)
        now = merged.withColumn("summary", joined).withColumns({c: T.unique(f"_{c}", n) for c, n in lists.items()}).select(key, F.col("p").alias("g"), *columns)
    return now.select(key, *columns)


def coverage(kind: Column, tokens: Column, deep: Column, scanned: Column, units: Column) -> Column:
    """struct(mode, ratio) by material kind."""
    out = lambda mode, ratio: F.struct(mode.alias("mode"), ratio.cast("double").alias("ratio"))
    some = F.when(units > 0, 1.0).otherwise(0.0)
    return (
        F.when(kind == "artifact", out(F.lit("artifact_metadata"), some))
        .when(kind == "project", out(F.lit("structural_sample"), F.when(scanned > 0, F.least(deep / scanned, F.lit(1.0))).otherwise(0.0)))
        .otherwise(out(F.when(tokens <= DIRECT_TOKENS, "direct").otherwise("hierarchical"), some))
    )


def inventory(files: DataFrame, material: str, path: str, text: str, *more: str) -> DataFrame:
    """Per eligible file: language, role, subsystem, first 12 imports, 8 functions and 8 classes; ``more`` columns follow."""
    s = T.suffix(path)
    symbols = F.concat(F.slice(F.regexp_extract_all(text, F.lit(T.FUNCTION), F.lit(1)), 1, 8), F.slice(F.regexp_extract_all(text, F.lit(T.CLASS), F.lit(1)), 1, 8))
    return files.filter(C.eligible(path)).select(
        material, path, C.mapped(s, LANGUAGES, F.regexp_replace(s, r"^\.", "")).alias("language"), C.role(path, text).alias("role"), C.subsystem(path).alias("subsystem"),
        F.slice(T.imports(text), 1, 12).alias("imports"), symbols.alias("symbols"), *more,
    )


def inventory_rollup(records: DataFrame, material: str, path: str, pos: str) -> DataFrame:
    """Per material of :func:`inventory` rows with their position: languages (name, files; by name), the first 24
    subsystems, 8 entry points and 30 imports."""
    counted = records.groupBy(material, "language").agg(F.count(F.lit(1)).alias("files"))
    languages = counted.groupBy(material).agg(F.array_sort(F.collect_list(F.struct("language", "files"))).alias("languages"))
    sub = ordered_unique(records.filter("subsystem is not null"), material, "subsystem", [pos], 24).withColumnRenamed("terms", "subsystems")
    deps = ordered_unique(records.select(material, pos, F.posexplode("imports").alias("i", "term")), material, "term", [pos, "i"], 30).withColumnRenamed("terms", "dependencies")
    entry = records.filter("role = 'entry'").withColumn("_n", F.row_number().over(Window.partitionBy(material).orderBy(pos))).filter("_n <= 8")
    entries = entry.groupBy(material).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", path))), lambda x: x[path]).alias("entry_points"))
    out = languages
    for part in (sub, entries, deps):
        out = out.join(part, material, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("subsystems", "entry_points", "dependencies")})


def entities(units: DataFrame, key: str, pos: str, path: str, text: str, limit: int = 24) -> DataFrame:
    """(key, place, kind, name): headings, functions, classes and exports, distinct by kind and lower-cased
    name in first-seen order."""
    found = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    script = F.lower(path).rlike(r"\.(js|ts|tsx)$")
    export = F.when(script, found("export", every(T.EXPORT))).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    all_of = F.concat(found("heading", T.headings(text)), found("function", every(T.FUNCTION)), found("class", every(T.CLASS)), export)
    rows = units.select(key, pos, F.posexplode(all_of).alias("i", "e"))
    first = rows.groupBy(key, "e.kind", F.lower("e.name").alias("low")).agg(F.min(F.struct(pos, "i", F.col("e.name").alias("name"))).alias("f"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("f", "kind")))
    return placed.filter(F.col("place") <= limit).select(key, "place", "kind", F.col("f.name").alias("name"))


def grounded(requested: DataFrame, pool: DataFrame, key: str, limit: int) -> DataFrame:
    """Requested terms that occur in the pool (any case, the pool's spelling), then the pool, up to ``limit``.

    Both sides are (key, pos, term).
    """
    spelled = pool.groupBy(key, F.lower(F.trim("term")).alias("low")).agg(F.max_by("term", "pos").alias("term"))
    picked = requested.select(key, "pos", F.lower(F.trim("term")).alias("low")).join(spelled, [key, "low"]).select(key, F.lit(0).alias("part"), "pos", "term")
    both = picked.unionByName(pool.select(key, F.lit(1).alias("part"), "pos", "term"))
    return ordered_unique(both, key, "term", ["part", "pos"], limit)


PACKAGE_NAME = r"(?m)^name\s*=\s*['\"]([^'\"]+)['\"]"


def dependencies(files: DataFrame, material: str, path: str, text: str, pos: str, limit: int = 30) -> DataFrame:
    """Dependencies of package.json, requirements.txt and go.mod files, unique per material.

    Of a file only the first ``limit`` distinct names leave its row, with their places: a name among the first of its material is among
    the first of the file that holds its first place.
    """
    name = F.lower(T.file_name(path))
    keys = lambda field: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))
    lines = F.filter(F.transform(T.lines(text), lambda v: F.trim(v)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    found = F.when(name == "package.json", F.concat(keys("dependencies"), keys("peerDependencies"))).when(name == "requirements.txt", F.transform(lines, T.requirement_name)).when(
        name == "go.mod", F.regexp_extract_all(text, F.lit(r"(?m)^\s*([a-zA-Z0-9./\-_]+)\s+v"), F.lit(1))
    )
    lists = files.select(material, F.col(pos).alias("_p"), found.alias("_w")).withColumn("_l", F.transform("_w", lambda x: F.lower(F.trim(x))))
    firsts = lists.withColumn("_d", F.slice(F.array_distinct(F.filter("_l", lambda x: x != "")), 1, limit))
    place = lambda k: F.array_position("_l", k).cast("int")
    picked = firsts.withColumn("_picked", F.transform("_d", lambda k: F.struct((place(k) - 1).alias("i"), F.element_at("_w", place(k)).alias("term"))))
    # An outer explode: before an inner one Spark filters by the list's size, for which it would compute the lists again for every name.
    rows = picked.select(material, "_p", F.inline_outer("_picked"))
    return ordered_unique(rows, material, "term", ["_p", "i"], limit)


def identity(files: DataFrame, material: str, path: str, text: str, pos: str) -> DataFrame:
    """Per project: language by the first marker in order of priority, first package name of its manifests (package.json,
    pyproject.toml, Cargo.toml, go.mod), dependencies.

    Names of TOML files are those of their first ``name = "..."`` line.
    """
    name, low = T.file_name(path), F.lower(T.file_name(path))
    rank = C.mapped(name, {m: i for i, m in enumerate(C.MARKERS)})
    package = (
        F.when(low == "package.json", F.get_json_object(text, "$.name")).when(low.isin("pyproject.toml", "cargo.toml"), F.regexp_extract(text, PACKAGE_NAME, 1))
        .when(low == "go.mod", F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1))
    )
    own = files.select(material, rank.alias("_r"), F.col(pos).alias("_p"), F.nullif(F.trim(package), F.lit("")).alias("_n"), C.mapped(name, C.MARKERS).alias("_l"))
    found = own.groupBy(material).agg(F.min_by("_l", "_r").alias("language"), F.min_by("_n", F.when(F.col("_n").isNotNull(), F.col("_p"))).alias("package"))
    deps = dependencies(files, material, path, text, pos).withColumnRenamed("terms", "dependencies")
    return found.join(deps, material, "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))


def technologies(materials: DataFrame, known: DataFrame, rollup: DataFrame, units: DataFrame, material: str, pos: str, text: str) -> DataFrame:
    """First 8 distinct of subtype, dependencies, languages and imports of the units, in this order."""
    item = lambda df, part, col: df.select(material, F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.posexplode(col).alias("i", "term"))
    some = item(materials, 0, F.array("subtype")).unionByName(item(known, 1, F.col("dependencies"))).unionByName(item(rollup, 2, F.transform("languages", lambda x: x["language"])))
    imported = units.select(material, F.lit(3).alias("part"), F.col(pos).cast("long").alias("at"), F.posexplode(F.array_distinct(T.imports(text))).alias("i", "term"))
    return ordered_unique(some.unionByName(imported).filter("term is not null"), material, "term", ["part", "at", "i"], 8).withColumnRenamed("terms", "technologies")


def titles(materials: DataFrame, known: DataFrame, units: DataFrame, material: str, pos: str, text: str) -> DataFrame:
    """(material, title): the package with its version, a unit's title, the first heading of the first four units, or the
    material's name. materials(material, name, version), units(material, pos, title, text)."""
    first = units.withColumn("_n", F.row_number().over(Window.partitionBy(material).orderBy(pos))).filter("_n <= 4")
    heading = F.get(F.filter(T.headings(text), lambda x: x != ""), F.lit(0))
    headed = first.select(material, pos, heading.alias("_h")).groupBy(material).agg(F.min_by("_h", F.when(F.col("_h").isNotNull(), F.col(pos))).alias("_heading"))
    own = F.nullif(F.trim("title"), F.lit(""))
    titled = units.groupBy(material).agg(F.min_by(own, F.when(own.isNotNull(), F.col(pos))).alias("_title"))
    j = materials.join(known.select(material, "package"), material, "left").join(titled, material, "left").join(headed, material, "left")
    package = F.when(F.trim(F.coalesce("version", F.lit(""))) != "", F.concat_ws(" ", F.col("package"), F.trim("version"))).otherwise(F.col("package"))
    return j.select(material, F.coalesce(F.when(F.col("package").isNotNull(), package), "_title", "_heading", "name").alias("title"))


def analyze(materials: DataFrame, units: DataFrame, files: DataFrame, material: str) -> DataFrame:
    """The built-in analyzer: title, summary, purpose, topics, keywords, technologies, capabilities, relevance per material.

    materials(material, name, version, material_type, subtype), units(material, pos, title, text), files(material, path,
    pos, text). Any function of these three tables and the name of the key that returns one row per material can
    take its place (``analyzed``).
    """
    leaf = leaf_digests(units, [material], "pos", "text")
    pool = material_keywords(units, material, "pos", "text").withColumnRenamed("terms", "_pool")
    records = inventory(files.withColumn("_pos", F.col("pos")), material, "path", "text", "_pos")
    rollup, known = inventory_rollup(records, material, "path", "_pos"), identity(files, material, "path", "text", "pos")
    j = materials
    for part in (
        leaf.select(material, "summary", F.col("topics").alias("_topics"), "units"), pool, rollup.select(material, "entry_points"),
        technologies(materials, known, rollup, units, material, "pos", "text"), titles(materials, known, units, material, "pos", "text"),
    ):
        j = j.join(part, material, "left")
    none = F.array().cast("array<string>")
    words = F.coalesce("_pool", none)
    fallback = F.concat(F.coalesce("units", F.lit(0)).cast("string"), F.lit(" "), F.coalesce("material_type", F.lit("unknown")), F.when(F.col("units") == 1, " unit").otherwise(" units"))
    return j.select(
        material, "title", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), fallback).alias("summary"), C.mapped(F.col("material_type"), PURPOSE).alias("purpose"),
        T.unique(F.concat(F.coalesce("_topics", none), F.slice(words, 1, 8)), 12).alias("topics"), F.slice(words, 1, 25).alias("keywords"), F.coalesce("technologies", none).alias("technologies"),
        T.unique(F.coalesce("entry_points", none), 12).alias("capabilities"), C.mapped(F.col("material_type"), RELEVANCE, F.lit(0.4)).alias("relevance"),
    )


def analyzed(materials: DataFrame, units: DataFrame, files: DataFrame, material: str, analyzer: Callable[[DataFrame, DataFrame, DataFrame, str], DataFrame] = analyze) -> DataFrame:
    """Analyzer hook: its rows, relevance brought into 0 to 1; materials it left out get an empty analysis."""
    found = analyzer(materials, units, files, material)
    return materials.select(material).join(found, material, "left").withColumn("relevance", T.clamp_relevance(F.col("relevance").cast("string"), 0.4))


def csv_profile(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Data rows and the first 40 non-blank column names of CSV and TSV files."""
    own = T.lines(text)
    header = F.coalesce(F.get(own, F.lit(0)), F.lit(""))
    columns = F.filter(F.transform(F.when(T.suffix(path) == ".tsv", F.split(header, "\t")).otherwise(F.split(header, ",")), lambda v: F.trim(v)), lambda x: x != "")
    return files.select(key, F.greatest(F.size(own) - 1, F.lit(0)).alias("rows"), F.slice(columns, 1, 40).alias("columns"))
