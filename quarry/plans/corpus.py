"""Queries over a file listing derived from ``documents`` by arithmetic on doc_id.

Material of a document: ``doc_id div 10``; its file name comes from the row of ``NAMES`` for the material's
kind (material mod 5) at doc_id mod 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import corpus as C
from quarry.plans.common import lines_sql, query, quoted
from quarry.session import table

NAMES = [
    "pyproject.toml", "src/main.py", "src/api_routes.py", "docs/guide.md", "lib/core/engine.go", "tests/test_main.py", "src/io/reader.py", "README.md", "package-lock.json", "src/handler.py",
    "data/a.csv", "data/b.csv", "data/2024/c.tsv", "data/2024/d.csv", "data/e.csv", "data/f.csv", "data/g.csv", "data/h.csv", "data/i.csv", "data/j.csv",
    "one.txt", "two.md", "three.rst", "four.txt", "five.txt", "six.md", "seven.txt", "eight.txt", "nine.txt", "ten.txt",
    "a.py", "b.js", "c.go", "cmd/d.go", "e.rs", "core/f.py", "g.ts", "h.java", "i.kt", "j.py",
    "x.whl", "x.tar.gz", "x.docx", ".git/config", "x.jar", "notes", "x.7z", "x.exe", "Cargo.toml", "x.zip",
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """material_id, kind, path (inside the material), full path, pos, text."""
    m = F.expr("doc_id div 10")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (m % 5 * 10 + F.col("doc_id") % 10 + 1).cast("int"))
    d = table(spark, sf_dir, "documents")
    return d.select(m.alias("material_id"), (m % 5).alias("kind"), name.alias("path"), F.concat(F.lit("drop/m"), m.cast("string"), F.lit("/"), name).alias("full_path"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))


FILES = f"""f AS (
  SELECT doc_id // 10 AS material_id, (doc_id // 10) % 5 AS kind, [{quoted(NAMES)}][(doc_id // 10) % 5 * 10 + doc_id % 10 + 1] AS path,
         'drop/m' || (doc_id // 10) || '/' || [{quoted(NAMES)}][(doc_id // 10) % 5 * 10 + doc_id % 10 + 1] AS full_path, doc_id AS pos, coalesce(text, '') AS text
  FROM documents)"""
NAME = "regexp_extract(path, '[^/]+$')"
SUFFIX = f"regexp_extract(lower({NAME}), '^.+(\\.[^.]+)$', 1)"


def case_sql(key: str, table_: dict[str, object]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


COMPOUND_SQL = " ".join(f"WHEN lower({NAME}) LIKE '%{s}' THEN '{f}'" for s, f in C.COMPOUND.items())
FORMAT_SQL = f"""t AS (SELECT *, {NAME} AS name, {SUFFIX} AS sfx FROM f),
fmt AS (
  SELECT *, coalesce(CASE {COMPOUND_SQL} END, {case_sql('sfx', {s: f for s, (_, f) in C.SUFFIXES.items()})}) AS format,
         CASE WHEN (CASE {COMPOUND_SQL} END) IS NOT NULL THEN 'expand' ELSE {case_sql('sfx', {s: a for s, (a, _) in C.SUFFIXES.items()})} END AS action FROM t)"""
HINT_CASE = " ".join(f"WHEN format IN ({quoted(h)}) THEN '{t}'" for t, h in C.HINT_TYPES.items())


# First bytes of files in hex; ``ustar`` stands at offset 257.
HEADS = {"00" * 257 + "7573746172": "tar", "377ABCAF271C0000": "7z", "1F8B0800": "gzip", "504B0304": "zip", "7F454C4602": "elf", "4D5A9000": "pe", "D0CF11E0A1B1": "ole", "CAFEBABE00": "macho", "68656C6C6F": "none"}


def _content(number: str, text: str):
    """Header bytes in front of a text's bytes."""
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col(number) % len(HEADS) + 1).cast("int"))
    return F.concat(F.unhex(head), F.coalesce(text, F.lit("")).cast("binary"))


SNIFFED = f"[{quoted(HEADS.values())}][{{}} % {len(HEADS)} + 1]"


@query(f"SELECT doc_id, {SNIFFED.format('doc_id')} AS sniffed FROM documents")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2."""
    d = table(spark, sf_dir, "documents").select("doc_id", _content("doc_id", "text").alias("content"))
    return d.select("doc_id", F.coalesce(C.sniff("content"), F.lit("none")).alias("sniffed"))


@query(f"""WITH {FILES}, {FORMAT_SQL}, s AS (SELECT *, {SNIFFED.format('pos')} AS sniffed FROM fmt WHERE NOT regexp_matches('/' || path, '/\\.')),
d AS (SELECT pos, path, CASE WHEN action IS NOT NULL THEN action WHEN sniffed IN ('7z', 'gzip', 'zip', 'tar') THEN 'expand' ELSE 'file' END AS action,
 CASE WHEN format IS NOT NULL THEN format WHEN sniffed IN ('7z', 'gzip', 'zip', 'tar') THEN sniffed WHEN sniffed IN ('elf', 'pe', 'macho') THEN 'binary' WHEN sniffed = 'ole' THEN 'installer' ELSE 'file' END AS format FROM s)
SELECT *, CASE {HINT_CASE} END AS type FROM d""")
def format_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 skip rule, PRJ1, PRJ3, PRJ4: by suffix, else by first bytes."""
    f = _files(spark, sf_dir).filter(C.visible("path")).withColumn("d", C.decide("path", C.sniff(_content("pos", "text"))))
    return f.select("pos", "path", "d.action", "d.format", C.hint_type("d.format")["type"].alias("type"))


ELIGIBLE = f"""(NOT list_has_any(string_split(path, '/'), [{quoted(C.PROJECT_SKIP)}]) AND {NAME} NOT IN ({quoted(C.LOCKFILES)})
 AND NOT starts_with({NAME}, 'test_') AND ({NAME} IN ('go.mod', 'Pipfile') OR {SUFFIX} IN ({quoted(C.PROJECT_SUFFIXES)})))"""
STEM = f"lower(regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1'))"
ROLE = f"""CASE WHEN lower({NAME}) IN ({quoted(C.IDENTITY)}) THEN 'identity' WHEN lower({NAME}) IN ({quoted(C.CONFIG)}) THEN 'config'
 WHEN lower({NAME}) IN ({quoted(C.ENTRY)}) OR starts_with(path, 'cmd/') THEN 'entry'
 WHEN {STEM} IN ({quoted(C.API_STEMS)}) OR starts_with({STEM}, 'api_') OR starts_with({STEM}, 'routes') THEN 'api'
 WHEN contains(text, 'handle_request') OR contains(text, 'HandleRequest') THEN 'api'
 WHEN {STEM} IN ({quoted(C.CORE_NAMES)}) OR list_has_any(string_split(lower(path), '/')[:-2], [{quoted(C.CORE_NAMES)}]) THEN 'core' ELSE 'subsystem' END"""
SUB = "CASE WHEN len(string_split(path, '/')) >= 2 AND string_split(path, '/')[1] IN ('src', 'lib', 'pkg') THEN string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"


@query(f"WITH {FILES} SELECT pos, path FROM f WHERE {ELIGIBLE}")
def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6."""
    return _files(spark, sf_dir).filter(C.eligible("path")).select("pos", "path")


@query(f"WITH {FILES} SELECT pos, path, {ROLE} AS role, {SUB} AS subsystem FROM f")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ7, PRJ8."""
    return _files(spark, sf_dir).select("pos", "path", C.role("path", "text").alias("role"), C.subsystem("path").alias("subsystem"))


DEEP = f"""WITH {FILES},
e AS (SELECT material_id, path, pos, {ROLE} AS role, {SUB} AS sub FROM f WHERE {ELIGIBLE}),
r AS (SELECT *, {case_sql('role', C.ROLE_RANK)}::INT AS rk, coalesce({case_sql('role', C.ROLE_BUDGET)}::INT, 0) AS budget,
        count(*) OVER (PARTITION BY material_id, role) AS n, row_number() OVER (PARTITION BY material_id, role, sub ORDER BY pos) AS rnd,
        min(pos) OVER (PARTITION BY material_id, role, sub) AS seen FROM e),
w AS (SELECT material_id, rk, least(any_value(budget), any_value(n)) AS want FROM r GROUP BY ALL),
k AS (SELECT material_id, rk, greatest(least(want, 5 - coalesce(sum(want) OVER (PARTITION BY material_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM w),
p AS (SELECT r.*, take, CASE WHEN take >= n THEN row_number() OVER (PARTITION BY r.material_id, role ORDER BY pos)
        ELSE row_number() OVER (PARTITION BY r.material_id, role ORDER BY rnd, seen, pos) END AS place FROM r JOIN k USING (material_id, rk)),
o AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY (place > take)::INT, rk, CASE WHEN place <= take THEN place ELSE pos END, pos) AS pick FROM p)
SELECT material_id, path, role, pick FROM o WHERE pick <= 5"""


@query(DEEP)
def deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5 with a cap of 5."""
    return C.deep_files(_files(spark, sf_dir), "material_id", "path", "text", "pos", 5)


@query(f"""WITH {FILES}, p AS (SELECT *, CASE WHEN NOT contains(path, '/') AND lower(path) IN ({quoted(C.IDENTITY)}) THEN 0 WHEN starts_with(path, 'src/') THEN 1
 WHEN starts_with(path, 'tests/') THEN 2 WHEN starts_with(path, 'examples/') THEN 3 ELSE 4 END AS priority FROM f)
SELECT material_id, path, pick FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY priority, pos) AS pick FROM p) WHERE pick <= 4""")
def member_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6."""
    return C.sample_members(_files(spark, sf_dir), "material_id", "path", "pos", 4).select("material_id", "path", "pick")


RANKS = {m: i for i, m in enumerate(C.MARKERS)}
# Kind 4 is split so that each file is a material of its own: id material_id * 100 + place.
ONE = "CASE WHEN kind = 4 THEN material_id * 100 + pos % 10 ELSE material_id END"


@query(f"""WITH {FILES}, g AS (SELECT *, {ONE} AS mid, {SUFFIX} AS sfx, CASE WHEN NOT contains(path, '/') AND path IN ({quoted(C.MARKERS)}) THEN path END AS mk FROM f),
a AS (SELECT mid, kind, arg_min(mk, {case_sql('mk', RANKS)}::INT) AS marker, bool_and(sfx IN ({quoted(C.CSV)})) AS csv, bool_and(sfx IN ({quoted(C.PDF)})) AS pdf,
  bool_and(sfx IN ({quoted(C.TEXT)})) AS txt, bool_or(sfx = '.md') AS md, bool_and(sfx IN ({quoted(C.CODE)})) AS code, count(*) AS n, min(path) AS path, arg_min(sfx, path) AS s1 FROM g GROUP BY mid, kind),
b AS (SELECT *, coalesce(CASE {COMPOUND_SQL} END, {case_sql(SUFFIX, {s: f for s, (_, f) in C.SUFFIXES.items()})}) AS format,
  (CASE {COMPOUND_SQL} END) IS NOT NULL OR {SUFFIX} IN ({quoted(C.EXPAND)}) AS expands FROM a)
SELECT mid AS material_id, n,
 CASE WHEN marker IS NOT NULL THEN 'project' WHEN csv THEN 'dataset' WHEN pdf OR txt THEN 'document' WHEN code THEN 'code' WHEN n = 1 AND NOT expands AND format IS NOT NULL THEN CASE {HINT_CASE} END ELSE 'unknown' END AS type,
 CASE WHEN marker IS NOT NULL THEN {case_sql('marker', C.MARKERS)} WHEN csv THEN 'csv' WHEN pdf THEN 'pdf' WHEN txt THEN CASE WHEN md THEN 'markdown' ELSE 'text' END WHEN code THEN substr(s1, 2) WHEN n = 1 AND NOT expands AND format IS NOT NULL THEN format END AS subtype,
 CASE WHEN marker IS NOT NULL THEN 0.98 WHEN csv THEN 0.9 WHEN pdf THEN 0.95 WHEN txt THEN 0.9 WHEN code THEN 0.85 WHEN n = 1 AND NOT expands AND format IS NOT NULL THEN 0.9 ELSE 0.0 END AS confidence FROM b""")
def material_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1."""
    one = F.when(F.col("kind") == 4, F.col("material_id") * 100 + F.col("pos") % 10).otherwise(F.col("material_id"))
    # A split material's number may be that of a whole one too, so the kind belongs to the key.
    own = _files(spark, sf_dir).withColumn("key", F.struct(one.alias("material_id"), "kind"))
    return C.classify(own, "key", "path").select("key.material_id", "type", "subtype", "confidence", "n")


DIR_SQL = f"""{FILES}, a AS (
  SELECT full_path, path, kind, unnest(range(1, len(string_split(full_path, '/')))) AS depth, string_split(full_path, '/') AS parts FROM f),
d AS (SELECT *, array_to_string(parts[:depth], '/') || '/' AS dir FROM a),
proj AS (
  SELECT regexp_replace(full_path, '[^/]+$', '') AS dir, arg_min({case_sql(NAME, C.MARKERS)}, {case_sql(NAME, RANKS)}::INT) AS subtype,
         string_agg(DISTINCT {NAME}, ',') AS markers FROM f WHERE {NAME} IN ({quoted(C.MARKERS)}) GROUP BY 1),
tree AS (
  SELECT dir, count(*) FILTER (WHERE {SUFFIX} IN ({quoted(C.CSV)})) AS csv_files, bool_or({NAME} IN ({quoted(C.MARKERS)})) AS marker,
         bool_or(len(parts) > depth + 1) AS folders, bool_and({SUFFIX} IN ({quoted(C.CSV)})) AS only_csv, any_value(parts[depth]) AS last
  FROM d WHERE NOT regexp_matches('/' || full_path, '/\\.') GROUP BY dir),
data AS (SELECT dir, csv_files, CASE WHEN last IN ('data', 'dataset', 'datasets') THEN 0.9 ELSE 0.85 END AS confidence FROM tree
  WHERE csv_files > 0 AND NOT marker AND (last IN ('data', 'dataset', 'datasets') OR (NOT folders AND only_csv))),
bound AS (SELECT dir, coalesce(subtype || '_project', CASE WHEN csv_files IS NOT NULL THEN 'csv_dataset' END) AS hint FROM proj FULL JOIN data USING (dir))"""


@query(f"WITH {DIR_SQL} SELECT dir, subtype, markers FROM proj")
def project_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2."""
    return C.project_dirs(_files(spark, sf_dir), "full_path")


@query(f"WITH {DIR_SQL} SELECT * FROM data")
def dataset_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3."""
    return C.dataset_dirs(_files(spark, sf_dir), "full_path")


@query(f"""WITH {DIR_SQL}, top AS (SELECT full_path, arg_min(bound.dir, depth) AS dir, arg_min(hint, depth) AS hint FROM d JOIN bound USING (dir) GROUP BY full_path)
SELECT f.pos, f.full_path, coalesce(top.dir, f.full_path) AS root, top.hint FROM f LEFT JOIN top USING (full_path)""")
def material_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4, JN7: the topmost boundary above each file."""
    return C.assign(_files(spark, sf_dir), "full_path").select("pos", "full_path", "root", "hint")


@query(f"WITH {FILES}, {FORMAT_SQL} SELECT pos, CASE WHEN contains(full_path, '/docs/') THEN 'docs_tree' ELSE coalesce(CASE {HINT_CASE} END, 'plain') END AS decision FROM fmt")
def custom_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF4: an ordered list of column expressions as boundary rules; the first that decides wins."""
    rules = [F.when(F.col("full_path").contains("/docs/"), "docs_tree"), C.hint_type(C.suffix_format("full_path")["format"])["type"], F.lit("plain")]
    return _files(spark, sf_dir).select("pos", F.coalesce(*rules).alias("decision"))


@query(f"WITH {FILES} SELECT material_id, sha256(string_agg(path || chr(0) || sha256(text) || chr(10), '' ORDER BY path)) AS digest, count(*) AS files FROM f GROUP BY material_id")
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5, SNK2."""
    return C.tree_digest(_files(spark, sf_dir).withColumn("sha", F.sha2("text", 256)), "material_id", "path", "sha")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as an archive member; every seventh name climbs, every eleventh is absolute."""
    f = _files(spark, sf_dir)
    name = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("../"), F.col("path"))).when(F.col("pos") % 11 == 0, F.concat(F.lit("/"), F.col("path"))).otherwise(F.col("path"))
    return f.select(F.col("material_id").alias("archive"), name.alias("name"), (F.length("text") * 1000).cast("long").alias("size"), (F.col("pos") % 300 * 40).cast("long").alias("compressed"), (F.col("pos") % 13 == 0).alias("is_symlink"), (F.col("pos") % 17 == 0).alias("is_encrypted"), "pos")


@query(f"""WITH {FILES}, m AS (SELECT material_id AS archive, CASE WHEN pos % 7 = 0 THEN '../' || path WHEN pos % 11 = 0 THEN '/' || path ELSE path END AS name,
  length(text) * 1000 AS size, pos % 300 * 40 AS compressed, pos FROM f)
SELECT archive, name, array_to_string(list_filter([CASE WHEN starts_with(name, '/') THEN 'absolute' END, CASE WHEN list_contains(string_split(name, '/'), '..') THEN 'traversal' END,
  CASE WHEN pos % 17 = 0 THEN 'encrypted' END, CASE WHEN pos % 13 = 0 THEN 'symlink' END, CASE WHEN size > 20000000 THEN 'member_size' END,
  CASE WHEN compressed > 0 AND size / compressed > 200 THEN 'ratio' END], lambda x: x IS NOT NULL), ',') AS codes,
  count(*) OVER (PARTITION BY archive) > 9 AS too_many, sum(size) OVER (PARTITION BY archive) > 30000000 AS too_large FROM m""")
def member_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5, FN14 on member listings."""
    found = C.audit_members(_members(spark, sf_dir), max_member=20_000_000, max_ratio=200.0, max_files=9, max_total=30_000_000)
    return found.select("archive", "name", F.array_join("codes", ",").alias("codes"), "too_many", "too_large")


@query(f"""WITH {FILES}, m AS (SELECT material_id AS archive, pos, CASE pos % 6 WHEN 1 THEN path || '.class' WHEN 4 THEN 'META-INF/' || path || '.class' WHEN 5 THEN 'pkg-1.' || (pos % 2) || CASE WHEN pos % 4 = 1 THEN '.data/' ELSE '.dist-info/' END || path ELSE path END AS name FROM f),
t AS (SELECT archive, pos, 'm' AS kind, CASE WHEN NOT regexp_matches(string_split(name, '/')[1], '[.](dist-info|data)$') THEN nullif(string_split(name, '/')[1], '') END AS term FROM m
  UNION ALL SELECT archive, pos, 'p', replace(regexp_replace(name, '/[^/]*$', ''), '/', '.') FROM m WHERE name LIKE '%.class' AND NOT starts_with(name, 'META-INF/')),
r AS (SELECT archive, kind, term, row_number() OVER (PARTITION BY archive, kind ORDER BY min(pos), term) AS n FROM t WHERE term IS NOT NULL GROUP BY archive, kind, term),
l AS (SELECT archive, string_agg(term, ',' ORDER BY n) FILTER (WHERE kind = 'm') AS modules, string_agg(term, ',' ORDER BY n) FILTER (WHERE kind = 'p') AS packages FROM r WHERE n <= 20 GROUP BY archive)
SELECT archive, coalesce(modules, '') AS modules, coalesce(packages, '') AS packages, count(*) FILTER (WHERE name LIKE '%.py') AS py, count(*) FILTER (WHERE name LIKE '%.class') AS classes FROM m LEFT JOIN l USING (archive) GROUP BY ALL""")
def package_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24: archives with modules, classes and package records, of the files of each material."""
    pos, path = F.col("pos"), F.col("path")
    record = F.concat(F.lit("pkg-1."), (pos % 2).cast("string"), F.when(pos % 4 == 1, ".data/").otherwise(".dist-info/"), path)
    name = F.when(pos % 6 == 1, F.concat(path, F.lit(".class"))).when(pos % 6 == 4, F.concat(F.lit("META-INF/"), path, F.lit(".class"))).when(pos % 6 == 5, record).otherwise(path)
    return C.package_contents(_files(spark, sf_dir).select(F.col("material_id").alias("archive"), name.alias("name"), "pos"))


@query(f"""WITH {FILES}, n AS (SELECT * FROM f WHERE pos % 3 <> 0 OR text = '')
SELECT material_id, path, n FROM (SELECT material_id, path, row_number() OVER (PARTITION BY material_id ORDER BY path) AS n FROM n) WHERE n <= 30""")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: files without a unit; units come from every third non-empty file."""
    f = _files(spark, sf_dir)
    return C.skipped_files(f, f.filter("pos % 3 = 0 and text <> ''"), "material_id", "path").select("material_id", "path", "n")


@query(f"WITH {FILES} SELECT pos, kind, CASE WHEN pos % 4 = 0 THEN 'M' ELSE 'C' END || row_number() OVER (PARTITION BY kind, pos % 4 = 0 ORDER BY pos) AS label FROM f")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN21."""
    return C.label_nodes(_files(spark, sf_dir).withColumn("m", F.col("pos") % 4 == 0), "kind", "m", "pos").select("pos", "kind", "label")


# Every document deep inside folders and archives in turn: part i is an archive for odd i.
CHAIN = "list_transform(range(1, doc_id % 13 + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'a' || i || '.zip' ELSE 'd' || i END)"


@query(f"""WITH c AS (SELECT doc_id, {CHAIN} AS c, doc_id % 13 AS n FROM documents)
SELECT doc_id, array_to_string(list_append(c, 'f' || doc_id), '/') || CASE WHEN doc_id % 5 = 0 THEN '/' ELSE '' END AS logical_path, n AS depth,
 array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: i % 2 = 1), lambda i: array_to_string(c[:i], '/')), ' > ') AS origin, (n + 1) // 2 > 5 AS rejected FROM c""")
def logical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15: logical path, depth, chain of archives, rejection beyond five."""
    n = (F.col("doc_id") % 13).cast("int")
    chain = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.when(i % 2 == 1, F.concat(F.lit("a"), i.cast("string"), F.lit(".zip"))).otherwise(F.concat(F.lit("d"), i.cast("string"))))
    path = F.array_join(F.concat(chain, F.array(F.concat(F.lit("f"), F.col("doc_id").cast("string")))), "/")
    nodes = C.nested_nodes(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), (F.col("doc_id") % 5 == 0).alias("is_dir")), "path", "is_dir")
    return nodes.select("doc_id", "logical_path", "depth", F.array_join("origin", " > ").alias("origin"), "rejected")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Package ' || lang WHEN doc_id % 3 = 1 THEN lang ELSE 'd' || doc_id END AS name,
 array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'artifact_title= Package ' || lang END, CASE WHEN doc_id % 2 = 0 THEN 'format=' || source END, 'material_hint=' || CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE lang || '_project' END,
  'origin_chain=' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a.zip' ELSE 'a.zip > a.zip/b.tar' END, CASE WHEN doc_id % 3 = 0 THEN 'package=' || lang END, CASE WHEN doc_id % 9 = 0 THEN 'version=1.' || (doc_id % 7) END], lambda x: x IS NOT NULL), ';') AS metadata FROM documents""")
def material_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14: title of the package, else the last part of the path, with the metadata that is carried along."""
    d, nothing = F.col("doc_id"), F.lit(None).cast("string")
    path = F.when(d % 3 == 1, F.concat_ws("/", "source", F.concat("lang", F.lit("/")))).otherwise(F.concat(F.lit("x/d"), d.cast("string")))
    title = F.when(d % 3 == 0, F.concat(F.lit(" Package "), "lang")).otherwise(F.when(d % 3 == 1, " "))
    chain = F.slice(F.array(F.lit("a.zip"), F.lit("a.zip/b.tar")), F.lit(1), (d % 3).cast("int"))
    known = C.material_metadata(
        F.when(d % 5 != 0, F.concat("lang", F.lit("_project"))), chain, format=F.when(d % 2 == 0, F.col("source")).otherwise(""), package=F.when(d % 3 == 0, F.col("lang")),
        version=F.when(d % 9 == 0, F.concat(F.lit("1."), (d % 7).cast("string"))).otherwise(nothing), artifact_title=F.when(d % 3 == 0, title),
    )
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(known)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("none")))), ";")
    return table(spark, sf_dir, "documents").select("doc_id", C.material_name(path, title).alias("name"), shown.alias("metadata"))


TYPED = "(CASE lang WHEN 'en' THEN 'document' WHEN 'de' THEN 'project' WHEN 'fr' THEN 'dataset' ELSE 'code' END)"


@query(f"""WITH g AS (SELECT source, lang, count(*) AS units, count(DISTINCT doc_id % 7) AS files, {TYPED} AS type, CASE WHEN source LIKE '%1' THEN NULL WHEN lang = 'en' THEN 'pdf' ELSE 'python' END AS subtype FROM documents GROUP BY source, lang)
SELECT source, lang, units, files, CASE WHEN type = 'document' AND subtype = 'pdf' THEN units || CASE WHEN units = 1 THEN ' page PDF' ELSE ' pages PDF' END
 WHEN type = 'project' THEN coalesce(subtype, 'software') || ' project, ' || files || CASE WHEN files = 1 THEN ' citable file' ELSE ' citable files' END
 WHEN type = 'dataset' THEN 'CSV dataset, ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END ELSE units || CASE WHEN units = 1 THEN ' content unit' ELSE ' content units' END END AS description FROM g""")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23: description by type."""
    kind = F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "project").when(F.col("lang") == "fr", "dataset").otherwise("code")
    subtype = F.when(F.col("source").endswith("1"), F.lit(None).cast("string")).when(F.col("lang") == "en", "pdf").otherwise("python")
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("units"), F.count_distinct(F.col("doc_id") % 7).alias("files"))
    return g.withColumn("description", C.describe(kind, subtype, "units", "files"))


@query(f"WITH {FILES} SELECT material_id, path, row_number() OVER (PARTITION BY material_id ORDER BY lower(path), path) AS place FROM f")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP3: case-insensitive order of names inside each folder."""
    return C.ordered_listing(_files(spark, sf_dir).select("material_id", "path"), "material_id", "path")


@query(f"""WITH {FILES}, {FORMAT_SQL}, h AS (SELECT *, CASE {HINT_CASE} END AS hint FROM fmt),
x AS (SELECT *, CASE kind WHEN 0 THEN 'project' WHEN 1 THEN 'table' WHEN 2 THEN 'text' WHEN 3 THEN 'text' ELSE
  CASE WHEN format IN ({quoted(C.ARTIFACTS)}) AND hint IS NOT NULL THEN 'artifact' WHEN format IN ({quoted(C.BINARIES)}) AND hint IS NOT NULL THEN 'binary' WHEN sfx IN ('.docx', '.docm') THEN 'sections' WHEN sfx IN ('.csv', '.tsv') THEN 'table' ELSE 'text' END END AS shape,
  {lines_sql('text')} AS ls FROM h),
y AS (SELECT *, CASE shape WHEN 'artifact' THEN format WHEN 'binary' THEN 'Binary or installer (' || format || ')' WHEN 'table' THEN array_to_string(list_filter(list_transform(string_split(coalesce(ls[1], ''), CASE WHEN sfx = '.tsv' THEN chr(9) ELSE ',' END), lambda v: trim(v)), lambda v: v <> ''), ', ') ELSE text END AS content FROM x
  WHERE shape <> 'sections' AND (shape <> 'project' OR {ELIGIBLE}))
SELECT pos, path, shape, shape AS unit_type, sha256(content) AS digest, CASE WHEN shape IN ('project', 'text') THEN 1 END AS line_start, CASE WHEN shape IN ('project', 'text') THEN greatest(len(ls), 1) END AS line_end FROM y""")
def extraction_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ16: one CASE decides each file's shape; its units."""
    hint = C.hint_type("fmt")
    pick = lambda a, b: F.element_at(F.array(*[F.lit(x) for x in a]), (F.col("kind") + 1).cast("int")) if b is None else F.when(F.col("kind") == 4, b).otherwise(pick(a, None))
    files = _files(spark, sf_dir).withColumn("fmt", C.suffix_format("path")["format"])
    typed = files.withColumn("type", pick(["project", "dataset", "document", "code", None], hint["type"])).withColumn("subtype", pick(["python", "csv", "text", "py", None], hint["subtype"]))
    units = C.extract_units(typed, "pos", "path", "text")
    return units.select("pos", "path", "shape", "unit_type", F.sha2("content", 256).alias("digest"), "line_start", "line_end")


@query("""WITH m AS (SELECT DISTINCT source || CASE lang WHEN 'es' THEN '/node_modules/x/' WHEN 'fr' THEN '/tests/' ELSE '/' || lang || '/' END AS root_path, CASE lang WHEN 'en' THEN 'document' WHEN 'de' THEN 'project' END AS type FROM documents),
e AS (SELECT DISTINCT 'src' || (doc_id % 40) || '/en/' AS path, CASE WHEN doc_id % 40 % 2 = 0 THEN 'document' ELSE 'dataset' END AS type FROM documents
  UNION ALL SELECT DISTINCT lang, NULL FROM documents UNION ALL SELECT DISTINCT substr(lang, 2) || '/', NULL FROM documents UNION ALL SELECT DISTINCT lang || 'x', NULL FROM documents UNION ALL SELECT DISTINCT 'packages/' || lang || '.whl', NULL FROM documents)
SELECT 'wheel' AS rule, 'packages/' AS key, '' AS detail WHERE NOT EXISTS (SELECT 1 FROM m WHERE root_path LIKE 'packages/%.whl')
UNION ALL SELECT 'missing', path, '' FROM e WHERE path NOT LIKE '%.whl' AND NOT EXISTS (SELECT 1 FROM m WHERE (ends_with(e.path, '/') AND starts_with(root_path, e.path)) OR list_contains(string_split(root_path, '/'), rtrim(e.path, '/')) OR ends_with(root_path, e.path))
UNION ALL SELECT 'type', root_path, coalesce(m.type, 'none') || ' expected ' || e.type FROM m JOIN e ON root_path = path WHERE e.type IS NOT NULL AND m.type IS DISTINCT FROM e.type
UNION ALL SELECT 'vendor', root_path, '' FROM m WHERE list_has_any(string_split(root_path, '/'), ['node_modules', '.venv', 'venv'])
UNION ALL SELECT 'tests', root_path, '' FROM m WHERE ends_with(rtrim(root_path, '/'), '/tests')""")
def discovery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: missing roots and wheels, wrong types, vendor and test trees."""
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("lang") == "es", "/node_modules/x/").when(F.col("lang") == "fr", "/tests/").otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))
    m = d.select(F.concat("source", folder).alias("root_path"), F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "project").alias("material_type")).distinct()
    k, none = F.col("doc_id") % 40, F.lit(None).cast("string")
    e = d.select(F.concat(F.lit("src"), k.cast("string"), F.lit("/en/")).alias("path"), F.when(k % 2 == 0, "document").otherwise("dataset").alias("material_type")).distinct()
    for path in (F.col("lang"), F.concat(F.expr("substr(lang, 2)"), F.lit("/")), F.concat("lang", F.lit("x")), F.concat(F.lit("packages/"), "lang", F.lit(".whl"))):
        e = e.union(d.select(path, none).distinct())
    return C.discovery_errors(m, e)
