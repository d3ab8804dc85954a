"""Queries that profile materials. Material: ``source/lang``; unit: document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import profile as P
from quarry.operators.numbering import numbered
from quarry.plans import corpus as corpus_plans
from quarry.plans.common import keywords_sql, lines_sql, query, tokens_sql
from quarry.session import scratch_dir, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("material_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


UNIT = "u AS (SELECT source || '/' || lang AS material_id, doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"
KEYWORDS = f"""{UNIT}, kw AS (SELECT material_id, doc_id, {keywords_sql('text')} AS w FROM u),
k0 AS (SELECT material_id, doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM kw),
k1 AS (SELECT material_id, doc_id, lower(term) AS low, min((i, term)) AS f FROM k0 GROUP BY ALL),
t AS (SELECT material_id, doc_id, low, f[2] AS term, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS i FROM k1),
g AS (SELECT material_id, low, min((doc_id, i, term)) AS f FROM t WHERE i <= 40 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS place FROM g)"""


@query(f"WITH {KEYWORDS} SELECT material_id, string_agg(f[3], '|' ORDER BY place) AS terms FROM r WHERE place <= 80 GROUP BY material_id")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6, AGG7."""
    return P.material_keywords(_units(spark, sf_dir), "material_id", "doc_id", "text").select("material_id", F.array_join("terms", "|").alias("terms"))


@query(f"WITH {UNIT} SELECT material_id, arg_min(trim(substr(text, 1, 20)), doc_id) FILTER (WHERE trim(substr(text, 1, 20)) <> '' AND doc_id % 3 = 1) AS title, arg_min(lang, doc_id) AS language FROM u GROUP BY material_id")
def metadata_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: first non-blank value per key; two thirds of the units have no title."""
    u = _units(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 20))).withColumn("language", F.col("lang"))
    return P.lift(u, "material_id", "doc_id", ["title", "language"])


# Documents as files with headings, definitions and imports: every line becomes one of these, named after its first word.
def _code(text: str = "text") -> Column:
    word = lambda x: F.regexp_replace(F.regexp_extract(x, "[A-Za-z]+", 0), "^$", "x")
    line = lambda x, i: F.concat(F.when(i % 4 == 0, "# ").when(i % 4 == 1, "def ").when(i % 4 == 2, "import ").otherwise("class "), word(x), F.when(i % 4 == 0, " x").otherwise(""))
    return F.array_join(F.transform(T.lines(text), line), "\n")


WORD_SQL = "(CASE WHEN regexp_extract(x, '[A-Za-z]+') = '' THEN 'x' ELSE regexp_extract(x, '[A-Za-z]+') END)"
CODE = f"array_to_string(list_transform({lines_sql('text')}, lambda x, i: CASE i % 4 WHEN 1 THEN '# ' || {WORD_SQL} || ' x' WHEN 2 THEN 'def ' || {WORD_SQL} WHEN 3 THEN 'import ' || {WORD_SQL} ELSE 'class ' || {WORD_SQL} END), chr(10))"
SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
DIGEST = f"""n AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY doc_id) AS n FROM u),
h AS (SELECT material_id, coalesce(string_agg(CASE WHEN n <= 2 AND regexp_matches(text, '\\S') THEN text END, chr(10) ORDER BY n), string_agg(CASE WHEN regexp_matches(text, '\\S') THEN text END, chr(10) ORDER BY n), '') AS s, min(doc_id) AS first, max(doc_id) AS last, count(*) AS units, sum(len({tokens_sql('text')}))::BIGINT AS tokens FROM n GROUP BY material_id)"""
SUMMARY = f"substr(array_to_string(({SENT})[:2], ' '), 1, 400)"
HEADINGS = "list_filter(list_transform(regexp_extract_all(text, '(?m)^#{1,6}\\s+(.+)$', 1), lambda x: trim(x)), lambda x: x <> '')"


def leaf_sql(units: str, key: str) -> str:
    """CTEs up to ``leaf``: digests of the groups ``key`` of ``units(key, doc_id, text)``."""
    return f"""ln AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS n FROM {units}),
lh AS (SELECT {key}, coalesce(string_agg(CASE WHEN n <= 2 AND regexp_matches(text, '\\S') THEN text END, chr(10) ORDER BY n), string_agg(CASE WHEN regexp_matches(text, '\\S') THEN text END, chr(10) ORDER BY n), '') AS s, min(doc_id) AS first, max(doc_id) AS last, count(*) AS units, sum(len({tokens_sql('text')}))::BIGINT AS tokens FROM ln GROUP BY {key}),
le AS (SELECT {key}, doc_id, 0 AS part, unnest({HEADINGS}) AS term, generate_subscripts({HEADINGS}, 1) AS i FROM {units}
  UNION ALL SELECT {key}, doc_id, 1, unnest({keywords_sql('text')}), generate_subscripts({keywords_sql('text')}, 1) FROM {units}),
l8 AS (SELECT {key}, list(term ORDER BY k) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY doc_id, i) AS k FROM le WHERE part = 0) WHERE k <= 8 GROUP BY {key}),
lu AS (SELECT {key}, lower(term) AS low, min((part, doc_id, i, term)) AS f FROM le GROUP BY ALL),
lk AS (SELECT {key}, list(f[4] ORDER BY k) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY f) AS k FROM lu) WHERE k <= 20 GROUP BY {key}),
leaf AS (SELECT {key}, {SUMMARY} AS summary, first, last, units, tokens, coalesce(headings, []) AS headings, coalesce(keywords, []) AS keywords, coalesce(keywords[:12], []) AS topics FROM lh LEFT JOIN l8 USING ({key}) LEFT JOIN lk USING ({key}))"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line of their own as heading in front of two thirds of them, some blank, a page or a path."""
    d = F.col("doc_id")
    text = F.when(d % 7 < 3, F.lit("  ")).when(d % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("# Part "), (d % 5).cast("string"), F.lit("\n"), "text"))
    return _units(spark, sf_dir).withColumn("text", text).withColumn("page", F.when(d % 4 == 0, d % 9)).withColumn("path", F.when(d % 2 == 0, F.concat(F.lit("p"), d.cast("string"))))


CODED = """c AS (SELECT source || '/' || lang AS material_id, doc_id, CASE WHEN doc_id % 7 < 3 THEN '  ' WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '# Part ' || (doc_id % 5) || chr(10) || coalesce(text, '') END AS text,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 END AS page, CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id END AS path FROM documents)"""


@query(f"""WITH {CODED}, {leaf_sql('c', 'material_id')},
pg AS (SELECT material_id, min(page) AS page_start, max(page) AS page_end, arg_min(path, doc_id) FILTER (WHERE path IS NOT NULL) AS path_start, arg_max(path, doc_id) FILTER (WHERE path IS NOT NULL) AS path_end FROM c GROUP BY material_id)
SELECT material_id, summary, first, last, units, tokens, array_to_string(headings, '|') AS headings, array_to_string(keywords, '|') AS keywords, array_to_string(topics, '|') AS topics,
 page_start, page_end, CASE WHEN page_start IS NULL THEN path_start END AS path_start, CASE WHEN page_start IS NULL THEN path_end END AS path_end FROM leaf JOIN pg USING (material_id)""")
def extractive_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9."""
    leaf = P.leaf_digests(_coded(spark, sf_dir), ["material_id"], "doc_id", "text", "page", "path")
    return leaf.withColumns({c: F.array_join(c, "|") for c in ("headings", "keywords", "topics")})


LISTS = {"points": 12, "topics": 12, "titles": 12, "keywords": 40}


def _round_sql(k: int) -> str:
    """CTEs of one round of merging ``d{k - 1}(material_id, g, ...)`` into ``d{k}``."""
    before, lists = f"d{k - 1}", []
    for name, n in LISTS.items():
        lists.append(f"""{name}{k} AS (SELECT material_id, g, list(f[3] ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY material_id, g ORDER BY f) AS k FROM (
  SELECT material_id, g // 8 AS g, lower(trim(x)) AS low, min((o, i, trim(x))) AS f FROM (SELECT material_id, g, g AS o, unnest({name}) AS x, generate_subscripts({name}, 1) AS i FROM {before}) WHERE trim(x) <> '' GROUP BY ALL)) WHERE k <= {n} GROUP BY material_id, g)""")
    joins = " ".join(f"LEFT JOIN {name}{k} USING (material_id, g)" for name in LISTS)
    picked = ", ".join(f"coalesce({name}, []) AS {name}" for name in LISTS)
    return ",\n".join(lists) + f""",
m{k} AS (SELECT material_id, g // 8 AS g, substr(coalesce(string_agg(trim(summary), ' ' ORDER BY d.g) FILTER (WHERE trim(summary) <> ''), ''), 1, 800) AS summary, min(first) AS first, max(last) AS last, sum(units)::BIGINT AS units, sum(tokens)::BIGINT AS tokens FROM {before} d GROUP BY material_id, d.g // 8),
d{k} AS (SELECT m{k}.*, {picked} FROM m{k} {joins})"""


@query(f"""WITH {CODED}, n AS (SELECT *, (row_number() OVER (PARTITION BY material_id ORDER BY doc_id) - 1) // 2 AS g FROM c), u AS (SELECT material_id || '#' || g AS gk, * FROM n), {leaf_sql('u', 'gk')},
d0 AS (SELECT substr(gk, 1, instr(gk, '#') - 1) AS material_id, substr(gk, instr(gk, '#') + 1)::BIGINT AS g, summary, first, last, units, tokens, headings AS points, topics, headings AS titles, keywords FROM leaf),
{", ".join(_round_sql(k) for k in range(1, 6))}
SELECT material_id, trim(summary) AS summary, first, last, units, tokens, array_to_string(points, '|') AS points, array_to_string(topics, '|') AS topics, array_to_string(titles, '|') AS titles, array_to_string(keywords, '|') AS keywords FROM d5""")
def digest_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: digests of pairs of documents, merged eight at a time until one remains."""
    parts = numbered(P.unit_parts(_coded(spark, sf_dir), ["material_id"], "doc_id", "text"), ["material_id"], ["doc_id"], "n").withColumn("group_no", F.floor(F.col("n") / 2))
    merged = P.reduce_digests(P.grouped_digests(parts, ["material_id", "group_no"], "doc_id"), "material_id", "group_no")
    return merged.withColumn("summary", F.trim("summary")).withColumns({c: F.array_join(c, "|") for c in LISTS})


@query(f"""WITH {UNIT}, g AS (SELECT material_id, any_value(CASE lang WHEN 'en' THEN 'project' WHEN 'de' THEN 'artifact' ELSE 'document' END) AS kind, sum(len({tokens_sql('text')}))::BIGINT AS tokens, count(*) AS units,
 count(*) FILTER (WHERE doc_id % 4 = 0) AS deep FROM u GROUP BY material_id)
SELECT material_id, tokens, units, CASE kind WHEN 'artifact' THEN 'artifact_metadata' WHEN 'project' THEN 'structural_sample' ELSE CASE WHEN tokens <= 20000 THEN 'direct' ELSE 'hierarchical' END END AS mode,
 round(CASE kind WHEN 'project' THEN least(deep / units, 1.0) ELSE 1.0 END, 9) AS ratio FROM g""")
def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11."""
    kind = F.when(F.col("lang") == "en", "project").when(F.col("lang") == "de", "artifact").otherwise("document")
    g = _units(spark, sf_dir).groupBy("material_id").agg(F.first(kind).alias("kind"), F.sum(T.token_count("text")).alias("tokens"), F.count(F.lit(1)).alias("units"), F.count_if(F.col("doc_id") % 4 == 0).alias("deep"))
    c = P.coverage(F.col("kind"), F.col("tokens"), F.col("deep"), F.col("units"), F.col("units"))
    return g.withColumn("c", c).select("material_id", "tokens", "units", "c.mode", F.round("c.ratio", 9).alias("ratio"))


@query(f"""WITH {UNIT}, l AS (SELECT material_id, doc_id, unnest({lines_sql('text')}) AS x, generate_subscripts({lines_sql('text')}, 1) - 1 AS i FROM u),
w AS (SELECT material_id, doc_id, i, {WORD_SQL} AS name FROM l),
e0 AS (SELECT material_id, doc_id, CASE i % 4 WHEN 1 THEN 'function' WHEN 3 THEN 'class' ELSE 'heading' END AS kind, CASE WHEN i % 4 = 0 THEN name || ' x' ELSE name END AS name, i FROM w WHERE i % 4 <> 2
  UNION ALL SELECT material_id, doc_id, 'export', name, i FROM w WHERE i % 4 = 3 AND doc_id % 3 = 1),
o AS (SELECT *, (CASE kind WHEN 'heading' THEN 0 WHEN 'function' THEN 1 WHEN 'class' THEN 2 ELSE 3 END, i) AS pos FROM e0),
f AS (SELECT material_id, kind, lower(name) AS low, min((doc_id, pos, name)) AS f FROM o GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS place FROM f)
SELECT material_id, place, kind, f[3] AS name FROM r WHERE place <= 24""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13 over documents written as code; a third of them are scripts, whose classes are exports too."""
    path = F.when(F.col("doc_id") % 3 == 1, "a.ts").otherwise("a.py")
    u = _units(spark, sf_dir).withColumn("code", _code()).withColumn("path", path)
    return P.entities(u, "material_id", "doc_id", "path", "code")


LANGUAGE = f"coalesce(CASE {corpus_plans.SUFFIX} WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' END, ltrim({corpus_plans.SUFFIX}, '.'))"
NAMED = lambda k, n: f"list_transform(list_filter(list_transform({lines_sql('text')}, lambda x, i: CASE WHEN i % 4 = {k} THEN {WORD_SQL} END), lambda x: x IS NOT NULL)[:{n}], lambda x: x)"
RECORDS = f"""{corpus_plans.FILES},
rec AS (SELECT material_id, path, pos, {LANGUAGE} AS language, {corpus_plans.ROLE} AS role, {corpus_plans.SUB} AS subsystem, {NAMED(3, 12)} AS imports, list_concat({NAMED(2, 8)}, {NAMED(0, 8)}) AS symbols FROM f WHERE {corpus_plans.ELIGIBLE})"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inventory(corpus_plans._files(spark, sf_dir).withColumn("code", _code()), "material_id", "path", "code", "pos")


@query(f"WITH {RECORDS} SELECT material_id, path, language, role, subsystem, array_to_string(imports, '|') AS imports, array_to_string(symbols, '|') AS symbols FROM rec")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: one row per file."""
    return _records(spark, sf_dir).drop("pos").withColumn("imports", F.array_join("imports", "|")).withColumn("symbols", F.array_join("symbols", "|"))


ROLLUP = f"""{RECORDS},
lang_n AS (SELECT material_id, language, count(*) AS n FROM rec GROUP BY ALL),
lg AS (SELECT material_id, list(language ORDER BY language) AS languages, list(language || ':' || n ORDER BY language) AS counted FROM lang_n GROUP BY material_id),
sb AS (SELECT material_id, list(f[2] ORDER BY k) AS subsystems FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS k FROM (SELECT material_id, lower(subsystem) AS low, min((pos, subsystem)) AS f FROM rec GROUP BY ALL)) WHERE k <= 24 GROUP BY material_id),
im AS (SELECT material_id, pos, unnest(imports) AS term, generate_subscripts(imports, 1) AS i FROM rec),
dp AS (SELECT material_id, list(f[3] ORDER BY k) AS imported FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS k FROM (SELECT material_id, lower(term) AS low, min((pos, i, term)) AS f FROM im GROUP BY ALL)) WHERE k <= 30 GROUP BY material_id),
en AS (SELECT material_id, list(path ORDER BY k) AS entry_points FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY pos) AS k FROM rec WHERE role = 'entry') WHERE k <= 8 GROUP BY material_id)"""


@query(f"""WITH {ROLLUP} SELECT material_id, array_to_string(counted, '|') AS languages, coalesce(array_to_string(subsystems, '|'), '') AS subsystems, coalesce(array_to_string(entry_points, '|'), '') AS entry_points, coalesce(array_to_string(imported, '|'), '') AS dependencies
FROM lg LEFT JOIN sb USING (material_id) LEFT JOIN en USING (material_id) LEFT JOIN dp USING (material_id)""")
def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: one row per material."""
    r = P.inventory_rollup(_records(spark, sf_dir), "material_id", "path", "pos")
    counted = F.transform("languages", lambda x: F.concat(x["language"], F.lit(":"), x["files"].cast("string")))
    return r.withColumn("languages", F.array_join(counted, "|")).withColumns({c: F.array_join(c, "|") for c in ("subsystems", "entry_points", "dependencies")})


@query(f"""WITH {KEYWORDS}, pool AS (SELECT material_id, place AS pos, f[3] AS term FROM r WHERE place <= 40),
req AS (SELECT material_id, place AS pos, upper(f[3]) AS term FROM r WHERE place BETWEEN 20 AND 60),
p AS (SELECT q.material_id, 0 AS part, q.pos, pool.term FROM req q JOIN pool ON q.material_id = pool.material_id AND lower(q.term) = lower(pool.term) UNION ALL SELECT material_id, 1, pos, term FROM pool),
d AS (SELECT material_id, lower(term) AS low, min((part, pos, term)) AS f FROM p GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS n FROM d)
SELECT material_id, string_agg(f[3], '|' ORDER BY n) AS terms FROM x WHERE n <= 25 GROUP BY material_id""")
def grounded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: requested terms in another case, grounded in the pool."""
    k = P.material_keywords(_units(spark, sf_dir), "material_id", "doc_id", "text").select("material_id", F.posexplode("terms").alias("p", "term")).withColumn("pos", F.col("p") + 1)
    asked = k.filter("pos between 20 and 60").withColumn("term", F.upper("term"))
    return P.grounded(asked, k.filter("pos <= 40"), "material_id", 25).select("material_id", F.array_join("terms", "|").alias("terms"))


@query(f"""WITH {KEYWORDS}, w AS (SELECT material_id, list(f[3] ORDER BY place) AS terms FROM r WHERE place <= 80 GROUP BY material_id)
SELECT material_id, trim(array_to_string(list_concat([material_id], terms[:24], terms[:12]), ' ')) AS card FROM w""")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12: text of each material's card."""
    from quarry.operators.index import card_text

    k = P.material_keywords(_units(spark, sf_dir), "material_id", "doc_id", "text")
    return k.select("material_id", card_text("material_id", "terms", F.slice("terms", 1, 12)).alias("card"))


@query(f"""WITH {UNIT}, c AS (SELECT DISTINCT material_id, lang FROM u)
SELECT material_id, CASE lang WHEN 'en' THEN 0.8 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.5 ELSE 0.4 END AS relevance,
 CASE lang WHEN 'en' THEN 'document for research reading' WHEN 'de' THEN 'software project' WHEN 'fr' THEN 'tabular dataset' END AS purpose,
 array_to_string(['text', lang], '|') AS technologies FROM c""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, FN18: constants by type, unique technology names."""
    from quarry.operators import corpus as C

    c = _units(spark, sf_dir).select("material_id", "lang").distinct()
    kind = F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "project").when(F.col("lang") == "fr", "dataset")
    names = T.unique(F.array(F.lit("text"), F.lit("Text "), F.col("lang"), F.upper("lang")), 8)
    return c.select("material_id", T.clamp_relevance(C.mapped(kind, P.RELEVANCE).cast("string"), 0.4).alias("relevance"), C.mapped(kind, P.PURPOSE).alias("purpose"), F.array_join(names, "|").alias("technologies"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of five kinds whose package and dependencies are the words of a document, sorted."""
    ws = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != "")))
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("material_id"), (F.col("doc_id") % 5).alias("k"), F.col("doc_id").alias("pos"), ws.alias("w"))
    first, lines = F.coalesce(F.get("w", F.lit(0)), F.lit("")), lambda f: F.array_join(F.transform("w", f), "\n")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('": "1"'))
    body = (
        F.when(F.col("k") == 0, F.concat(F.lit("# pinned\n-r other.txt\n"), lines(lambda x: F.concat(x, F.lit(" >= 1.0 ; extra")))))
        .when(F.col("k") == 1, F.concat(F.lit('{"name": "'), first, F.lit('", "dependencies": {'), F.array_join(F.transform("w", quoted), ", "), F.lit('}, "peerDependencies": {"peer": "2"}}')))
        .when(F.col("k") == 2, F.concat(F.lit("module example.com/"), first, F.lit("\n\nrequire (\n"), lines(lambda x: F.concat(F.lit("\t"), x, F.lit(" v1.0.0"))), F.lit("\n)\n")))
        .otherwise(F.concat(F.lit("[project]\nname = '"), first, F.lit("'\n")))
    )
    name = F.element_at(F.array(*map(F.lit, ("requirements.txt", "package.json", "go.mod", "pyproject.toml", "Cargo.toml"))), (F.col("k") + 1).cast("int"))
    return d.select("material_id", "pos", name.alias("path"), body.alias("text"))


MANIFESTS = """mf AS (SELECT doc_id // 3 AS material_id, doc_id AS pos, doc_id % 5 AS k, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> ''))) AS w FROM documents),
dep0 AS (SELECT material_id, pos, unnest(CASE WHEN k = 1 THEN list_append(w, 'peer') ELSE w END) AS term, generate_subscripts(CASE WHEN k = 1 THEN list_append(w, 'peer') ELSE w END, 1) AS i FROM mf WHERE k < 3),
dep AS (SELECT material_id, list(f[3] ORDER BY n) AS dependencies FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS n FROM (SELECT material_id, term, min((pos, i, term)) AS f FROM dep0 GROUP BY ALL)) WHERE n <= 30 GROUP BY material_id),
pk AS (SELECT material_id, arg_min(CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'node' WHEN 2 THEN 'go' WHEN 3 THEN 'python' ELSE 'rust' END, CASE k WHEN 3 THEN 0 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END) AS language,
  arg_min(CASE WHEN k = 2 THEN 'example.com/' || coalesce(w[1], '') ELSE w[1] END, pos) FILTER (WHERE k = 2 OR (k <> 0 AND len(w) > 0)) AS package FROM mf GROUP BY material_id)"""


@query(f"WITH {MANIFESTS} SELECT material_id, language, package, coalesce(array_to_string(dependencies, '|'), '') AS dependencies FROM pk LEFT JOIN dep USING (material_id)")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15, FN13: language, package and dependencies of manifests made of all words of the documents."""
    return P.identity(_manifests(spark, sf_dir), "material_id", "path", "text", "pos").withColumn("dependencies", F.array_join("dependencies", "|"))


KINDS = {0: ("project", "python"), 1: ("dataset", "csv"), 2: ("document", "text"), 3: ("code", "py"), 4: (None, None)}


def _analysis_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Materials by kind, their documents as code with a title on every fifth, and the same as files."""
    files = corpus_plans._files(spark, sf_dir).withColumn("code", _code()).drop("text", "full_path")
    folder = scratch_dir(spark, "as-code")
    files.write.parquet(folder)  # read by every step, so made once
    files = spark.read.schema(files.schema).parquet(folder)
    kinds = [F.when(F.col("kind") == k, F.lit(t)) for k, (t, _) in KINDS.items() if t], [F.when(F.col("kind") == k, F.lit(s)) for k, (_, s) in KINDS.items() if s]
    m = files.select("material_id", F.concat(F.lit("m"), F.col("material_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("version"), F.coalesce(*kinds[0]).alias("material_type"), F.coalesce(*kinds[1]).alias("subtype")).distinct()
    titled = F.when((F.col("pos") % 5 == 3) & (F.col("kind") > 1), F.concat(F.lit(" Title "), F.col("pos").cast("string")))
    units = files.select("material_id", "pos", titled.alias("title"), F.col("code").alias("text"))
    return m, units, files.select("material_id", "path", "pos", F.col("code").alias("text"))


ANALYSIS = f"""{ROLLUP}, cu AS (SELECT material_id, kind, pos AS doc_id, {CODE} AS text FROM f), {leaf_sql('cu', 'material_id')},
uk AS (SELECT material_id, doc_id, lower(term) AS low, min((part, i, term)) AS f FROM le GROUP BY ALL),
ui AS (SELECT material_id, doc_id, low, f[3] AS term, row_number() OVER (PARTITION BY material_id, doc_id ORDER BY f) AS i FROM uk),
po AS (SELECT material_id, list(f[3] ORDER BY k) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS k FROM (SELECT material_id, low, min((doc_id, i, term)) AS f FROM ui WHERE i <= 40 GROUP BY ALL)) WHERE k <= 80 GROUP BY material_id),
mt AS (SELECT DISTINCT material_id, kind, CASE kind WHEN 0 THEN 'project' WHEN 1 THEN 'dataset' WHEN 2 THEN 'document' WHEN 3 THEN 'code' END AS type, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'csv' WHEN 2 THEN 'text' WHEN 3 THEN 'py' END AS subtype FROM f),
ci AS (SELECT material_id, pos, unnest({NAMED(3, 1000000)}) AS term, generate_subscripts({NAMED(3, 1000000)}, 1) AS i FROM f),
tl AS (SELECT material_id, (0, 0, 0, subtype) AS f FROM mt WHERE subtype IS NOT NULL UNION ALL SELECT material_id, (2, 0, i, x) FROM (SELECT material_id, unnest(languages) AS x, generate_subscripts(languages, 1) AS i FROM lg) UNION ALL SELECT material_id, (3, pos, i, term) FROM ci),
tn AS (SELECT material_id, list(f[4] ORDER BY k) AS technologies FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS k FROM (SELECT material_id, lower(f[4]) AS low, min(f) AS f FROM tl WHERE trim(f[4]) <> '' GROUP BY ALL)) WHERE k <= 8 GROUP BY material_id),
tt AS (SELECT material_id, arg_min('Title ' || pos, pos) FILTER (WHERE pos % 5 = 3 AND kind > 1) AS title FROM f GROUP BY material_id),
hd AS (SELECT material_id, arg_min(({HEADINGS})[1], doc_id) FILTER (WHERE len({HEADINGS}) > 0) AS heading FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY doc_id) AS k FROM cu) WHERE k <= 4 GROUP BY material_id),
tp AS (SELECT material_id, list(f[2] ORDER BY k) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY f) AS k FROM (SELECT material_id, lower(x) AS low, min((i, x)) AS f FROM (
  SELECT material_id, unnest(list_concat(topics, pool[:8])) AS x, generate_subscripts(list_concat(topics, pool[:8]), 1) AS i FROM leaf JOIN po USING (material_id)) GROUP BY ALL)) WHERE k <= 12 GROUP BY material_id)"""


@query(f"""WITH {ANALYSIS}
SELECT material_id, coalesce(title, heading, 'm' || material_id) AS title, coalesce(nullif(trim(summary), ''), units || ' ' || coalesce(type, 'unknown') || CASE WHEN units = 1 THEN ' unit' ELSE ' units' END) AS summary,
 CASE type WHEN 'document' THEN 'document for research reading' WHEN 'project' THEN 'software project' WHEN 'dataset' THEN 'tabular dataset' WHEN 'code' THEN 'source code' END AS purpose,
 coalesce(array_to_string(tp.topics, '|'), '') AS topics, coalesce(array_to_string(pool[:25], '|'), '') AS keywords, coalesce(array_to_string(technologies, '|'), '') AS technologies, coalesce(array_to_string(entry_points, '|'), '') AS capabilities,
 CASE type WHEN 'document' THEN 0.8 WHEN 'project' THEN 0.7 WHEN 'code' THEN 0.6 WHEN 'dataset' THEN 0.5 ELSE 0.4 END AS relevance
FROM mt LEFT JOIN leaf USING (material_id) LEFT JOIN po USING (material_id) LEFT JOIN tn USING (material_id) LEFT JOIN tt USING (material_id) LEFT JOIN hd USING (material_id) LEFT JOIN en USING (material_id) LEFT JOIN tp USING (material_id)""")
def material_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, FN18: the built-in analyzer."""
    return P.analyzed(*_analysis_inputs(spark, sf_dir), "material_id").withColumns({c: F.array_join(c, "|") for c in ("topics", "keywords", "technologies", "capabilities")})


@query(f"WITH {corpus_plans.FILES} SELECT material_id, 'longest of ' || count(*) AS title, greatest(least(max(length(text)) / 1000.0, 1.0), 0.0)::DOUBLE AS relevance FROM f GROUP BY material_id HAVING material_id % 2 = 0 UNION ALL SELECT DISTINCT material_id, NULL, 0.4 FROM f WHERE material_id % 2 = 1")
def analyzer_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF3: an analyzer of the caller's; materials that it leaves out get the default relevance."""

    def analyzer(materials: DataFrame, units: DataFrame, files: DataFrame, material: str) -> DataFrame:
        size = files.groupBy(material).agg(F.concat(F.lit("longest of "), F.count(F.lit(1)).cast("string")).alias("title"), (F.max(F.length("text")) / 1000).alias("relevance"))
        return size.filter(F.col(material) % 2 == 0)

    m, units, files = _analysis_inputs(spark, sf_dir)
    plain = corpus_plans._files(spark, sf_dir).select("material_id", "path", "pos", "text")
    return P.analyzed(m, units, plain, "material_id", analyzer).select("material_id", "title", "relevance")


@query(f"""SELECT doc_id, greatest(len({lines_sql('text')}) - 1, 0) AS rows,
 coalesce(array_to_string(list_filter(list_transform(string_split(coalesce({lines_sql('text')}[1], ''), CASE WHEN doc_id % 2 = 0 THEN ',' ELSE chr(9) END), lambda x: trim(x)), lambda x: x <> '')[:40], '|'), '') AS columns FROM documents""")
def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: every document read as a CSV or TSV file."""
    path = F.when(F.col("doc_id") % 2 == 0, "a.csv").otherwise("a.tsv")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), path.alias("path"))
    return P.csv_profile(d, "doc_id", "path", "text").select("doc_id", "rows", F.array_join("columns", "|").alias("columns"))


PURPOSE_SQL = "CASE m.material_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PURPOSE.items()) + " END"
RELEVANCE_SQL = "CASE m.material_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in P.RELEVANCE.items()) + " ELSE 0.4::DOUBLE END"
