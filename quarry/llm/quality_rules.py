"""Text statistics, base rules and robust multivariate outliers per language and source.

DataFrame functions only. After the base rules each text has a vector of transformed statistics
(``VECTOR``). For every (lang, source) group a minimum-covariance-determinant estimate is found over all
its texts that pass the base rules, from ``STARTS`` deterministic starts (distances by medians and median
deviations as they are, under the covariance of their hyperbolic tangents, and under that of their spatial
signs). A concentration step takes the ``SHARE`` of the group with the least distances and recomputes mean
and covariance from them; after ``FIRST_STEPS`` steps the start of least determinant goes on for ``STEPS`` more.
Distances are cut into fine steps so that the share's limit is a count per step, combined on the map side.
A text is rejected if its squared Mahalanobis distance under the final, consistency-scaled estimate is
beyond ``LIMIT``.

Every group's estimate is pooled with that of its language as if this were ``PRIOR_TEXTS`` further texts, and the
language's likewise with that of all texts, so a small group leans on them and a large one hardly does. A
ridge per statistic (``RIDGE``) keeps covariances invertible and small counts harmless where most texts of a
group have none.

What is known of a group is one row. While there are at most ``GROUPS`` groups these rows are broadcast and no
text is shuffled by group; beyond it texts meet them in a join that deals hot groups over several tasks.

Nulls: a null text has no words and fails the base rules; null lang and source form groups of
their own; a null doc_id is carried through. Repeated rows each count. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import cut, hot_keys, hot_limit, spread_join

SHARE = 0.75
STARTS = ("plain", "tanh", "sign")
FIRST_STEPS, STEPS = 2, 3
PRIOR_TEXTS = 40
GROUPS = 50_000
#: Upper 3.8e-7 point of chi-square with 5 degrees of freedom, and the factor that makes a covariance
#: of the nearest 75 % consistent at the normal: 0.75 / P(chi2_7 <= q), q the 75 % point of chi2_5.
LIMIT = 38.0
CONSISTENCY = 1.41207
#: Variance added to each statistic: what a clean text may differ by where its group is nearly constant.
RIDGE = (0.03**2, 0.6**2, 0.4**2, 0.8**2, 0.1**2)
VECTOR = ("v_chars", "v_symbols", "v_lines", "v_repeat", "v_words")
SYMBOLS = "#*$%&|<>"
DIM = len(VECTOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def base_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeated three-word windows are found by sorting the windows' hashes with their places inside the
    row: equal neighbours are windows found twice or more, and the words they cover are counted from
    the gaps between their sorted places. Time is n log n in the text's words, without a shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    space = "[\\x20\\x09-\\x0D]+"
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"),
        F.filter(F.split(text, space), lambda w: w != "").alias("w"),
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    windows = "if(size(w) < 3, cast(array() as array<struct<h:bigint,p:int>>), transform(sequence(0, size(w) - 3), p -> named_struct('h', xxhash64(w[p], w[p + 1], w[p + 2]), 'p', p)))"
    sized = found.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - F.length(F.regexp_replace("t", "[^\\x20\\x09-\\x0D]+", ""))).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.expr(windows)).alias("s"),
    )
    repeated = F.expr("filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h))")
    placed = sized.withColumn("r", repeated).withColumn("r", F.sort_array(F.transform("r", lambda x: x["p"])))
    covered = F.expr("aggregate(r, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)")
    out = placed.withColumn("n_repeat_words", covered.cast("long")).drop("s", "r")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Statistics transformed towards symmetric, light-tailed scales."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("v_chars", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("v_symbols", F.log1p(F.lit(100.0) * F.col("n_symbols") / n))
        .withColumn("v_lines", F.log1p(F.lit(100.0) * F.col("n_dup_lines") / n))
        .withColumn("v_repeat", F.log1p(F.lit(100.0) * F.col("n_repeat_words") / n))
        .withColumn("v_words", F.log(n))
    )


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows joined with one row per group: by broadcast while the groups are few, else spread over tasks."""
    return rows.join(F.broadcast(table), keys) if few else spread_join(rows, table, keys, hot_keys(rows, keys, hot_limit(rows.count())))


def _moments(rows: DataFrame, keys: list[str], names: tuple[str, ...] = VECTOR) -> DataFrame:
    """Mean and covariance per group."""
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.avg(v).alias(f"m{i}") for i, v in enumerate(names)]
    sums += [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(*sums)


def _precision(moments: DataFrame, keys: list[str], factor: float = 1.0, ridge: tuple[float, ...] = RIDGE) -> DataFrame:
    """Inverse covariance by Cholesky factors, one row per group, with its log determinant ``det``."""
    at = moments
    for i in range(DIM):
        for j in range(i + 1):
            total = F.col(f"c{i}{j}") * factor + (F.lit(ridge[i]) if i == j else F.lit(0.0))
            for k in range(j):
                total = total - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            at = at.withColumn(f"l{i}{j}", F.sqrt(F.greatest(total, F.lit(ridge[i] / 100))) if i == j else total / F.col(f"l{j}{j}"))
    for j in range(DIM):  # u = inverse of l, column by column
        for i in range(j, DIM):
            total = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                total = total - F.col(f"l{i}{k}") * F.col(f"u{k}{j}")
            at = at.withColumn(f"u{i}{j}", total / F.col(f"l{i}{i}"))
    inverse = [sum((F.col(f"u{k}{i}") * F.col(f"u{k}{j}") for k in range(i, DIM)), F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS]
    det = sum((F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0)).alias("det")
    return at.select(*keys, *[f"m{i}" for i in range(DIM)], *inverse, det)


def _form(d: list[Column]) -> Column:
    """Quadratic form of the deviations under the precision columns."""
    return sum((F.col(f"p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))


def _distance() -> Column:
    return _form([F.col(v) - F.col(f"m{i}") for i, v in enumerate(VECTOR)])


def _nearest(rows: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """The rows with the least ``d`` that make up SHARE of each group, by counts per step of d.

    Steps are 1/256 of an octave wide; rows of the step in which the share is reached all belong.
    """
    stepped = rows.withColumn("step", F.floor(F.log2(F.greatest(F.col("d"), F.lit(1e-9))) * 256).cast("int"))
    counts = stepped.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("k"))  # at most a few thousand steps a group
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "k"))).alias("steps"), F.sum("k").alias("size"))
    limit = f"aggregate(steps, named_struct('seen', 0L, 'at', cast(null as int)), (a, x) -> named_struct('seen', a.seen + x.k, 'at', if(a.seen < ceil({SHARE} * size), x.step, a.at)), a -> a.at)"
    return _meet(stepped, listed.select(*keys, F.expr(limit).alias("limit")), keys, few).filter("step <= limit").drop("step", "limit", "d")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Rows with ``start`` and the distance ``d`` of each start."""
    middle = rows.groupBy("g").agg(*[F.percentile_approx(v, 0.5, 1000).alias(f"q{i}") for i, v in enumerate(VECTOR)])
    off = _meet(rows, cut(middle, "middle"), ["g"], few)
    spread = off.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"q{i}")), 0.5, 1000).alias(f"s{i}") for i, v in enumerate(VECTOR)])
    z = [(F.col(v) - F.col(f"q{i}")) / (F.col(f"s{i}") + 0.02) for i, v in enumerate(VECTOR)]
    scaled = _meet(off, cut(spread, "spread"), ["g"], few).select("g", *VECTOR, *[x.alias(f"z{i}") for i, x in enumerate(z)])
    plain = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)), F.lit(0.0))
    turned = scaled.withColumn("start", F.explode(F.array(*map(F.lit, STARTS)))).withColumn("_r", F.sqrt(plain) + 1e-9)
    shaped = lambda x: F.when(F.col("start") == "tanh", F.tanh(x)).when(F.col("start") == "sign", x / F.col("_r")).otherwise(x)
    moments = _moments(turned.select("g", "start", *[shaped(F.col(f"z{i}")).alias(v) for i, v in enumerate(VECTOR)]), ["g", "start"])
    shapes = _precision(moments, ["g", "start"], ridge=(0.01,) * DIM)
    d = F.when(F.col("start") == "plain", plain).otherwise(_form([F.col(f"z{i}") for i in range(DIM)]))
    return _meet(turned, cut(shapes, "shapes"), ["g", "start"], few).select("g", "start", *VECTOR, d.alias("d"))


def estimates(rows: DataFrame) -> DataFrame:
    """MCD mean (m) and covariance (c) per group ``g`` of ``rows(g, VECTOR)``; size is the group's rows.

    The few numbers of every group are written after each step, so a step's plan does not hold the earlier ones.
    """
    rows = cut(rows.select("g", *VECTOR), "vectors")
    sizes = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
    few = sizes.count() <= GROUPS
    keys = ["g", "start"]

    def step(at: DataFrame, by: list[str]) -> DataFrame:
        near = _meet(rows, at.drop("det"), ["g"], few).withColumn("d", _distance()).select(*by, *VECTOR, "d")
        return cut(_moments(_nearest(near, by, few), by), "moments")

    found = cut(_moments(_nearest(_starts(rows, few), keys, few), keys), "moments")
    for _ in range(FIRST_STEPS):
        found = step(_precision(found, keys), keys)
    found = _precision(found, keys)
    best = found.groupBy("g").agg(F.min(F.struct("det", "start", *[c for c in found.columns if c not in ("g", "det", "start")])).alias("b")).select("g", "b.*").drop("start")
    for _ in range(STEPS):
        found = step(best, ["g"])
        best = _precision(found, ["g"])
    return found.drop("n").join(sizes, "g")


def _pooled(own: DataFrame, key: str, above: DataFrame, link: str) -> DataFrame:
    """``own`` (one row per ``key``) pooled with its row of ``above`` (by ``link``), which counts as PRIOR_TEXTS texts."""
    names = [f"m{i}" for i in range(DIM)] + [f"c{i}{j}" for i, j in PAIRS]
    both = own.join(above.select(link, *[F.col(c).alias(f"up_{c}") for c in names]), link)
    share = F.col("size") / (F.col("size") + PRIOR_TEXTS)
    mixed = lambda c: share * F.col(c) + (1 - share) * F.col(f"up_{c}")
    apart = [F.col(f"m{i}") - F.col(f"up_m{i}") for i in range(DIM)]
    between = lambda i, j: share * (1 - share) * apart[i] * apart[j]
    return both.select(key, *[mixed(f"m{i}").alias(f"m{i}") for i in range(DIM)], *[(mixed(f"c{i}{j}") + between(i, j)).alias(f"c{i}{j}") for i, j in PAIRS])


def pooled_estimates(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean and precision per ``k`` of ``groups(k, language, all)``, names of estimates in ``found(g, ...)``."""
    top = found.withColumnRenamed("g", "all")
    languages = groups.select("language", "all").distinct()
    middle = _pooled(found.withColumnRenamed("g", "language").join(languages, "language"), "language", top, "all")
    own = _pooled(found.withColumnRenamed("g", "k").join(groups.select("k", "language"), "k"), "k", middle, "language")
    return _precision(own, ["k"], CONSISTENCY).drop("det")


def quality_rules(docs: DataFrame) -> DataFrame:
    """base_stats plus distance (null where base_failed) and kept."""
    stats = cut(vectors(base_stats(docs)), "stats")
    name = lambda *c: F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in c])
    keys = F.array(name(F.col("lang"), F.col("source")), name(F.col("lang")), F.lit(""))
    good = stats.filter("not base_failed")
    # A row takes part in its group, its language and the whole.
    found = estimates(good.select(F.explode(keys).alias("g"), *VECTOR))
    groups = cut(good.select(keys[0].alias("k"), keys[1].alias("language"), keys[2].alias("all")).distinct(), "groups")
    chosen = pooled_estimates(found, groups)
    judged = _meet(good.withColumn("k", keys[0]), cut(chosen, "chosen"), ["k"], groups.count() <= GROUPS)
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    judged = judged.withColumn("distance", _distance()).select(*failed.columns).unionByName(failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(~F.col("base_failed") & (F.col("distance") <= LIMIT), F.lit(False)).alias("kept"), "distance", "lang", "source",
    )
