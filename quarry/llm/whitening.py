"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Every component c of a vector becomes x = floor(64 * c) + 1000000. With n vectors and their sums S the scatter

    M = sum (n x - S)(n x - S)^T / n = n * sum x x^T - S S^T

is a matrix of whole numbers and n^2 times the covariance (divisor n). No step before the last rounds:

1. each task adds up counts, sums and products of its vectors (shifted by the constant, which changes no entry of M), in
   double matrix products of few enough rows that every partial sum is a whole number below 2**53;
2. the characteristic polynomial of M is found modulo 31-bit primes, one prime after the other in tasks: reduction
   to Hessenberg form by similarity, then its recurrence. As M is positive semi-definite, its coefficients are bounded by
   Maclaurin's inequality; enough primes for twice that bound are put together by Chinese remaindering;
3. all roots are real. Factors are separated by multiplicity (Yun's algorithm; a gcd modulo a prime shows that a
   polynomial is square-free), roots are isolated by bisection, where the sign changes of the polynomial shifted to a
   point count the roots above it exactly (Budan and Fourier), and narrowed by exact signs to ``DIGITS`` digits;
4. a component spans the null space of M - e I: inverse iteration in tasks with decimals of twice as many digits, for
   an eigenvalue of multiplicity m from m start vectors, orthogonal to one another.

Whitening is one more pass: (x - S/n) on every component over sqrt(e), with the exact sum of squares of n x - S. What
travels through the driver are matrices, polynomials and components of the given dimension, never vectors.

Dropped are rows whose vector is null or empty or holds null or non-finite entries; if lengths differ, only the most frequent length
(the smallest on a tie) is used. Entries beyond 2**53 after scaling are set to that limit. Components exist for
eigenvalues above zero only, so a constant or single vector gives no rows, nor does an empty table. A deviation beyond a
long is null. A null vec_id is carried through, repeated rows are vectors of their own, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 53
DIGITS = 40
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
Polynomial = list[int]  # coefficients from the constant on


# Exact scatter


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, no_id (its vec_id is null; 0 stands in for it) and y = x - SHIFT of the usable rows of ``rows(vec_id, embedding)``."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("e", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * SCALE))).cast("long"))
    typed = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), F.col("embedding").cast("array<double>").alias("e"))
    return typed.filter((F.size("e") > 0) & finite).select("vec_id", "no_id", whole.alias("y"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y as Python integers."""
    top = int(np.abs(y).max(initial=1)) or 1
    rows = LIMIT // (top * top)
    if rows == 0:  # entries too large for exact doubles
        y = y.astype(object)
        return y.T @ y
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of y, M) of ``vectors(y)``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, total = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            if len(b):
                y = matrix(b["y"])
                n, sums, total = n + len(y), sums + y.astype(object).sum(axis=0), total + products(y)
        if n:
            i, j = np.triu_indices(dims)
            # Row -1 holds the sums, (-1, -1) the count.
            values = [n, *sums, *total[i, j]]
            yield pd.DataFrame({"i": [-1, *[-1] * dims, *i], "j": [-1, *range(dims), *j], "v": [Decimal(int(v)) for v in values]})

    parts = vectors.select("y").mapInPandas(run, "i int, j int, v decimal(38,0)")
    found = {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}  # dims**2 / 2 rows
    n, sums = found.get((-1, -1), 0), [found.get((-1, j), 0) for j in range(dims)]
    full = [[n * found.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    return n, sums, full


# Characteristic polynomial


def is_prime(n: int) -> bool:
    """Miller and Rabin with bases that decide all numbers below 3.2e9."""
    if n % 2 == 0 or n < 9:
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest 31-bit primes whose product exceeds ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(m: list[list[int]], p: int) -> list[int]:
    """Characteristic polynomial of ``m`` modulo ``p``, constant first: Hessenberg form, then its recurrence."""
    h = np.array([[v % p for v in row] for row in m], np.int64)
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        # The inverse operation on columns, one sum below 2**63 at a time.
        for i in np.flatnonzero(factors):
            h[:, k + 1] = (h[:, k + 1] + factors[i] * h[:, k + 2 + i]) % p
    found = [np.array([1], np.int64)]
    for k in range(n):
        new = np.zeros(k + 2, np.int64)
        new[1:] = found[k]
        new[:-1] = (new[:-1] - h[k, k] * found[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            new[: i + 1] = (new[: i + 1] - int(h[i, k]) * chain % p * found[i]) % p
        found.append(new)
    return [int(c) for c in found[n] % p]


def coefficient_bound(m: list[list[int]]) -> int:
    """No coefficient of a positive semi-definite matrix is larger: elementary symmetric functions of its eigenvalues."""
    n, trace = len(m), sum(m[i][i] for i in range(len(m)))
    mean = -(-trace // n)
    return max(comb(n, k) * mean**k for k in range(n + 1))


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> Polynomial:
    """Exact coefficients; every task reduces the matrix modulo primes of its own."""
    primes = primes_for(2 * coefficient_bound(m))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "c": [polynomial_mod(m, int(p)) for p in b["p"]]})

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    value, modulus = [0] * (len(m) + 1), 1
    for r in table.mapInPandas(run, "p long, c array<bigint>").orderBy(F.desc("p")).collect():  # dims + 1 numbers a prime
        inverse = pow(modulus, -1, r.p)
        value = [v + modulus * ((c - v) * inverse % r.p) for v, c in zip(value, r.c, strict=True)]
        modulus *= r.p
    return [v - modulus if 2 * v > modulus else v for v in value]


# Real roots


def trimmed(a: Polynomial) -> Polynomial:
    while len(a) > 1 and a[-1] == 0:
        a = a[:-1]
    return a


def primitive(a: Polynomial) -> Polynomial:
    """Without common factor, leading coefficient positive."""
    a = trimmed(a)
    g = gcd(*a) * (-1 if a[-1] < 0 else 1)
    return [c // g for c in a] if g else a


def derivative(a: Polynomial) -> Polynomial:
    return [i * c for i, c in enumerate(a)][1:] or [0]


def divided(a: Polynomial, b: Polynomial) -> tuple[Polynomial, Polynomial]:
    """Pseudo-quotient and pseudo-remainder of whole-number polynomials."""
    rest, lead, out = list(a), b[-1], [0] * max(1, len(a) - len(b) + 1)
    for i in range(len(a) - len(b), -1, -1):
        top = rest[i + len(b) - 1]
        rest, out = [lead * c for c in rest], [lead * c for c in out]
        out[i] += top
        for j, c in enumerate(b):
            rest[i + j] -= top * c
    return out, trimmed(rest[: max(1, len(b) - 1)])


def common_factor(a: Polynomial, b: Polynomial) -> Polynomial:
    a, b = primitive(a), primitive(b)
    while any(b):
        a, b = b, primitive(divided(a, b)[1]) if len(a) >= len(b) else a
    return primitive(a)


def square_free_mod(a: Polynomial, p: int) -> bool:
    """Whether ``a`` and its derivative have no common factor modulo ``p`` (then they have none at all)."""
    x, y = [c % p for c in a], [c % p for c in derivative(a)]
    x, y = trimmed(x), trimmed(y)
    if len(x) < len(a):
        return False
    while any(y):
        inverse = pow(y[-1], -1, p)
        while len(x) >= len(y) and any(x):
            q, at = x[-1] * inverse % p, len(x) - len(y)
            x = trimmed([*x[:at], *[(c - q * d) % p for c, d in zip(x[at:], y, strict=True)][:-1]] or [0])
        x, y = y, x
    return len(x) == 1


def factors(a: Polynomial) -> list[tuple[Polynomial, int]]:
    """Square-free factors with their multiplicities (Yun); zero roots are taken out before."""
    if len(a) < 2:
        return []
    if square_free_mod(a, (1 << 61) - 1):
        return [(primitive(a), 1)]
    out, k = [], 1
    g = common_factor(a, derivative(a))
    rest = primitive(divided(a, g)[0])  # every root once
    while len(rest) > 1:
        still = common_factor(rest, g) if len(g) > 1 else [1]
        own = primitive(divided(rest, still)[0])
        if len(own) > 1:
            out.append((own, k))
        g = primitive(divided(g, still)[0])
        rest, k = still, k + 1
    return out


def value_sign(a: Polynomial, numerator: int, shift: int) -> int:
    """Sign of the polynomial at numerator / 2**shift."""
    total, scale = 0, 1
    for c in reversed(a):
        total = total * numerator + c * scale
        scale <<= shift
    return (total > 0) - (total < 0)


def roots_above(a: Polynomial, numerator: int, shift: int) -> int:
    """Roots above numerator / 2**shift of a polynomial whose roots are all real: sign changes after a shift."""
    n = len(a) - 1
    c = [v << (shift * (n - i)) for i, v in enumerate(a)]  # 2**(shift n) a(x / 2**shift)
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += numerator * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolated(a: Polynomial) -> list[tuple[int, int, int]]:
    """(low, high, shift) for every positive root of a square-free polynomial with real roots: alone in (low, high] / 2**shift."""
    top = 1
    while roots_above(a, top, 0):
        top *= 2
    todo, out = [(0, top, 0, roots_above(a, 0, 0), 0)], []
    while todo:
        low, high, shift, above_low, above_high = todo.pop()
        if above_low - above_high == 0:
            continue
        if above_low - above_high == 1:
            out.append((low, high, shift))
            continue
        if (low + high) % 2:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        above = roots_above(a, middle, shift)
        todo += [(low, middle, shift, above_low, above), (middle, high, shift, above, above_high)]
    return out


def narrowed(a: Polynomial, low: int, high: int, shift: int, digits: int = DIGITS) -> Decimal:
    """The root in (low, high] / 2**shift to ``digits`` significant digits."""
    side = value_sign(a, high, shift)
    while side and (high - low) * 10**digits > low:
        if (low + high) % 2 or high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        sign = value_sign(a, middle, shift)
        if sign == 0:
            low = high = middle
        elif sign == side:
            high = middle
        else:
            low = middle
    with localcontext() as context:
        context.prec = 2 * digits
        return Decimal(low + high if side else 2 * high) / (Decimal(2) ** (shift + 1))


def eigenvalues(polynomial: Polynomial) -> list[tuple[Decimal, int]]:
    """Positive roots, the largest first, with their multiplicities."""
    zeros = next(i for i, c in enumerate(polynomial) if c)
    found = [(narrowed(a, *place), times) for a, times in factors(polynomial[zeros:]) for place in isolated(a)]
    return sorted(found, reverse=True)


# Components


def null_space(m: list[list[int]], root: Decimal, times: int, digits: int = DIGITS) -> list[list[float]]:
    """``times`` orthonormal vectors v with m v = root v: inverse iteration with decimals."""
    n = len(m)
    with localcontext() as context:
        context.prec = 2 * digits
        # A little beside the root: a solution grows by ``digits`` digits and has as many left for directions inside the null space.
        root = root * (1 + Decimal(10) ** -digits)
        a = [[Decimal(v) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)]
        least = max(abs(v) for row in a for v in row) * Decimal(10) ** (-2 * digits) or Decimal(1)
        order = []
        for k in range(n):  # triangular factors, rows exchanged for the largest pivot
            at = max(range(k, n), key=lambda i: abs(a[i][k]))
            a[k], a[at] = a[at], a[k]
            order.append(at)
            if abs(a[k][k]) < least:
                a[k][k] = least
            for i in range(k + 1, n):
                f = a[i][k] / a[k][k]
                a[i][k] = f
                if f:
                    own, pivot = a[i], a[k]
                    for j in range(k + 1, n):
                        own[j] -= f * pivot[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            b = list(b)
            for k in range(n):
                b[k], b[order[k]] = b[order[k]], b[k]
            for i in range(n):
                b[i] -= sum(a[i][j] * b[j] for j in range(i))
            for i in range(n - 1, -1, -1):
                b[i] = (b[i] - sum(a[i][j] * b[j] for j in range(i + 1, n))) / a[i][i]
            return b

        out: list[list[Decimal]] = []
        starts = np.random.Generator(np.random.PCG64(1)).integers(1, 1_000_000, (times, n)).tolist()
        for start in starts:
            v = list(map(Decimal, start))
            for _ in range(3):
                v = solved(v)
                for _ in range(2):
                    for u in out:
                        dot = sum(x * y for x, y in zip(u, v, strict=True))
                        v = [y - dot * x for x, y in zip(u, v, strict=True)]
                    size = sum(x * x for x in v).sqrt()
                    v = [x / size for x in v]
            out.append(v)
        return [[float(x) for x in v] for v in out]


def eigenvectors(spark: SparkSession, m: list[list[int]], roots: list[tuple[Decimal, int]]) -> list[list[float]]:
    """Unit eigenvectors in the order of the roots; every root is a task's own work."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, root, times in zip(b["i"], b["root"], b["times"], strict=True):
                yield pd.DataFrame({"i": int(i), "v": null_space(m, Decimal(root), int(times))})

    if not roots:
        return []
    table = spark.createDataFrame([(i, str(root), times) for i, (root, times) in enumerate(roots)], "i int, root string, times int").repartition(len(roots))
    found: dict[int, list[list[float]]] = {}
    for r in table.mapInPandas(run, "i int, v array<double>").collect():  # a vector a component
        found.setdefault(r.i, []).append(list(r.v))
    return [v for i in range(len(roots)) for v in found[i]]


# Whitening


def whitener(n: int, sums: list[int], components: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, list[int | None]]]:
    """Function of y: whitened rows and exact deviations (None beyond a long)."""

    def run(y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        fits = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums)) < 1 << 62
        centred = n * (y if fits else y.astype(object)) - (np.array(sums, np.int64) if fits else np.array(sums, object))
        top = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
        squares = centred if top * top * centred.shape[1] < 1 << 62 else centred.astype(object)
        deviation = [int(v) if v < 1 << 63 else None for v in (squares * squares).sum(axis=1)]
        return (centred.astype(np.float64) / n) @ components.T / scale, deviation

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of the usable rows of ``rows(vec_id, embedding)``."""
    spark = rows.sparkSession
    vectors = cut(whole_vectors(rows), "vectors")
    common = vectors.groupBy(F.size("y").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dims = common.dims
    vectors = vectors.filter(F.size("y") == dims)
    n, sums, m = scatter(vectors, dims)
    found = eigenvalues(characteristic_polynomial(spark, m)) if any(m[i][i] for i in range(dims)) else []
    roots: list[tuple[Decimal, int]] = []
    for root in found:
        if sum(times for _, times in roots) < components:
            roots.append(root)
    each = [root for root, times in roots for _ in range(times)][:components]
    if not each:
        return spark.createDataFrame([], SCHEMA)
    basis = np.array(eigenvectors(spark, m, roots)[: len(each)])
    trace = sum(m[i][i] for i in range(dims))
    explained = [float(root / trace) for root in each]
    scale = np.array([float(root.sqrt() / n) for root in each])  # roots of the covariance are those of M over n**2
    apply = whitener(n, sums, basis, scale)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                w, deviation = apply(matrix(part["y"]))
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "no_id": part["no_id"].to_numpy(), "deviation": pd.array(deviation, "Int64"), "w": list(w)})

    whitened = cut(vectors.mapInPandas(run, "vec_id long, no_id boolean, deviation long, w array<double>"), "whitened")
    error = identity_error(whitened, n, len(each))
    shares = F.array(*[F.lit(e) for e in explained])
    out = whitened.select(F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity; means first, then centred products."""
    means = {r.at: r.m for r in whitened.select(F.posexplode("w").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).collect()}  # k rows
    mean = np.array([means[i] for i in range(k)])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            if len(b):
                w = np.stack(b["w"].to_numpy()) - mean
                total += w.T @ w
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = whitened.select("w").mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return float(sums.select(F.max(F.abs(F.col("v") / n - (F.col("i") == F.col("j")).cast("double")))).first()[0])
