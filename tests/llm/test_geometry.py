"""Clustering, SimHash and whitening against brute force.

The small tables hold nulls, empty and repeated rows, ties, odd lengths and clashing extra columns.
"""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from quarry.llm import clustering, queries, simhash, whitening
from quarry.session import table

VECTORS = "vec_id long, embedding array<float>, label int, x string, near long, cluster string, n string, y int, w int"
EXTRA = (1, "x", 2, "c", "n", 3, 4)


def plain_kept(rows, dims=None):
    usable = [(i, e) for i, e in rows if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    return [(i, e) for i, e in usable if dims is None or len(e) == dims]


@pytest.fixture(scope="module")
def vectors(spark):
    """200 vectors of 64 components, copies, a repeated row and id, null ids, and rows that are not usable."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=64) * 0.2]) for i in range(200)]
    rows += [(500 + i, rows[5][1]) for i in range(60)] + [rows[7], (8, rows[9][1]), (None, rows[10][1]), (None, rows[11][1]), (2**60 + 1, rows[12][1])]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.5] * 63), (904, [float("nan")] + [0.5] * 63), (905, [float("inf")] + [0.5] * 63), (906, [0.5] * 65)]
    return rows, spark.createDataFrame([(i, e, *EXTRA) for i, e in rows + odd], VECTORS)


# Clustering


def plain_clusters(rows, k=40, rounds=5):
    """(vec_id, cluster, distance, final centroids) by measuring everything with Python integers."""
    rows = [(i, [math.floor(256 * c) for c in e]) for i, e in plain_kept(rows, 64)]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))
    centroids = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in rows]

    for _ in range(rounds):
        placed = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, at) in zip(rows, placed, strict=True) if at == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(rows, assign(), strict=True)], centroids


def check_clusters(got, rows):
    want, centroids = plain_clusters(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == total
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_brute_force(spark, vectors):
    rows, df = vectors
    check_clusters(clustering.cluster_vectors(df.repartition(5)).collect(), rows)


def test_clusters_of_few_and_of_no_vectors(spark, vectors):
    rows, df = vectors
    check_clusters(clustering.cluster_vectors(df.filter("vec_id < 9")).collect(), [r for r in rows if r[0] is not None and r[0] < 9])
    none = clustering.cluster_vectors(df.filter("vec_id between 900 and 910"))
    assert none.columns == [c.split()[0] for c in clustering.SCHEMA.split(", ")] and none.count() == 0


def test_ptolemaic_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (40, 64))
    x = (middles[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 64))).astype(np.int64)
    pivots = np.concatenate([middles[:39], middles[:1]])  # two equal pivots
    centroids = pivots + rng.integers(-60, 60, pivots.shape)
    centroids[7] = centroids[3]  # a tie
    known, near = clustering.Pivots(pivots, centroids), clustering.squared(x, pivots)
    exact = clustering.squared(x, centroids)
    assert (known.bounds(near) <= np.sqrt(exact.astype(float))).all()
    cluster, distance, measured = known.nearest(x, near)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert not (cluster == 7).any() and measured < 0.1 * exact.size


# SimHash


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits=3):
    """Smallest place of each place's component, by comparing all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def check_simhash(got, rows):
    got = {(r.doc_id, r.fingerprint): r for r in got}
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(prints)
    for (doc_id, _), p, g in zip(rows, prints, groups, strict=True):
        r = got[doc_id, f"{p:016x}"]
        assert r.component_id == min((i for (i, _), own in zip(rows, groups, strict=True) if own == g and i is not None), default=None)
        assert r.class_id == min((i for (i, _), own in zip(rows, prints, strict=True) if own == p and i is not None), default=None)


def test_simhash_brute_force(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    check_simhash(got, rows)


def test_simhash_awkward_rows(spark):
    long_text = " ".join(f"w{i % 700}" for i in range(6000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one two three"), (6, long_text), (7, long_text + " tail"), (6, long_text),
        (None, "no id here at all"), (None, None), (9, "no id here at all"), (10, "word"), (None, "alone without a name or a number"),
    ]
    df = spark.createDataFrame([(i, t, "a", 1, 2, "b", "c") for i, t in rows], "doc_id long, text string, fp string, rows int, comp int, mask_no string, key string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    check_simhash(got, rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_words_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma\n", "delta"], k=500))
    whole = plain_fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        assert simhash.fingerprint(text) % 2**64 == whole


@pytest.mark.parametrize("limit", [None, 20])
def test_pivot_table_loses_no_link(spark, monkeypatch, limit):
    """Chains, balls around centres and a dense group: components of all pairs, also where hot buckets are dealt."""
    if limit:
        monkeypatch.setattr(simhash, "hot_limit", lambda n: limit)
    rng = random.Random(2)
    flip = lambda v, k: v ^ sum(1 << b for b in rng.sample(range(64), k))
    prints = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(prints)[:6]:
        prints |= {flip(centre, rng.randint(1, 7)) for _ in range(60)}  # a ball with links inside and outside its hub's reach
    at = rng.getrandbits(64)
    for _ in range(30):
        at = flip(at, 3)
        prints.add(at)
    prints |= {p ^ 0b111 for p in list(prints)[:20]} | {p ^ 0b1111 for p in list(prints)[:20]} | {0, 2**64 - 1, 1 << 63}
    prints = sorted(prints)
    nodes = simhash.pivot_table(spark.createDataFrame([(simhash.signed(p), i + 1) for i, p in enumerate(prints)], "fp long, rows long"))
    edges, label = simhash.links(nodes.select("fp", "rows", "near"))
    assert all((r.a % 2**64 ^ r.b % 2**64).bit_count() <= 3 for r in edges.collect())
    comp = {r.id: r.comp for r in label.collect()}
    own = [comp.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    groups = plain_groups(prints)
    assert len(set(zip(own, groups, strict=True))) == len(set(own)) == len(set(groups))


def rows_of(spark, node, since=-1):
    """(rows that nodes of this name made in the executions after a number, the last execution's number)."""
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        if run <= since:
            continue
        last, made, nodes = max(last, run), store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            own = nodes.apply(k)
            for m in range(own.metrics().size()) if own.name() == node else ():
                metric = own.metrics().apply(m)
                value = made.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    total += int(value.get().replace(",", ""))
    return total, last


def test_open_fingerprints_are_keyed_once(spark):
    """A ball whose members are in many large buckets: its rows are dealt out by fingerprint, not by fingerprint and bucket."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(26), rng.randint(3, 9))) for _ in range(300)})
    nodes = simhash.pivot_table(spark.createDataFrame([(simhash.signed(p), i + 1) for i, p in enumerate(prints)], "fp long, rows long")).localCheckpoint()
    _, before = rows_of(spark, "Generate")
    _, label = simhash.links(nodes.select("fp", "rows", "near"))
    comp = {r.id: r.comp for r in label.collect()}
    own, groups = [comp.get(simhash.signed(p), simhash.signed(p)) for p in prints], plain_groups(prints)
    assert len(set(groups)) > 1 and len(set(zip(own, groups, strict=True))) == len(set(own)) == len(set(groups))
    made, _ = rows_of(spark, "Generate", before)
    assert 0 < made < 120 * len(prints)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.block_count(n) for n in (10, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]
    masks = simhash.choices(list(range(64)), 5, 3)
    assert len(masks) == 10 and all(24 <= m.bit_count() <= 26 for m in masks)


# Whitening


def plain_whitening(rows, k=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(own, sums, strict=True)) for own in x]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(own, sums, strict=True)] for own in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_brute_force(spark, vectors):
    rows, df = vectors
    rows = [r for r in rows if r[0] is not None and r[0] < 2**60 and r != rows[7]] + [(300, rows[7][1])]
    rows = list({i: (i, e) for i, e in rows}.values())
    given = spark.createDataFrame([(i, e, *EXTRA) for i, e in rows], VECTORS).union(df.filter("vec_id between 900 and 906"))
    got = whitening.whiten(given.repartition(4)).orderBy("vec_id", "component").collect()
    n, deviation, want, explained = plain_whitening(sorted(rows))
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::32]] == deviation
    own = np.array([r.whitened for r in got]).reshape(n, 32)
    signs = np.sign((own * want).sum(axis=0))
    assert np.abs(own * signs - want).max() < 1e-9
    assert np.allclose([r.explained for r in got[:32]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert abs(np.abs(np.cov(own.T, bias=True) - np.eye(32)).max() - got[0].identity_error) < 1e-12


def test_whitening_awkward_tables(spark, vectors):
    _, df = vectors
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 5")).count() == 0  # one vector
    few = spark.createDataFrame([(1, [1.0, 0.0, 3.0]), (None, [2.0, 0.0, 1.0]), (2**60 + 1, [4.0, 0.0, 0.5]), (1, [1.0, 0.0, 3.0]), (7, [1.0, 2.0]), (8, None)], "vec_id long, embedding array<double>")
    got = whitening.whiten(few).collect()
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 8  # a constant dimension has no component
    assert {r.vec_id for r in got} == {1, None, 2**60 + 1} and {r.n for r in got} == {4}
    huge = whitening.whiten(spark.createDataFrame([(i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 10 and {r.deviation for r in huge} == {None}


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-9, 9, (30, 7))
    m = [[int(v) for v in row] for row in a.T @ a]
    p = whitening.characteristic_polynomial(spark, m)

    def minor(rows):  # determinant by fractions
        x, out = [[Fraction(v) for v in row] for row in rows], Fraction(1)
        for k in range(len(x)):
            at = next((i for i in range(k, len(x)) if x[i][k]), None)
            if at is None:
                return 0
            if at != k:
                x[k], x[at], out = x[at], x[k], -out
            out *= x[k][k]
            for i in range(k + 1, len(x)):
                f = x[i][k] / x[k][k]
                x[i] = [u - f * v for u, v in zip(x[i], x[k], strict=True)]
        return out

    for t in range(-3, 6):
        det = minor([[(t if i == j else 0) - v for j, v in enumerate(row)] for i, row in enumerate(m)])
        assert sum(c * t**i for i, c in enumerate(p)) == det


def test_equal_and_zero_eigenvalues():
    # (x - 2)**3 (x - 5) x**2, and a matrix with the roots 4 (twice), 9 (twice) and 0
    p = [1]
    for root in (2, 2, 2, 5, 0, 0):
        p = [(p[i - 1] if i else 0) - root * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]
    assert [(float(r), k) for r, k in whitening.eigenvalues(p)] == [(5.0, 1), (2.0, 3)]
    m = [[4, 0, 0, 0, 0], [0, 4, 0, 0, 0], [0, 0, 9, 0, 0], [0, 0, 0, 9, 0], [0, 0, 0, 0, 0]]
    for root, places in ((4, {0, 1}), (9, {2, 3})):
        v = np.array(whitening.null_space(m, whitening.Decimal(root), 2))
        assert np.allclose(v @ v.T, np.eye(2), atol=1e-15) and set(np.flatnonzero(np.abs(v).max(axis=0) > 1e-12)) == places


def test_modular_polynomial_with_zero_pivots():
    m = [[0, 0, 1, 2], [0, 3, 0, 0], [1, 0, 0, 5], [2, 0, 5, 0]]
    want = [round(c) for c in np.poly(np.array(m, float))[::-1]]
    p = (1 << 31) - 1
    assert whitening.polynomial_mod(m, p) == [c % p for c in want]


def test_prime_test():
    assert [n for n in range(100) if whitening.is_prime(n)] == [n for n in range(2, 100) if all(n % k for k in range(2, n))]


@pytest.mark.parametrize("name", ["op11_centroids", "op12_simhash", "op13_whitening"])
def test_queries_run(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0
