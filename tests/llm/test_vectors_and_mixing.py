"""Whitening, centroids and source mixing against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictpast.llm import centroids, mixing, whitening

VECTORS = "vec_id long, embedding array<double>"


# --- whitening --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_leading_pairs(n):
    r = np.random.default_rng(n)
    cases = [r.standard_normal((n, n)), np.diag(np.arange(n) + 1.0), np.eye(n), np.ones((n, n)), np.zeros((n, n)), 1e-9 * r.standard_normal((n, n))]
    cases.append(np.diag([3.0] * (n - n // 2) + [1.0] * (n // 2)))  # repeated eigenvalues
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    cases.append(q * np.where(np.arange(n) % 2, 5.0, 5.0 - 1e-12) @ q.T)  # all but equal ones
    for a in cases:
        a = (a + a.T) / 2
        values, vectors = whitening.leading_pairs(a, 4)
        size = np.abs(a).max() * n + 1e-300
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:4]).max() <= 1e-13 * size
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 1e-13 * size


def brute_whiten(rows, k=4):
    """By NumPy's eigenvectors; signs are taken from the caller."""
    kept = [(i, np.array([math.floor(256 * c) for c in v], object)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in kept if len(x)}:
        mine = [(i, x) for i, x in kept if len(x) == d]
        fit = [np.array(x, object) for x in {tuple(x) for _, x in mine}]
        n, s = len(fit), sum(fit)
        c = np.array([(x * n - s).astype(float) / n for x in fit])
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = e[::-1], u[:, ::-1]
        for i, x in mine:
            y = (x * n - s).astype(float) / n
            for j in range(min(k, d)):
                out.append((i, j + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), y @ u[:, j] / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(5)
    wide = r.standard_normal((120, 6)) * [9, 5, 3, 2, 1, 0.5] + [1e4, 0, -3, 7, 0, 0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(wide)]
    rows += [(i + 500, v) for i, v in rows[:40]] * 3 + [(900 + i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((30, 2)))]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [math.nan] * 6), (1003, [math.inf] + [0.0] * 5), (1004, []), (None, rows[3][1]), (0, rows[5][1])]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(5).withColumn("component", F.lit("x")).withColumn("key", F.lit(1)).withColumn("d", F.lit(2))
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    got = sorted(got.collect(), key=lambda x: (x.vec_id is None, x.vec_id or 0, x.component, x.deviation))
    want = sorted(brute_whiten(rows + odd), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[3]))
    assert [tuple(g[:4]) for g in got] == [w[:4] for w in want]
    signs = {}
    for g, w in zip(got, want):
        assert g.whitened**2 == pytest.approx(w[4] ** 2, rel=1e-8, abs=1e-10) and g.explained == pytest.approx(w[5], rel=1e-9)
        if abs(w[4]) > 1e-6:
            signs.setdefault((g.n, g.component), set()).add(g.whitened * w[4] > 0)
        assert g.identity_error < 1e-10 and g.deviation_exact == str(g.deviation)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (2, [0.5, 2.0])], VECTORS)).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], VECTORS)).collect()
    assert len(line) == 27 and {r.component for r in line if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-12 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], VECTORS)).collect()
    assert len(huge) == 6 and all(r.deviation is None and int(r.deviation_exact) > 2**100 for r in huge if r.vec_id < 3)


def test_whitening_of_long_vectors(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((40, 300)))]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    want = {(i, j): w for i, j, _, _, w, _ in brute_whiten(rows)}
    assert all(abs(abs(g.whitened) - abs(want[g.vec_id, g.component])) < 1e-9 and g.identity_error < 1e-10 for g in got)


# --- centroids --------------------------------------------------------------------------


def brute_clusters(rows, d, k, rounds, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), w in zip(kept, who) if w == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((str(i), near(v)[1], near(v)[0] if near(v)[0] < 2**63 else None) for i, v in kept), key=str), centres


@pytest.mark.parametrize("k,spread", [(8, 3.0), (40, 0.02), (3, 1e7)])
def test_clusters_equal_brute_force(spark, k, spread):
    r = np.random.default_rng(k)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.round(r.standard_normal((260, 5)) * spread, 2))]
    rows += [(i, rows[0][1]) for i in range(300, 380)] + [(7, rows[9][1])] * 3
    odd = [(1000, None), (1001, [1.0] * 4), (1002, [1.0, 2.0, None, 4.0, 5.0]), (1003, [math.nan] * 5), (None, [0.0] * 5), (1004, [])]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(4).withColumn("cluster", F.lit("x")).withColumn("x", F.lit(0))
    got, centres = centroids.fit_clusters(df, d=5, k=k, rounds=4)
    want, means = brute_clusters(rows + odd, 5, k, 4)
    assert centres == means
    assert sorted(((str(r.vec_id), r.cluster, r.distance) for r in got.collect()), key=str) == want


def test_tree_search_is_exact_with_ties():
    r = np.random.default_rng(2)
    for k in (1, 2, 3, 9, 60):
        centres = r.integers(-3, 4, (k, 3)).tolist()
        x = r.integers(-5, 6, (500, 3))
        who, exact = centroids.nearest(x, centres, centroids.build(centres))
        far = ((x[:, None] - np.array(centres)) ** 2).sum(axis=2)
        assert (who == far.argmin(axis=1)).all() and (exact == far.min(axis=1)).all()
    edge = np.array([[2**63 - 1, -(2**63)], [0, 0]])
    who, exact = centroids.nearest(edge, [[0, 0], [2**63 - 1, 0]], centroids.build([[0, 0], [2**63 - 1, 0]]))
    assert who.tolist() == [1, 0] and exact.tolist() == [2**126, 0]


def test_inertia_and_few_vectors(spark):
    none, centres = centroids.fit_clusters(spark.createDataFrame([], VECTORS))
    assert centres == [] and centroids.with_inertia(none, centres).count() == 0
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1e300, 0.0])]
    got = centroids.with_inertia(*centroids.fit_clusters(spark.createDataFrame(rows[:2], VECTORS), d=2, scale=1)).collect()
    assert {(r.distance, r.cluster_inertia, r.inertia) for r in got} == {(0, 0, 0)}
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in ("0,0", "3,4")}
    far = centroids.with_inertia(*centroids.fit_clusters(spark.createDataFrame(rows, VECTORS), d=2, scale=1, k=1, rounds=0))
    assert {r.inertia for r in far.collect()} == {None}


# --- mixing -----------------------------------------------------------------------------


def brute_targets(sizes, cycle=(1, 2, 3), epochs=3):
    """Shares by weight; what is above a cap is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in cut]
        left, shared = total - sum(epochs * sizes[s] for s in cut), sum(weight[s] for s in rest)
        target = {s: float(epochs * sizes[s]) if s in cut else left * weight[s] / shared for s in names}
        above = {s for s in rest if target[s] > epochs * sizes[s] + 1e-9}
        if not above:
            return target
        cut |= above


DOCS = "doc_id long, text string, source string"


def documents(seed=1, n=400):
    r = np.random.default_rng(seed)
    names = [None, "", "a", "b", "é", "z", "😀", "hot", "tiny", "void"]
    rows = []
    for i in range(n):
        source = names[r.integers(0, 8)] if r.random() > 0.4 else "hot"
        rows.append((i, " ".join(f"w{x}" for x in r.integers(0, 99, r.integers(0, 60))), source))
    rows += [(n, "one two", "tiny"), (n + 1, None, "void"), (n + 2, " \n\t", "void"), (None, "no key", "a"), (n + 3, "w " * 30000, "b")]
    return rows + [rows[5]] * 4 + [(None, "no key", "a")] * 2


def test_mix_meets_targets(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("target", F.lit(2))
    got = mixing.mix_sources(df).collect()
    sizes, count = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    target = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    by_numbers = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_numbers.setdefault((r.source_size, r.target), []).append(r)
    want = {}
    for s in sizes:
        want.setdefault((sizes[s], pytest.approx(target[s]).expected), []).append(s)
    assert len(by_numbers) == len(want)
    for (size, t), names in want.items():
        mine = next(v for (a, b), v in by_numbers.items() if a == size and b == pytest.approx(t))
        assert sum(r.taken for r in mine) == math.floor(mine[0].target + 0.5) * len(names)
        epochs = math.floor(t + 0.5) // size if size else 0
        partial = [r for r in mine if epochs * r.size < r.taken < (epochs + 1) * r.size]
        assert len(partial) <= len(names) and all(r.taken >= epochs * r.size for r in mine)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_prefers_quality(spark):
    rows = [(i, "five words are in here", "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    quality = spark.createDataFrame([(i, w) for i in range(3000) for w in ([9.0, 1.0] if i < 1000 else [0.0] if i < 1200 else [None])], "doc_id long, weight double")
    got = mixing.mix_sources(df, quality=quality).where("source_size = 5000 and target < 5000").collect()
    share = lambda lo, hi: np.mean([r.taken > 0 for r in got if lo <= r.doc_id < hi])
    assert share(0, 1000) > 0.75 and share(1000, 1200) == 0 and share(0, 1000) > 2 * share(1200, 3000) > 0


def test_mix_of_small_tables(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], DOCS)).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in empty} == {(0, 0, 0.0, 0)}
    one = mixing.mix_sources(spark.createDataFrame([(1, "a b c", None)], DOCS)).collect()
    assert [(r.source_size, r.target, r.taken) for r in one] == [(3, 3.0, 3)]
