"""Whitening and clustering against brute force in exact whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from shopfront.llm import bidiagonal, pivot_clusters, whitening

SCHEMA = "vec_id bigint, embedding array<double>, VEC_ID string, cluster string"


@pytest.fixture(scope="module")
def table(spark):
    def made(rows):
        """Extra columns clash with ids and results."""
        spark.conf.set("spark.sql.caseSensitive", "true")
        out = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
        spark.conf.set("spark.sql.caseSensitive", "false")
        return out

    return made


def test_singular_values_and_vectors_of_many_kinds():
    rng = np.random.default_rng(0)
    turned, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    other, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    kinds = [rng.standard_normal((n, n)) for n in (1, 2, 3, 7, 40)]
    kinds += [np.eye(6), np.diag([3.0, 3, 3, 2, 1, 1]), np.outer(np.arange(1, 6), np.ones(5)), 1e100 * rng.standard_normal((9, 9))]
    kinds += [turned * np.sqrt([1, 1 - 1e-9, 1 - 2e-9, 1 - 1e-5, 1 - 1e-5, *np.linspace(0.9, 0, 15)]) @ other.T]
    kinds += [rng.standard_normal((20, 3)) @ rng.standard_normal((3, 20)), np.diag(10.0 ** -np.arange(12)) @ turned[:12, :12]]
    for matrix in kinds:
        matrix = matrix / np.abs(matrix).max()
        true = np.linalg.svd(matrix, compute_uv=False)
        diagonal, above, right = bidiagonal.bidiagonal(matrix)
        assert np.allclose(right @ right.T, np.eye(len(right)), atol=1e-13)
        all_values = np.sort(np.sqrt(bidiagonal.squared_values(diagonal, above)))[::-1]
        assert np.abs(all_values - true).max() < 1e-14 * len(true) * true[0]
        squares, vectors = bidiagonal.right_vectors(matrix, 4)
        assert len(squares) == min(4, int((true > 1e-13 * true[0]).sum()))
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        for value, vector in zip(squares, vectors):
            assert np.abs(matrix.T @ (matrix @ vector) - value * vector).max() < 1e-13 * true[0] ** 2
    assert len(bidiagonal.right_vectors(np.zeros((4, 4)), 4)[0]) == 0


def test_small_singular_values_keep_their_digits():
    diagonal, above = 10.0 ** -np.arange(0, 30, 3.0), 0.5 * 10.0 ** -np.arange(1, 28, 3.0)
    got = sorted(bidiagonal.squared_values(diagonal, above))
    # the product of all is the product of the diagonal's squares, to nearly all digits
    assert math.isclose(math.prod(got), math.prod(diagonal**2), rel_tol=1e-13)


def whitened(frame, **options):
    return sorted(map(tuple, whitening.whiten(frame, **options).collect()), key=repr)


def brute_whitening(rows):
    """Rows without null, in exact whole numbers as far as they go, then numpy's eigenvectors."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = [list(v) for v in sorted({tuple(v) for _, v in kept})]
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - t) / n for c, t in zip(v, total)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, v in kept:
        apart = [n * c - t for c, t in zip(v, total)]
        for at in range(1, min(4, len(total)) + 1):
            white = float(np.array(apart) / n @ vectors[:, -at]) / math.sqrt(values[-at])
            out.append((i, at, n, sum(a * a for a in apart), abs(white), values[-at] / values.sum()))
    return out


def test_whitening_equals_eigenvectors(table):
    rng = np.random.default_rng(5)
    made = rng.standard_normal((700, 12)) * np.linspace(2, 0.5, 12) + 3
    made[100:400] = made[7]  # a vector that holds nearly half of all rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(made)]
    got = whitening.whiten(table(rows).repartition(5)).collect()
    true = sorted(brute_whitening(rows), key=lambda r: r[:2])
    assert len(got) == len(true)
    for r, t in zip(sorted(got, key=lambda r: (r.vec_id, r.component)), true):
        assert (r.vec_id, r.component, r.n, r.deviation) == t[:4]
        assert abs(abs(r.whitened) - t[4]) < 1e-9 and math.isclose(r.explained, t[5], rel_tol=1e-10)
        assert r.identity_error < 1e-10
    white = np.array([[r.whitened for r in got if r.component == c] for c in (1, 2)])
    assert white.shape == (2, 700)


def test_whitening_folds_many_triangles(table, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).standard_normal((300, 3)))]
    got = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(table(rows).repartition(7)).collect()}
    for i, at, _, _, white, _ in brute_whitening(rows):
        assert abs(got[i, at] - white) < 1e-9


def test_awkward_vectors_for_whitening(table):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (None, [4.0, 4.5]), (3, None), (4, [1.0, None]), (5, [1.0, math.nan]),
            (6, [math.inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0]), (10, [-0.0, 0.0])]
    kept = [(i, v) for i, v in rows if i in (1, 2, 10) or i is None]
    got = whitened(table(rows))
    true = sorted(brute_whitening(kept), key=repr)
    assert len(got) == len(true) == 10
    for r, t in zip(sorted(got, key=lambda r: repr(r[:4])), sorted(true, key=lambda r: repr(r[:4]))):
        assert r[:4] == t[:4] and abs(abs(r[4]) - t[4]) < 1e-9
    assert whitened(table([])) == [] == whitened(table(rows[:2])) == whitened(table([(1, None)]))
    line = whitened(table([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]))
    assert {r[1] for r in line} == {1}  # other directions have no variance
    far = [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [1e6, 5.0])]
    true = {i: d for i, _, _, d, _, _ in brute_whitening(far)}
    assert {r[0]: r[3] for r in whitened(table(far))} == {i: d if d < 2**63 else None for i, d in true.items()}


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    total = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    return [(i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
            for (i, _), (d, n) in zip(kept, near)]


def clustered(frame, **options):
    return sorted(map(tuple, pivot_clusters.cluster(frame, **options).collect()), key=repr)


def test_clusters_equal_brute_force(table):
    rng = np.random.default_rng(8)
    made = np.repeat(rng.standard_normal((9, 5)) * 3, 40, axis=0) + rng.standard_normal((360, 5)) * 0.3
    made[100:220] = made[50]
    rows = [(int(i), v.tolist()) for i, v in enumerate(made)]
    got = clustered(table(rows).repartition(6), k=7, rounds=3, dimensions=5)
    assert got == sorted(brute_clusters(rows, 7, 3), key=repr)


def test_bounds_spare_exact_distances_and_lose_none():
    rng = np.random.default_rng(9)
    vectors = np.floor(np.repeat(rng.standard_normal((12, 8)) * 300, 50, axis=0) + rng.standard_normal((600, 8)) * 9).astype(np.int64)
    centroids = vectors[::50].copy()
    centroids[3] = centroids[9]  # a tie for the smaller number
    pivots = pivot_clusters.choose_pivots(vectors[::7], 8)
    numbers, apart, measured = pivot_clusters.nearest(
        vectors, pivot_clusters.spans(vectors, pivots), centroids, pivot_clusters.spans(centroids, pivots)
    )
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (numbers == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()
    assert measured < 0.3 * every.size


def test_awkward_vectors_for_clusters(table):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.0, 2.0]), (2, [0.5, -1.0]), (None, [4.0, 4.5]), (3, None), (4, [1.0, None]),
            (5, [1.0, math.nan]), (6, [math.inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0]), (10, [-0.0, -0.001])]
    kept = [(i, v) for i, v in rows if i in (1, 2, 10) or i is None]
    for k in (2, 16):
        assert clustered(table(rows), k=k, dimensions=2) == sorted(brute_clusters(kept, k, 3), key=repr)
    assert clustered(table([])) == [] == clustered(table([(1, [1.0])]))
    far = clustered(table([(1, [2.0**21, 0.0]), (2, [-(2.0**21), 0.0])]), k=1, rounds=0, dimensions=2)
    assert sorted(r[2] for r in far) == [0, 2**56]
