"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from shopfront.llm import hilbert


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (6, 2)])
def test_curve_steps_to_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def exact(vectors, every, k):
    ids = sorted(vectors)
    out = {}
    for q in ids:
        if q % every == 0:
            scored = sorted((-math.fsum(a * b for a, b in zip(vectors[q], vectors[v])), v) for v in ids if v != q)
            out[q] = [(rank, v, -s) for rank, (s, v) in enumerate(scored[:k], 1)]
    return {q: rows for q, rows in out.items() if rows}


def searched(table, every, k):
    out = {}
    for r in hilbert.search(table, every, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_evenly_spread_vectors_are_found_exactly(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hilbert, "QUERIES_A_TASK", 16)
    made = np.random.default_rng(1).standard_normal((400, 32)).astype(np.float32)
    made[50:60] = made[50]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    assert searched(table(spark, rows), 5, 7) == exact({i: v for i, v, _ in rows}, 5, 7)


def test_clustered_vectors_are_found_in_windows(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((400, 4))
    made = np.repeat(centers, 15, axis=0) + 0.02 * rng.standard_normal((6000, 4))
    made = np.hstack([made, 0.02 * rng.standard_normal((6000, 4))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    got, true = searched(table(spark, rows), 100, 10), exact({i: v for i, v, _ in rows}, 100, 10)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))


def test_small_clustered_tables_are_searched_in_windows_of_all_curves(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = np.repeat(rng.standard_normal((100, 4)), 20, axis=0) + 0.02 * rng.standard_normal((2000, 4))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(made)]
    found, top = [], hilbert.top
    monkeypatch.setattr(hilbert, "top", lambda table, k: found.append(table) or top(table, k))
    got, true = searched(table(spark, rows), 40, 10), exact({i: v for i, v, _ in rows}, 40, 10)
    assert found[-1].count() > found[-1].distinct().count()  # curves find the same vectors again
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    assert all(len(rows) == 10 for rows in got.values())


def test_large_vectors_that_are_nearly_at_right_angles():
    rng = np.random.default_rng(4)
    queries = rng.standard_normal((20, 64)) * 1e6
    vectors = rng.standard_normal((400, 64)) * 1e6
    vectors -= (vectors @ queries[0])[:, None] * queries[0] / (queries[0] @ queries[0])  # scores are rounding alone
    ids = np.arange(100, 500)
    got = hilbert.best(queries, np.arange(20), vectors, ids, 20)
    for q in range(20):
        scored = sorted((-math.fsum((queries[q] * v).tolist()), i) for v, i in zip(vectors, ids.tolist()))[:20]
        assert [(-s, i) for s, i in scored] == list(got[got.query_id == q][["score", "vec_id"]].itertuples(index=False, name=None))


def test_vectors_whose_products_leave_a_double():
    vectors = np.array([[1e160, 1.0], [1e150, 1.0], [-1e160, 1.0], [1e158, -1e158]])
    got = hilbert.best(vectors[:1], np.array([9]), vectors, np.arange(4), 4)
    assert got.vec_id.tolist() == [0, 1, 3, 2]  # of endless scores the smaller number
    assert got.score.tolist() == [math.inf, math.inf, math.inf, -math.inf]
    small = hilbert.best(vectors[1:2] * 1e-120, np.array([9]), vectors, np.arange(4), 4)
    assert small.vec_id.tolist() == [0, 3, 1, 2] and np.allclose(small.score, [1e190, 1e188, 1e180, -1e190], rtol=1e-15)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 1), (20, [0.0, 0.0], 0), (40, None, 0), (60, [1.0, None], 0), (80, [1.0, float("nan")], 0),
            (100, [float("inf"), 1.0], 0), (120, [3.0, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0], 0), (9, [1.0, 2.0, 3.0], 0), (140, [], 0)]
    assert searched(table(spark, rows), 20, 20) == exact({0: [1, 2], 120: [3, 1], 7: [1, 2]}, 20, 20)
    assert hilbert.search(table(spark, rows[:1])).count() == 0
    assert hilbert.search(table(spark, [])).count() == 0
