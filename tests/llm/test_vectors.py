"""Top-k search, whitening and clustering of vectors against plain Python and a symmetric eigensolver."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import bidiagonal, centroids, exact_topk, whitening
from tallyforge.llm import vectors as V

INF, NAN = float("inf"), float("nan")
COLUMNS = "vec_id long, embedding array<double>, vector string, x int, score string, cluster string, block int, n int"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, v, "clash", 7, "clash", "clash", 7, 7) for i, v in rows], columns)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, factor):
    return [max(-V.LARGEST, min(V.LARGEST, math.floor(x * factor))) for x in v]


@pytest.fixture(scope="module")
def mixed():
    """Vectors in groups, a third of them equal, with odd ones, repeated rows and repeated ids."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + 0.3 * rng.standard_normal(6))]) for i in range(300)]
    rows += [(1000 + i, [0.25, -0.5, 0.125, 1.0, 0.0, -1.0]) for i in range(150)]
    rows += [(100, rows[100][1]), (50, [0.0] * 6), (None, [3.0] * 6), (None, [3.0] * 6)]
    odd = [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2001, [NAN] * 6), (2100, [INF, 0.0, 0.0, 0.0, 0.0, 0.0])]
    return rows + odd


# --- top-k ------------------------------------------------------------------------

def top_k_by_hand(queries, rows, k, factor):
    out = []
    for q, v in queries:
        if q is None or not whole(v):
            continue
        found = []
        for i, w in rows:
            if whole(w) and i != q:
                score = sum(a * b for a, b in zip(floors(v, factor), floors(w, factor)))
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1):
            out.append((q, rank, i, -score if -(1 << 63) <= -score < 1 << 63 else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows_a_block,cell_rows", [(4096, 65536), (16, 40)])
def test_top_k(spark, mixed, monkeypatch, rows_a_block, cell_rows):
    monkeypatch.setattr(exact_topk, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(exact_topk, "CELL_QUERIES", 3 if cell_rows < 100 else 100)
    monkeypatch.setattr(exact_topk.blocks, "__defaults__", (rows_a_block,))
    monkeypatch.setattr(exact_topk, "GROUP", 2)
    queries = [(i, v) for i, v in mixed if i is None or i % 50 == 0]
    found = exact_topk.top_k(frame(spark, queries), frame(spark, mixed), 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert got(found) == top_k_by_hand(queries, mixed, 5, 256)


def test_top_k_of_huge_short_and_empty_vectors(spark):
    rows = [(0, [1e300, -1e300, 1.0]), (50, [1e12, 3.0, 1e-300]), (1, [2.0]), (2, []), (3, [1e15, 1e15, 1e15]), (4, [-1e15] * 3),
            (5, [7.5, 1e9, -3.25])]
    assert got(exact_topk.top_k(frame(spark, rows), frame(spark, rows), 4)) == top_k_by_hand(rows, rows, 4, 256)


def test_top_k_of_few_or_no_rows(spark, mixed):
    one = frame(spark, mixed[:1])
    none = frame(spark, [])
    assert got(exact_topk.top_k(one, one)) == [] == got(exact_topk.top_k(none, none)) == got(exact_topk.top_k(one, none))
    assert len(got(exact_topk.top_k(one, frame(spark, mixed[:3])))) == 2
    assert got(exact_topk.top_k(frame(spark, [(0, None)]), one)) == []


def test_bounds_leave_survivors_only():
    """With one far better row per query the later dimensions of the others are never read."""
    rng = np.random.default_rng(4)
    values = rng.integers(-3, 4, (64, 4000))
    values[:, 7] = 100
    read = []

    class Counted(np.ndarray):
        def take(self, left, axis):
            read.append(len(left))
            return np.asarray(self).take(left, axis)

    best = exact_topk.Best(1, 1)
    query = np.full((1, 64), 50)
    ids, known = np.arange(4000), np.ones(4000, dtype=bool)
    exact_topk.search_block(best, np.array([-1]), query, ids[:10], known[:10], values[:, :10])
    exact_topk.search_block(best, np.array([-1]), query, ids, known, values.view(Counted))
    assert best.rows[0][0][2] == 7
    assert sum(read) < 0.2 * 4000 * 7


# --- whitening --------------------------------------------------------------------

def made(kind: str) -> np.ndarray:
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    if kind == "random":
        return rng.standard_normal((200, 32))
    if kind == "graded":
        return rng.standard_normal((200, 32)) * 10.0 ** -np.arange(32)
    if kind == "equal":
        return turn
    if kind == "clusters":
        return np.diag(np.repeat([5.0, 3, 2, 1], 8) + 1e-10 * rng.standard_normal(32)) @ turn
    if kind == "rank":
        return rng.standard_normal((200, 9)) @ rng.standard_normal((9, 32))
    if kind == "blocks":
        return np.kron(np.eye(4), rng.standard_normal((8, 8)))
    if kind == "constant":
        x = rng.standard_normal((200, 32))
        x[:, 3], x[:, 8] = 0, x[:, 9]
        return x
    return np.zeros((5, 32)) if kind == "zero" else rng.standard_normal((20, 1))


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "clusters", "rank", "blocks", "constant", "zero", "single"])
def test_singular_values_and_vectors(kind):
    x = made(kind)
    values, vectors = bidiagonal.right_vectors(np.linalg.qr(x, mode="r"))
    usual = np.linalg.svd(x, compute_uv=False) ** 2
    usual = np.concatenate([usual, np.zeros(x.shape[1] - len(usual))])
    assert np.allclose(values, usual, rtol=1e-12, atol=1e-12 * max(usual[0], 1e-300))
    assert np.abs(vectors.T @ vectors - np.eye(x.shape[1])).max() < 1e-10
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max() <= 1e-12 * max(usual[0], 1e-300)


@given(st.lists(st.floats(0.1, 10), min_size=2, max_size=12), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_dqds_is_accurate_for_small_values_too(diagonal, seed):
    """Products of random bidiagonals of any grade, against the values of their inverse."""
    rng = np.random.default_rng(seed)
    a = np.array(diagonal) * 10.0 ** -rng.integers(0, 6, len(diagonal))
    b = rng.standard_normal(len(a) - 1) * a[1:]
    found = bidiagonal.squared_values(a, b)
    full = np.diag(a) + np.diag(b, 1)
    assert np.allclose(found[0], np.linalg.svd(full, compute_uv=False)[0] ** 2, rtol=1e-12)
    assert np.isclose(np.prod(found / a ** 2), 1.0, rtol=1e-9)          # the determinant
    assert np.allclose(1 / found[-1], np.linalg.svd(np.linalg.inv(full), compute_uv=False)[0] ** 2, rtol=1e-8)


def test_whitening(spark, mixed):
    rows = [(i, v) for i, v in mixed if whole(v)]
    x = np.array([floors(v, 64) for _, v in rows], dtype=object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    centred = d.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    found = whitening.components_of(frame(spark, mixed).repartition(70), components=4)
    got_rows = found.collect()
    assert len(got_rows) == n * 4 and {r["n"] for r in got_rows} == {n}
    assert all(r["identity_error"] < 1e-9 for r in got_rows)
    explained = {r["component"]: r["explained"] for r in got_rows}
    assert np.allclose([explained[c] for c in (1, 2, 3, 4)], e[:4] / e.sum(), rtol=1e-12)
    usual = {}
    for (i, _), dev, w in zip(rows, (d * d).sum(axis=1), centred @ (v / np.sqrt(e))):
        usual.setdefault((i, int(dev)), w)
    by_row: dict = {}
    for r in got_rows:
        by_row.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    assert by_row.keys() == usual.keys()
    signs = None
    for key, w in usual.items():
        mine = np.array([by_row[key][c] for c in (1, 2, 3, 4)])
        if signs is None and np.abs(w[:4]).min() > 1e-3:
            signs = np.sign(mine * w[:4])
    for key, w in usual.items():
        assert np.allclose([by_row[key][c] for c in (1, 2, 3, 4)], w[:4] * signs, atol=1e-9)


def test_whitening_without_variance(spark):
    assert whitening.components_of(frame(spark, [])).count() == 0
    assert whitening.components_of(frame(spark, [(1, None), (2, [NAN])])).count() == 0
    assert whitening.components_of(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # a constant and a dependent dimension: two of four components exist; shorter vectors end in zeros
    rows = frame(spark, [(1, [1.0, 5.0, 2.0, 2.0]), (2, [2.0, 5.0, 1.0, 1.0]), (3, [4.0, 5.0, 7.0, 7.0]), (4, [0.0, 5.0])])
    found = whitening.components_of(rows).collect()
    assert sorted((r["vec_id"], r["component"]) for r in found) == [(i, c) for i in (1, 2, 3, 4) for c in (1, 2)]
    assert max(r["identity_error"] for r in found) < 1e-12


def test_whitening_of_huge_values(spark):
    found = whitening.components_of(frame(spark, [(1, [1e200, 1.0]), (2, [-1e200, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and all(r["deviation"] is None for r in found if r["vec_id"] != 3)


# --- clusters ---------------------------------------------------------------------

def clusters_by_hand(rows, k, rounds, factor, dims):
    kept = [(i, floors(v, factor), v) for i, v in rows if whole(v) and len(v) == dims]
    hashed = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashed(r[0]), r[2]))
    centres = [x for _, x, _ in order[:k]]

    def assigned():
        out = []
        for _, x, _ in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)))
        return out

    for _ in range(rounds):
        found = assigned()
        for j in range(len(centres)):
            mine = [x for (_, x, _), (_, c) in zip(kept, found) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assigned()
    fits = lambda v: v if v < 1 << 63 else None
    per = [sum(d for d, c in found if c == j) for j in range(len(centres))]
    return sorted(((i, c, fits(d), fits(per[c]), fits(sum(per)), centroids.digest(centres[c])) for (i, _, _), (d, c) in zip(kept, found)), key=str)


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_clusters(spark, mixed, leading):
    rows = mixed + [(7000, [1.0] * 5), (7001, [1.0] * 7), (7002, [])]
    found = centroids.inertias(*centroids.cluster(frame(spark, rows), k=8, rounds=4, dims=6, leading=leading))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(found) == clusters_by_hand(rows, 8, 4, 1024, 6)


def test_few_no_and_huge_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, [1e200, 0.0]), (2, [-1e200, 3.0]), (3, [0.5, -1e13]), (4, [0.0, 0.0])]):
        found = centroids.inertias(*centroids.cluster(frame(spark, rows), k=3, rounds=2, dims=2))
        assert got(found) == clusters_by_hand(rows, 3, 2, 1024, 2)


def test_most_distances_are_never_measured():
    rng = np.random.default_rng(9)
    centres = rng.integers(-400, 400, (8, 64))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 64))
    mean = x.mean(axis=0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :16]
    rotation = centroids.Rotation(mean, axes)
    found, distance, measured = centroids.nearest(x, *rotation.kept(x), centres.tolist(), rotation)
    full = ((x[:, None, :] - centres) ** 2).sum(axis=2)
    assert (found == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 1.1 * len(x)
