"""Neighbours counted in tiles: the rows that travel do not grow with the blocks of a task."""

import numpy as np
import pytest

from tidewire.operators import clusters, kernels


@pytest.mark.parametrize("rows, tile", [(3072, 32768), (7, 20), (7, 1), (5, 1000)])
def test_counts_are_those_of_all_pairs(spark, rows, tile):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 4)), np.zeros((1, 4))])
    x[7] = x[3]
    points = spark.createDataFrame(
        [(w, i, x[i].tolist()) for w in (1, 2) for i in range(len(x) if w == 1 else 6)], "window bigint, node bigint, embedding array<double>")
    grid = [0.7, 0.1, 1.2]
    got = {(r["window"], r["node"]): r["deg"] for r in clusters.neighbour_counts(points, grid, "cosine", rows, tile).collect()}
    for w, n in ((1, len(x)), (2, 6)):
        d = kernels.distances(x[:n], x[:n], "cosine", same=True)
        assert all(got[w, i] == [(d[i] <= e).sum() for e in grid] for i in range(n))
    assert len(got) == len(x) + 6


def test_points_travel_once_per_tile(spark, monkeypatch):
    """1,000 points in blocks of ten met a hundred blocks each."""
    points = spark.range(1000).selectExpr("0L AS window", "id AS node", "array(1D, CAST(id AS DOUBLE)) AS embedding")
    seen = []
    paired = clusters.pair_blocks
    monkeypatch.setattr(clusters, "pair_blocks", lambda *a: seen.append(paired(*a)) or seen[-1])
    clusters.neighbour_counts(points, [0.5], rows=10)
    assert seen[0].count() == 1000


def test_links_travel_once_per_tile(spark, monkeypatch):
    """So did the points of a clustering, for its links."""
    points = spark.range(1000).selectExpr("0L AS window", "id AS node", "array(1D, CAST(id AS DOUBLE)) AS embedding")
    seen = []
    paired = clusters.pair_blocks
    monkeypatch.setattr(clusters, "pair_blocks", lambda *a: seen.append(paired(*a)) or seen[-1])
    assert clusters.dbscan(points, 0.5, 3, rows=10).count() == 1000
    assert [s.count() for s in seen] == [1000, 1000]


def test_clusters_are_those_of_all_pairs(spark):
    """Chains, borders of two clusters and noise, in one block, in blocks of a tile and over tiles."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.c_[np.arange(30) * 0.9, np.zeros(30)], rng.uniform(0, 20, size=(50, 2)) + [0, 3], np.full((3, 2), 60.0), [[90.0, 0.0]]])
    x = x[rng.permutation(len(x))]
    points = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "window bigint, node bigint, embedding array<double>")
    params = [(1.0, 3), (1.6, 4), (0.5, 2)]
    d = kernels.distances(x, x, "euclidean", same=True)
    want = {}
    for p, (eps, size) in enumerate(params):
        near = d <= eps
        core = near.sum(axis=1) >= size
        root = np.arange(len(x))
        for _ in x:
            root = np.array([min(root[j] for j in np.flatnonzero(near[i] & core)) if core[i] else i for i in range(len(x))])
        for i in range(len(x)):
            reach = [root[j] for j in np.flatnonzero(near[i] & core)]
            if reach:
                want[p, i] = min(reach)
    assert len(set(want.values())) > 5
    for rows, tile in ((3072, 32768), (7, 1000), (7, 20), (7, 1)):
        got = clusters.density_roots(points, params, "euclidean", rows, tile).collect()
        assert {(r["param"], r["node"]): r["root"] for r in got} == want and len(got) == len(want)


def test_sets_are_merged_in_strips():
    near = np.array([[1, 0, 0], [0, 1, 0], [0, 1, 1], [0, 0, 0]], dtype=bool)
    root = np.arange(7)
    kernels.merge(root, np.arange(4), np.arange(4, 7), near, strip=1)
    assert kernels.found(root, np.arange(7)).tolist() == [0, 1, 1, 3, 0, 1, 1]
