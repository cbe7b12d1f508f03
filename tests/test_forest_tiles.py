"""The density forest in tiles: one task for a window of one tile, rounds only between tiles."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_clusters import blobs, labels_of, points_of

from tidewire.operators import clusters, density


def test_forest_of_one_tile_needs_no_rounds(spark, monkeypatch):
    """A window of several blocks is done in its task: forest, search and labels."""

    def never(*_):
        raise AssertionError("component rounds in a window of one tile")

    monkeypatch.setattr(density, "connected_components", never)
    groups = {1: blobs(90, seed=1), 2: blobs(60, seed=2)}
    grid = [0.05, 0.12, 0.3]
    out = clusters.forest_eps(points_of(spark, groups), grid, 4, rows=17).cache()
    swept, best = clusters.eps_sweep(points_of(spark, groups), grid, 4, rows=17)
    adapted, radius = clusters.adaptive_sweep(points_of(spark, groups), 4, rows=17)
    best, radius = ({r["window"]: r["eps"] for r in df.collect()} for df in (best, radius))
    for w, x in groups.items():
        for p, eps in enumerate(grid):
            assert (labels_of(out.filter(F.col("param") == p), len(x), w) == brute.dbscan(x, eps, 4)).all()
        assert (labels_of(swept, len(x), w) == brute.dbscan(x, best[w], 4)).all()
        assert (labels_of(adapted, len(x), w) == brute.dbscan(x, radius[w], 4)).all()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_forest_of_several_tiles(spark, metric):
    """Tiles of blocks, copies and a vector without direction beside a window of one tile."""
    x = np.concatenate([blobs(120, d=2, seed=5), np.tile([[1.0, 0.0]], (20, 1)), np.zeros((1, 2))])
    groups = {1: x, 2: blobs(30, d=2, seed=6)}
    grid = [0.02, 0.1, 0.3]
    tiled = clusters.forest_eps(points_of(spark, groups), grid, 4, metric, 13, tile=40).cache()
    whole = clusters.forest_eps(points_of(spark, groups), grid, 4, metric).cache()
    assert whole.filter("label >= 0").count() > 100
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, whole.collect()))
    one, two = (clusters.eps_sweep(points_of(spark, groups), grid, 4, metric, *a) for a in ((13, 40), ()))
    assert sorted(map(tuple, one[1].collect())) == sorted(map(tuple, two[1].collect()))
    assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, two[0].collect()))


def test_lightest_edges_span():
    rng = np.random.default_rng(8)
    weight = rng.integers(1, 9, size=(25, 25)).astype(float)
    u, v = np.nonzero(np.triu(np.ones((25, 25)), 1))
    _, _, w = density.lightest(25, u, v, weight[u, v])
    both = np.triu(weight, 1) + np.triu(weight, 1).T
    np.fill_diagonal(both, np.inf)
    assert len(w) == 24 and w.sum() == density.spanning_edges(both, True)[2].sum()
