import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import clusters, density, features, windows
from tidewire.operators.silhouette import silhouette
from tidewire.operators.windows import Lookback
from tidewire.plans import cluster_features

DAY, MIN = windows.MICROS_PER_DAY, windows.MICROS_PER_MINUTE


def blobs(n, k=5, d=6, seed=0, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    x = centres[rng.integers(0, k, n)] + noise * rng.normal(size=(n, d))
    stray = rng.random(n) < 0.2
    x[stray] = rng.normal(size=(stray.sum(), d))
    return x


def points_of(spark, groups):
    rows = [(w, i, x.tolist()) for w, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "window long, node long, embedding array<double>").repartition(3)


def labels_of(df, n, window):
    out = np.full(n, -99)
    for r in df.filter(F.col("window") == window).collect():
        out[r["node"]] = r["label"]
    return out


@pytest.mark.parametrize("rows", [4096, 17])
def test_dbscan_equals_brute_force(spark, rows):
    groups = {1: blobs(90, seed=1), 2: blobs(60, seed=2), 3: np.eye(6)}
    params = [(0.05, 4), (0.12, 4), (0.12, 1), (0.3, 6)]
    out = clusters.multi_eps(points_of(spark, groups), params, rows=rows).cache()
    for w, x in groups.items():
        for p, (eps, size) in enumerate(params):
            got = labels_of(out.filter(F.col("param") == p), len(x), w)
            assert (got == brute.dbscan(x, eps, size)).all(), (w, eps, size)


def test_long_chain_of_blocks(spark):
    # Neighbours on an arc: one component that runs through all blocks.
    a = np.linspace(0, 3.0, 120)
    x = np.stack([np.cos(a), np.sin(a)], axis=1)
    out = clusters.dbscan(points_of(spark, {1: x}), 0.001, 2, rows=11)
    assert {r["label"] for r in out.collect()} == {0}
    edges = spark.createDataFrame([(1, i, i - 1) for i in range(1, 200)] + [(1, 500, 500), (2, 9, 4)], "g long, u long, v long")
    roots = {(r["g"], r["u"]): r["root"] for r in clusters.connected_components(edges, ["g"]).collect()}
    assert len(roots) == 203 and {v for (g, u), v in roots.items() if g == 1 and u < 200} == {0}
    assert roots[1, 500] == 500 and roots[2, 9] == 4


def test_copies_in_one_hot_group(spark):
    x = np.concatenate([np.tile([[1.0, 0.0]], (80, 1)), np.tile([[0.0, 1.0]], (10, 1)), [[0.0, 0.0]]])
    out = labels_of(clusters.dbscan(points_of(spark, {1: x}), 0.1, 5, rows=13), len(x), 1)
    assert (out == brute.dbscan(x, 0.1, 5)).all()


def test_sweeps(spark):
    groups = {1: blobs(80, seed=3), 2: blobs(50, seed=4)}
    grid = [0.02, 0.05, 0.1, 0.2, 0.9]
    labels, chosen = clusters.eps_sweep(points_of(spark, groups), grid, 4)
    chosen = {r["window"]: r for r in chosen.collect()}
    for w, x in groups.items():
        counts = [len(set(brute.dbscan(x, e, 4))) for e in grid]
        assert chosen[w]["eps"] == grid[int(np.argmax(counts))] and chosen[w]["nb_cluster"] == max(counts)
        assert (labels_of(labels, len(x), w) == brute.dbscan(x, chosen[w]["eps"], 4)).all()
    labels, chosen = clusters.silhouette_sweep(points_of(spark, {**groups, 3: np.eye(6)}), grid, [3, 5])
    chosen = {r["window"]: r for r in chosen.collect()}
    for w, x in groups.items():
        best, score = None, -10
        for e in grid:
            for s in (3, 5):
                sil = brute.silhouette(x, brute.dbscan(x, e, s))
                if sil is not None and sil[1].mean() > score:
                    best, score = (e, s), sil[1].mean()
        assert (chosen[w]["eps"], chosen[w]["size_min"]) == best
        assert chosen[w]["silhouette_score"] == pytest.approx(score)
        assert (labels_of(labels, len(x), w) == brute.dbscan(x, *best)).all()
    assert (chosen[3]["eps"], chosen[3]["size_min"]) == (0.1, 5)


@pytest.mark.parametrize("rows", [3072, 17])
def test_adaptive_search(spark, rows):
    """Each window against the plain search: shrink by ten until all noise, then grow by tenths."""
    tight = blobs(60, seed=12, noise=0.002)
    groups = {1: blobs(80, seed=3), 2: tight, 3: np.eye(6), 4: np.tile([[1.0, 0.0]], (7, 1)), 5: np.eye(2)}
    labels, chosen = clusters.adaptive_sweep(points_of(spark, groups), 4, rows=rows)
    labels, chosen = labels.cache(), {r["window"]: r for r in chosen.collect()}
    for w, x in groups.items():
        eps, shrinks = 0.1, 0
        while set(brute.dbscan(x, eps, 4)) != {-1} and shrinks < 12:
            shrinks += 1
            eps = 0.1 / 10.0**shrinks
        if shrinks == 12:
            assert chosen[w]["eps"] == 0.1 and chosen[w]["eps_min"] is None
            best = 0.1
        else:
            best, most = eps, 1
            # Numbers of labels change at a distance only: steps in between are all alike.
            d = brute.cosine(x, x)
            for k in sorted({max(0, int(np.ceil((v - eps) / (eps * 0.1)))) for v in d.ravel()}):
                e = eps + k * (eps * 0.1)
                if e < 1 and len(set(brute.dbscan(x, e, 4))) > most:
                    best, most = e, len(set(brute.dbscan(x, e, 4)))
            assert chosen[w]["eps_min"] == pytest.approx(eps) and chosen[w]["nb_cluster"] == most
            assert chosen[w]["eps"] == pytest.approx(best)
        assert (labels_of(labels, len(x), w) == brute.dbscan(x, best, 4)).all()
    assert chosen[2]["eps_min"] < 0.1


@pytest.mark.parametrize("rows", [3072, 17])
def test_forest_has_the_clusters_of_every_eps(spark, rows):
    groups = {1: blobs(90, seed=1), 2: blobs(60, seed=2), 3: np.eye(6), 4: np.tile([[1.0, 0.0]], (30, 1)), 5: np.ones((1, 3))}
    grid = [0.3, 0.05, 0.12, 0.9, 0.0]
    for size in (1, 4):
        out = clusters.forest_eps(points_of(spark, groups), grid, size, rows=rows).cache()
        for w, x in groups.items():
            for p, eps in enumerate(grid):
                got = labels_of(out.filter(F.col("param") == p), len(x), w)
                assert (got == brute.dbscan(x, eps, size)).all(), (w, eps, size)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_rule_out_pairs_of_blocks_and_nothing_else(spark, metric):
    """Far groups, copies and a vector without direction: fewer pairs, the same clusters."""
    rng = np.random.default_rng(31)
    x = np.repeat(np.eye(5), 40, axis=0) * 3 + 0.05 * rng.normal(size=(200, 5))
    x = np.concatenate([x, np.tile(x[:1], (20, 1)), np.zeros((1, 5))])
    grid = [0.0005, 0.002, 0.01] if metric == "cosine" else [0.05, 0.1, 0.2]
    forest = density.density_forest(points_of(spark, {1: x}), 4, metric, 25, max(grid))
    assert forest.excluded() > 0.4
    out = clusters.forest_eps(points_of(spark, {1: x}), grid, 4, metric, 25).cache()
    whole = clusters.forest_eps(points_of(spark, {1: x}), grid, 4, metric).cache()
    assert whole.filter("label >= 0").count() > 100
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    if metric == "cosine":
        for p, eps in enumerate(grid):
            assert (labels_of(whole.filter(F.col("param") == p), len(x), 1) == brute.dbscan(x, eps, 4)).all()


def test_spanning_edges_are_minimal():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 2), (9, 9), (5, 8), (1, 4), (30, 30)):
        same = n == m
        weight = rng.integers(0, 6, size=(n, m)).astype(float)
        weight = np.maximum(weight, weight.T) if same else weight
        u, v, w = density.spanning_edges(weight, same)
        total = n if same else n + m
        edges = sorted((weight[i, j], i, j if same else n + j) for i in range(n) for j in range(m) if not same or i < j)
        root = list(range(total))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        want = 0.0
        for cost, i, j in edges:
            if find(i) != find(j):
                root[find(i)] = find(j)
                want += cost
        assert len(w) == total - 1 and w.sum() == want


@pytest.mark.parametrize("rows", [1024, 9])
def test_silhouette(spark, rows):
    x = blobs(70, seed=6)
    label = brute.dbscan(x, 0.1, 4)
    label[np.flatnonzero(label == -1)[0]] = 77  # a cluster of one
    rows_ = [(1, i, int(label[i]), x[i].tolist()) for i in range(len(x))]
    rows_ += [(2, i, 0 if i else -1, x[i].tolist()) for i in range(5)]
    df = spark.createDataFrame(rows_, "window long, node long, label int, embedding array<double>")
    got = {(r["window"], r["label"]): r["silhouette_score"] for r in silhouette(df, ["window"], rows).collect()}
    lab, s = brute.silhouette(x, label)
    assert got[1, None] == pytest.approx(s.mean())
    for one in np.unique(lab):
        assert got[1, int(one)] == pytest.approx(s[lab == one].mean(), abs=1e-12)
    assert got[2, 0] is None and got[2, None] is None and (1, -1) not in got
    assert -1 <= got[1, None] <= 1


def test_vote_and_k(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (1, 0), (2, 5)], "a long, label int")
    assert sorted(map(tuple, clusters.label_vote(df, ["a"]).collect())) == [(1, 0, 2), (2, 5, 1)]
    ks = spark.createDataFrame([(1,), (8,), (9,), (120,)], "n long").select(clusters.k_sqrt(F.col("n")).alias("k"))
    assert [r["k"] for r in ks.collect()] == [2, 2, 3, 10]


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(7)
    x = np.repeat(np.eye(3) * 10, 20, axis=0) + 0.1 * rng.normal(size=(60, 3))
    points = points_of(spark, {1: x})
    drawn = clusters.seeds(points, spark.createDataFrame([(1, 3)], "window long, _kmax int"), 8, rows=16).collect()
    # Draws in proportion to the squared distance find all three groups.
    for i in range(8):
        assert sorted(int(np.argmax(r["embedding"])) for r in drawn if r["init"] == i) == [0, 1, 2]
    out = labels_of(clusters.kmeans(points, [3], n_init=8, rows=16), 60, 1)
    assert out[0] == 0 and list(dict.fromkeys(out.tolist())) == [0, 1, 2]
    assert [len(set(out[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(out)) == 3
    _, chosen = clusters.k_select(points, "silhouette_score", range(2, 6), n_init=8)
    assert chosen.first()["k"] == 3
    with pytest.raises(ValueError):
        clusters.k_select(points, "other")


def timeline(n, days, seed):
    rng = np.random.default_rng(seed)
    return np.sort(rng.choice(days * DAY // MIN, n, replace=False)).astype(np.int64) * MIN + 1


def frame(spark, t, x, **extra):
    names = list(extra)
    rows = [(i, int(t[i]), x[i].tolist(), *[None if np.isnan(extra[c][i]) else float(extra[c][i]) for c in names]) for i in range(len(t))]
    schema = "idx_news long, t long, embedding array<double>" + "".join(f", {c} double" for c in names)
    return spark.createDataFrame(rows, schema).withColumn("date", F.timestamp_micros("t")).drop("t")


def test_windows_against_masks(spark):
    t = timeline(300, 12, 8)
    look = Lookback(days=3, horizon=45, min_news=70)
    df = frame(spark, t, np.zeros((300, 2)))
    pairs = {(r["anchor_id"], r["member_id"]) for r in windows.window_members(df, look).collect()}
    anchors = [i for i in range(300) if t[i] > t[0] + look.span]
    want = {(i, j) for i in anchors for j in np.flatnonzero(brute.window(t, t[i], look.span, look.gap))}
    assert pairs == want
    schedule = {r["idx_news"]: r for r in windows.refit_schedule(df, look).collect()}
    prev, chain = None, None
    assert set(schedule) == set(anchors)
    skipped = 0
    for i in anchors:
        n = brute.window(t, t[i], look.span, look.gap).sum()
        r = schedule[i]
        assert r["n_members"] == n and r["eligible"] == (n >= 70)
        if n < 70:
            prev, skipped = None, skipped + 1
            assert r["chain_id"] is None and not r["refit"]
            continue
        if prev is None or prev // DAY != t[i] // DAY:
            chain = i
        assert r["refit"] == (chain == i) and r["chain_id"] == chain
        prev = t[i]
    assert 0 < skipped < len(anchors)
    zero = Lookback(days=3, horizon=0, min_news=1)
    counts = {r["idx_news"]: r["n_members"] for r in windows.eligible_anchors(df, zero).collect()}
    assert all(counts[i] == brute.window(t, t[i], zero.span, 0).sum() for i in anchors)


def test_band_join_keys_stay_small_on_one_hot_day(spark, monkeypatch):
    """All articles within a day, a third of them at one instant: no range holds more than its share."""
    rng = np.random.default_rng(21)
    t = np.r_[np.sort(rng.choice(DAY // MIN, 600, replace=False)).astype(np.int64) * MIN, np.full(300, 700 * MIN)]
    look = Lookback(days=0.2, horizon=30, min_news=1)
    df = frame(spark, t, np.zeros((900, 1)))
    kept = []
    cut = windows._time_ranges
    monkeypatch.setattr(windows, "_time_ranges", lambda *a: kept.append(cut(*a)) or kept[-1])
    got = sorted(map(tuple, windows.window_members(df, look, rows=64).select("anchor_id", "member_id").collect()))
    want = [(i, int(j)) for i in np.flatnonzero(t > t.min() + look.span).tolist() for j in np.flatnonzero(brute.window(t, t[i], look.span, look.gap))]
    assert got == sorted(want)
    for (dealt, _), name in zip(kept, ("mr", "ar")):
        assert dealt.groupBy(name, f"{name}_part").count().agg(F.max("count")).first()[0] <= 4 * 64


@pytest.mark.parametrize("rows, anchors, most", [(3072, 128, 512), (23, 3, 512), (23, 3, 2)])
def test_rolling_features_against_the_loop(spark, monkeypatch, rows, anchors, most):
    monkeypatch.setattr(features, "MOST_SLICES", most)
    monkeypatch.setattr(features.window_features, "__defaults__", (*features.window_features.__defaults__[:-1], anchors))
    n, look, eps, size = 150, Lookback(days=2, horizon=40, min_news=45), 0.08, 3
    t, x = timeline(n, 6, 9), blobs(n, k=4, d=4, seed=9)
    rng = np.random.default_rng(10)
    f = {"feat_sent_score": rng.normal(size=n), "feat_ret_5min": np.where(rng.random(n) < 0.01, np.nan, rng.normal(size=n))}
    df = frame(spark, t, x, **f)
    out = cluster_features.rolling_features(
        df, 4, look, "dbscan", opti=False, clustering_params={"eps": eps, "size_min": size}, rows=rows)
    got = {r["idx_news"]: r for r in out.collect()}
    schedule = {r["idx_news"]: r for r in windows.refit_schedule(df, look).collect()}
    chains = {}
    for i, r in schedule.items():
        if r["eligible"]:
            chains.setdefault(r["chain_id"], []).append(i)
    assert set(got) == {i for c in chains.values() for i in c} and len(got) > 30
    late = 0
    for start, anchors in chains.items():
        w = np.flatnonzero(brute.window(t, t[start], look.span, look.gap))
        fit = dict(zip(w.tolist(), brute.dbscan(x[w], eps, size).tolist()))
        known = brute.chain(x, t, t[start], fit, look.span, look.gap, t[max(anchors)], eps, size)
        for i in anchors:
            w = np.flatnonzero(brute.window(t, t[i], look.span, look.gap))
            label = np.array([known[j] for j in w])
            late += i != start and known[i] != -1
            want = brute.features(x[w], label, {c: v[w] for c, v in f.items()}, int(np.flatnonzero(w == i)[0]), {"feat_ret_5min"})
            assert got[i]["feat_label"] == known[i]
            for c, v in want.items():
                g = got[i][f"feat_{c}"]
                assert (g is None) == (v is None), (i, c, g, v)
                assert v is None or g == pytest.approx(float(v), abs=1e-7), (i, c)
            assert got[i]["feat_eps"] == eps and got[i]["feat_size_min"] == size
    assert late > 0


def test_anchor_return_can_be_left_out(spark):
    look = Lookback(days=1, horizon=0, min_news=1)
    rows = [(0, i, i * MIN + 1, 0, [1.0, 0.0], float(i)) for i in range(4)]
    members = spark.createDataFrame(rows, "chain_id long, id long, t long, label int, embedding array<double>, feat_ret_5min double")
    at = members.filter("id = 3").select("chain_id", "id", "t", "label")
    for flag, mean in ((False, 1.5), (True, 1.0)):
        for rows in (2048, 2):
            r = features.window_features(at, members, look, ["feat_ret_5min"], 2, exclude_anchor_returns=flag, rows=rows).first()
            assert r["feat_ret_5min_mean"] == mean and r["nb_news"] == 4 and r["feat_ret_5min_std"] is not None


def test_kmeans_rolls_with_a_fit_per_article(spark):
    t, x = timeline(40, 4, 11), blobs(40, d=3, seed=11)
    look = Lookback(days=2, horizon=30, min_news=10)
    out = cluster_features.rolling_features(
        frame(spark, t, x), 3, look, "kmeans", opti=False, clustering_params={"k": 2}).collect()
    assert out and all(r["feat_nb_cluster_tot"] == 2 for r in out)
    with pytest.raises(ValueError):
        cluster_features.make_fit("optics")


def test_pair_operators(spark):
    df = spark.createDataFrame(
        [(1, 10, 0, [1.0, 0.0]), (1, 11, 0, [0.0, 1.0]), (1, 12, -1, [3.0, 4.0])],
        "anchor_id long, member_id long, label int, embedding array<double>")
    rolled = {(r["label"]): (r["nb_news"], r["nb_cluster"]) for r in features.label_rollup(df).collect()}
    assert rolled == {0: (2, None), -1: (1, None), None: (3, 2)}
    pairs = df.select("embedding").withColumn("b", F.array(F.lit(1.0), F.lit(0.0)))
    assert [round(r["dist"], 6) for r in clusters.pair_distance(pairs, "embedding", "b").collect()] == [0.0, 1.0, 0.4]
    assert [round(r["dist"], 6) for r in clusters.pair_distance(pairs, "embedding", "b", "euclidean").collect()] == [0.0, 1.414214, 4.472136]
    d = features.centroid_distance(df.filter("label = 0"), ["anchor_id"], 2).first()
    assert d["mean_dist"] == pytest.approx(1 - 2**-0.5) and d["std_dist"] == pytest.approx(0, abs=1e-9)
