"""Sums of sliding windows: counts by label, centroids and distances without pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidewire.operators import clusters, features, windows
from tidewire.operators.windows import Lookback

MINUTE = 60_000_000


def drawn(n, seed, dim=3):
    """(id, t, label, embedding) with times, labels and vectors that repeat or are missing."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vec = None if i % 11 == 5 else rng.normal(size=dim).tolist()
        if i % 13 == 7:
            vec[0] = None
        rows.append((i, int(rng.integers(0, n)) * 7 * MINUTE, [0, 1, 1, 2, -1, None][int(rng.integers(0, 6))], vec))
    return rows + rows[:4]


def members_of(rows, t, look):
    return [r for r in rows if t - look.span < r[1] <= t - look.gap or r[1] == t]


@pytest.mark.parametrize("gap, most, anchors, turns", [(30, 512, 128, 16384), (30, 4, 5, 7), (0, 512, 3, 16384)])
def test_sliding_sums_equal_the_loop(spark, monkeypatch, gap, most, anchors, turns):
    monkeypatch.setattr(features, "MOST_SLICES", most)
    monkeypatch.setattr(features, "TURNS", turns)
    look, rows, dim = Lookback(days=1 / 24 * 4, horizon=gap), drawn(90, 3), 3
    df = spark.createDataFrame(rows, "id bigint, t bigint, label int, embedding array<double>")
    got = {}
    for r in features.window_counts(df.select("t"), df, look, anchors).collect():
        assert (r["t"], r["label"]) not in got
        got[r["t"], r["label"]] = r["n"]
    want = {}
    for t in {r[1] for r in rows}:
        for m in members_of(rows, t, look):
            want[t, m[2]] = want.get((t, m[2]), 0) + 1
    assert got == want
    out = features._own_windows(df.select("id", "t", "label"), df.select("t", "label", "embedding"), ["id"], look, dim, anchors)
    told = {r["id"]: r for r in out.collect()}
    assert set(told) == {r[0] for r in rows if r[2] is not None}
    for i, t, label, _ in rows:
        if label is None:
            continue
        x = [m[3] if m[3] is not None else [None] * dim for m in members_of(rows, t, look) if m[2] == label]
        centre = [np.mean([v[k] for v in x if v[k] is not None]) if any(v[k] is not None for v in x) else None for k in range(dim)]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(told[i]["centroid"], centre))
        d = [1.0 if None in v or None in centre else 1 - np.dot(v, centre) / np.linalg.norm(v) / np.linalg.norm(centre) for v in x]
        assert told[i]["mean_dist"] == pytest.approx(np.mean(d), abs=1e-9) and told[i]["std_dist"] == pytest.approx(np.std(d), abs=1e-7)


def test_queries_of_windows_form_no_pairs(spark, monkeypatch, tmp_path):
    """The rows of a window's pairs grow with the square of the articles: 45 billion at half a million."""
    start, n = dt.datetime(2024, 1, 1), 120
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(n)], "doc_id bigint, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(i, start + dt.timedelta(hours=2 * i), i, "click", 1.0) for i in range(n)],
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    vectors = np.random.default_rng(1).normal(size=(n, 64)).tolist()
    spark.createDataFrame([(i, i % 3, vectors[i]) for i in range(n)], "vec_id bigint, label int, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")

    pairs = windows.window_members(
        spark.range(n).select(F.col("id").alias("idx_news"), (F.lit(start) + F.make_dt_interval(hours=2 * F.col("id"))).alias("date")),
        Lookback(7, 30, 1)).filter("member_id <> anchor_id").select("anchor_id", (F.pmod("member_id", F.lit(3)).cast("int")).alias("label"))
    want = sorted(map(tuple, clusters.label_vote(pairs.filter("label <> 0"), ["anchor_id"]).collect()))

    def refuse(*args, **more):
        raise AssertionError("pairs were formed")

    monkeypatch.setattr(windows, "window_members", refuse)
    queries = entry_points.queries()
    assert sorted(map(tuple, queries["label_vote"](spark, str(tmp_path)).collect())) == want
    late = n - 84 - 1
    assert queries["label_rollup"](spark, str(tmp_path)).filter("label IS NULL").count() == late
    assert queries["centroid"](spark, str(tmp_path)).count() == 64 * late
    assert queries["centroid_distance"](spark, str(tmp_path)).filter("mean_dist > 0").count() == late
