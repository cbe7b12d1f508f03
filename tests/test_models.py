import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import embed, regression, sentiment


def vader(words, lexicon, mark=0.0):
    """One text by the published rules, word by word."""
    values = []
    for i, w in enumerate(words):
        v = 0.0
        if w in lexicon and w not in sentiment.INTENSIFIERS + sentiment.DAMPENERS:
            v = lexicon[w]
            for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i >= k and words[i - k] not in lexicon:
                    p = words[i - k]
                    push = 0.293 if p in sentiment.INTENSIFIERS else -0.293 if p in sentiment.DAMPENERS else 0
                    v += (-push if v < 0 else push) * fade
                    if p in sentiment.NEGATIONS or "n't" in p:
                        v *= -0.74
        values.append(v)
    if "but" in words:
        at = words.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    s = sum(values)
    s = s + mark if s > 0 else s - mark if s < 0 else s
    up, down = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    up, down = up + (mark if up > down else 0), down + (mark if down > up else 0)
    total = up + down + sum(v == 0 for v in values)
    return (down / total, sum(v == 0 for v in values) / total, up / total, s / math.sqrt(s * s + 15)) if total else (0, 0, 0, 0)


def test_lexicon_rules(spark):
    lexicon = {"good": 1.9, "bad": -2.5, "great": 3.1, "very": 9.0}
    texts = ["very good", "not good", "this is not very good at all", "good but bad", "slightly bad, great!!", "plain words", "",
             "isn't really great", "good bad not x great"]
    table = spark.createDataFrame(list(lexicon.items()), "term string, valence double")
    df = spark.createDataFrame(list(enumerate(texts)), "idx_news long, x string")
    got = {r[0]: tuple(r)[1:] for r in sentiment.lexicon_sentiment(df, table, "idx_news", "x").collect()}
    known = {k: v for k, v in lexicon.items() if k != "very"}
    for i, t in enumerate(texts):
        words = [w.strip(",!") if len(w.strip(",!")) > 2 else w for w in t.split()]
        want = vader(words, known, 0.292 * t.count("!"))
        assert got[i] == pytest.approx([round(v, 3) for v in want[:3]] + [round(want[3], 4)], abs=1.1e-3), t


def test_score_algebra(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (1 / 3, 1 / 3, 1 / 3)],
                               f"{sentiment.NEGATIVE} double, {sentiment.NEUTRAL} double, {sentiment.POSITIVE} double")
    rows = sentiment.score_algebra(df).collect()
    assert [r["feat_sent_score"] for r in rows] == [0, -1, 0]
    assert [r["feat_sent_score_biased_center"] for r in rows] == pytest.approx([0, -1, 0])
    assert [r["feat_sent_entropy"] for r in rows] == pytest.approx([0, 0, math.log(3)], abs=1e-9)
    assert rows[1]["feat_sent_score_entropy_adj"] == pytest.approx(-1)


def test_batch_scores_follow_the_label_order(spark):
    def make():
        return lambda texts: np.array([[0.0, 1.0, float(len(t))] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "idx_news long, title_desc string")
    models = {n: sentiment.batch_model(make, sentiment.LABEL_ORDERS[n]) for n in ("TwitterRoberta", "FinBert")}
    lexicon = spark.createDataFrame([("abc", 2.0)], "term string, valence double")
    out = sentiment.score_feed(df, "title_desc", {**models, "Vader": sentiment.lexicon_model(lexicon)})
    got = {(r["sent_model"], r["idx_news"]): r for r in out.collect()}
    p = np.exp([0, 1, 3]) / np.exp([0, 1, 3]).sum()
    assert got["TwitterRoberta", 1][sentiment.POSITIVE] == pytest.approx(p[2])
    assert got["FinBert", 1][sentiment.NEGATIVE] == pytest.approx(p[2])
    assert got["Vader", 1]["feat_sent_compound"] == pytest.approx(2 / math.sqrt(19), abs=1e-4)
    with pytest.raises(ValueError):
        sentiment.score_feed(df, "title_desc", {})


def test_tfidf(spark):
    docs = [(1, "aa bb bb"), (2, "bb cc"), (3, "zz"), (4, None)]
    df = spark.createDataFrame(docs, "idx_news long, x string")
    out = {(r[0], r[1]): r[3] for r in embed.tfidf(df, "idx_news", "x", 2).collect()}
    idf = {"aa": math.log(5 / 2) + 1, "bb": math.log(5 / 3) + 1}
    n = math.hypot(idf["aa"], 2 * idf["bb"])
    assert out == pytest.approx({(1, "aa"): idf["aa"] / n, (1, "bb"): 2 * idf["bb"] / n, (2, "bb"): 1.0})
    top = embed.top_words(embed.tfidf(df, "idx_news", "x", 2), "idx_news", 1)
    assert {(r["idx_news"], r["token"]) for r in top.collect()} == {(1, "bb"), (2, "bb")}
    wide = embed.embed(df, "x", ["TfIdf"], options={"TfIdf": {"max_features": 2}}).orderBy("idx_news").collect()
    assert [len(r["embedding"]) for r in wide] == [2] * 4 and wide[3]["embedding"] == [0, 0]
    with pytest.raises(ValueError):
        embed.embed(df, "x", "sBERT")


def test_standardize_and_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) * [1, 5, 0] + [1, 2, 7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, embedding array<double>")
    z = np.array([r["embedding"] for r in embed.standardize(df).orderBy("i").collect()])
    want = np.concatenate([(x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0), np.zeros((50, 1))], axis=1)
    assert z == pytest.approx(want)
    out, shares = embed.pca(df, 2)
    u, s, vt = np.linalg.svd(want, full_matrices=False)
    size = np.abs(vt[:2])
    signs = np.sign(vt[np.arange(2), (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)])
    scores = want @ (vt[:2].T * signs)
    assert np.array([r["embedding"] for r in out.orderBy("i").collect()]) == pytest.approx(scores, abs=1e-8)
    table = embed.explained_variance(shares, df).orderBy("component").collect()
    assert table[-1]["cumulative"] == pytest.approx(1.0) and table[0]["share"] == pytest.approx(s[0] ** 2 / (s**2).sum())
    assert embed.widen(out, "m", 2).columns == ["i", "feat_emb_m_1", "feat_emb_m_2"]


def test_word2vec_averages_known_words(spark):
    docs = [(1, "alpha beta alpha"), (2, "beta alpha once"), (3, "once"), (4, "12"), (5, "once solo"), (6, None)]
    df = spark.createDataFrame(docs, "idx_news long, x string")
    rows = embed.embed_word2vec(df, "idx_news", "x", 4, min_count=2, partitions=1).collect()
    out = {r["idx_news"]: np.array(r["embedding"]) for r in rows}
    assert len(out) == 6 and not out[4].any() and not out[6].any()
    # 'solo' is below the count: the mean is over the known word alone.
    assert np.abs(out[3]).sum() > 0 and out[5] == pytest.approx(out[3])


def data(spark, n=200, seed=0, collinear=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 2, 3, 0.5] + [0, 1, 0, 5]
    if collinear:
        x[:, 3] = x[:, 0] + x[:, 1]
    y = 2 * x[:, 0] - x[:, 2] + 0.3 * rng.normal(size=n) + 4
    rows = [(i, i * 60, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "idx_news long, s long, feat_a double, feat_b double, feat_c double, feat_d double, target_y double")
    return df.withColumn("date", F.timestamp_seconds("s")).drop("s"), x, y


NAMES = ["feat_a", "feat_b", "feat_c", "feat_d"]


def test_model_frame(spark, at):
    df = spark.createDataFrame([(1, at("2024-01-01 00:00:00"), None, 1, 1.0), (2, at("2024-01-02 00:00:00"), 2.0, 3, None)],
                               "idx_news long, date timestamp, feat_a double, feat_b int, target_y double")
    rows = regression.model_frame(df).collect()
    assert [(r["idx_news"], r["feat_a"], r["feat_b"]) for r in rows] == [(1, 0.0, 1.0)]


def test_ols(spark):
    df, x, y = data(spark)
    frame = regression.split_frame(regression.model_frame(df))
    table, predict = regression.ols(frame.filter("split = 'train'"), NAMES, "target_y")
    a = np.concatenate([x[:120], np.ones((120, 1))], axis=1)
    beta = np.linalg.lstsq(a, y[:120], rcond=None)[0]
    se = np.sqrt(((y[:120] - a @ beta) ** 2).sum() / 115 * np.diag(np.linalg.inv(a.T @ a)))
    got = table.collect()
    assert [r["coef"] for r in got] == pytest.approx(beta) and [r["std_err"] for r in got] == pytest.approx(se)
    m = regression.hold_out_metrics(predict(frame.filter("split = 'test'")), "target_y").first()
    e = y[160:] - np.concatenate([x[160:], np.ones((40, 1))], axis=1) @ beta
    assert m["mse"] == pytest.approx((e**2).mean()) and m["r2"] == pytest.approx(1 - (e**2).mean() / y[160:].var())


def test_vif(spark):
    df, x, _ = data(spark)
    got = {r["feature"]: r for r in regression.vif_table(df, NAMES + ["feat_a"], 1e9).collect()}
    for i, n in enumerate(NAMES):
        rest = np.delete(x, i, axis=1)
        res = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[n]["vif"] == pytest.approx((x[:, i] ** 2).sum() / (res**2).sum())
    df, _, _ = data(spark, collinear=True)
    rows = regression.vif_table(df, NAMES).collect()
    assert rows[0]["feature"] == "feat_a" and rows[0]["vif"] == math.inf and not rows[0]["kept"]
    kept = regression.reduce_vif(df, NAMES)
    assert "feat_a" not in kept and "feat_c" in kept


def plain_lasso(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / ((xc[:, j] ** 2).mean())
    return w, y.mean() - x.mean(0) @ w


def test_lasso(spark):
    df, x, y = data(spark, n=63)
    z = (x - x.mean(0)) / x.std(0)
    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    alphas = top * np.logspace(0, -3, 12)
    folds = np.repeat(np.arange(5), [13, 13, 13, 12, 12])
    errors = []
    for a in alphas:
        mse = []
        for f in range(5):
            w, b = plain_lasso(z[folds != f], y[folds != f], a)
            mse.append(((y[folds == f] - b - z[folds == f] @ w) ** 2).mean())
        errors.append(np.mean(mse))
    best = alphas[int(np.argmin(errors))]
    table, alpha = regression.lasso(df, NAMES, "target_y", n_alphas=12)
    assert alpha == pytest.approx(best)
    assert [r["coef"] for r in table.collect()] == pytest.approx(plain_lasso(z, y, best)[0], abs=1e-6)
    assert all(r["coef"] > 0.1 for r in regression.selected(table, 0.1).collect())
    collinear = data(spark, collinear=True)[0]
    pruned, _ = regression.lasso(collinear, NAMES, "target_y", vif=True, n_alphas=5)
    assert [r["feature"] for r in pruned.collect()] == regression.reduce_vif(collinear, NAMES)
