"""Runs of characters: counted per text, whatever the characters."""

import math
from collections import Counter

from tidewire.operators import language


def _grams(body):
    low = body.lower()
    return Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))


def test_runs_are_counted_per_text(spark):
    df = spark.createDataFrame([(1, "aaaa"), (1, "AA"), (None, "a\x00\U0001f600b"), (2, None), (3, "")], "k long, x string")
    rows = language._counted(df, "k", "x").collect()
    # A text's equal runs are one row.
    assert sorted((r.k, r.n) for r in rows if r.k == 1) == [(1, 1), (1, 1), (1, 1), (1, 1), (1, 2)]
    whole = language._counted(df.repartition(1), "k", "x", whole=True).collect()
    assert {(r.k, r.start): r.n for r in whole} == {
        (1, "aaa"): 2, (1, "aa"): 2, (1, "a"): 2,
        (None, "a\x00\U0001f600"): 1, (None, "\x00\U0001f600b"): 1, (None, "\U0001f600b"): 1, (None, "b"): 1}


def test_detect_equals_plain_bayes(spark):
    train = [("en", "The cat \U0001f600 and the\x00 dog"), ("fr", "Le chat é\U0001f601 et le chien"), ("fr", None)]
    texts = [(1, "the \U0001f600"), (1, "le"), (2, "chien \U0001f601é"), (None, "dog\x00"), (4, "日本"), (5, None), (6, "")]
    model = language.train_languages(spark.createDataFrame(train, "lang string, text string"), "text")
    counts = {lang: sum((_grams(t) for name, t in train if name == lang and t), Counter()) for lang in ("en", "fr")}
    vocab = set().union(*counts.values())
    logp = {g: {name: math.log((c[g] + 1) / (c.total() + len(vocab))) for name, c in counts.items()} for g in vocab}
    got = {r.gram: r.logp for r in model.collect()}
    assert got.keys() == logp.keys()
    assert all(abs(got[g][name] - p) < 1e-9 for g, by in logp.items() for name, p in by.items())
    wanted = {}
    for key in {k for k, _ in texts}:
        grams = sum((_grams(t) for k, t in texts if k == key and t), Counter())
        known = [(g, n) for g, n in grams.items() if g in logp]
        if known:
            score = {name: sum(n * logp[g][name] for g, n in known) for name in counts}
            wanted[key] = min(score, key=lambda name: (-score[name], name))
    found = language.detect_language(spark.createDataFrame(texts, "id long, body string"), model, "id", "body").collect()
    assert {r.id: r.detected for r in found} == wanted and len(found) == len(wanted)
