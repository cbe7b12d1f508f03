"""The lexicon score cuts words once and looks up only earlier words that can matter."""

from tidewire.operators import sentiment


def test_number_of_words_without_cutting_them(spark):
    bodies = ["", None, "  ", "one", "(Very) GOOD!! day...", "a  b\n c\t:) :-( ...x... --", "isn't -- ok", "  x   y"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k long, x string")
    words = {r.k: len(r.words) for r in sentiment._words(df, "k", "x").collect()}
    counts = {r.k: r.n for r in sentiment._counts(df, "k", "x").collect()}
    assert counts == words


def test_earlier_words_meet_negations_only(spark, monkeypatch):
    lexicon = [("good", 2.0), ("day", 1.0), ("bad", -2.0), ("not", -1.0), ("ain't", -0.5)]
    real, seen = sentiment.small, []

    def small(df):
        seen.append({r.term for r in df.collect()})
        return real(df)

    monkeypatch.setattr(sentiment, "small", small)
    df = spark.createDataFrame([(1, "not good"), (2, "never good"), (3, "ain't bad"), (4, "day good")], "k long, x string")
    out = sentiment.lexicon_sentiment(df, spark.createDataFrame(lexicon, "term string, valence double"), "k", "x")
    got = {r.k: r.feat_sent_compound for r in out.collect()}
    assert seen[1] == {"not", "ain't"}

    def squashed(s):
        return round(s / (s * s + sentiment.ALPHA) ** 0.5, 4)

    # A negation that is a term counts for itself and flips nothing.
    assert got == {1: squashed(1.0), 2: squashed(2.0 * sentiment.FLIP), 3: squashed(-2.5), 4: squashed(3.0)}
