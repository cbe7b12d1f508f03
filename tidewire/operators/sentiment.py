"""Sentiment: pluggable batch scorers, lexicon rules, score algebra."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import text
from tidewire.functions.vectors import softmax
from tidewire.session import small

NEGATIVE, NEUTRAL, POSITIVE = "feat_sent_negative", "feat_sent_neutral", "feat_sent_positive"
# Label order of the two families of three-label models.
LABEL_ORDERS = {
    "TwitterRoberta": [NEGATIVE, NEUTRAL, POSITIVE],
    "FinBert": [POSITIVE, NEUTRAL, NEGATIVE],
    "CryptoBert": [POSITIVE, NEUTRAL, NEGATIVE],
}
TINY = 1e-12

# Fixed values of the published lexicon method: step of a degree adverb and its
# fading with distance, flip of a negation, normaliser, weights around "but".
BOOST, FADE, FLIP, ALPHA = 0.293, (1.0, 0.95, 0.9), -0.74, 15.0
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
INTENSIFIERS = (
    "absolutely amazingly completely considerably deeply enormously entirely especially "
    "exceptionally extremely fully greatly highly hugely incredibly intensely majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly totally tremendously "
    "unbelievably unusually utterly very"
).split()
DAMPENERS = "almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split()
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt "
    "mustnt neither never no none nope nor not nothing nowhere oughtnt shant shouldnt wasnt werent "
    "without wont wouldnt rarely seldom despite"
).split()


def score_algebra(df: DataFrame) -> DataFrame:
    """Five derived scores from the three label probabilities."""
    neg, neu, pos = F.col(NEGATIVE), F.col(NEUTRAL), F.col(POSITIVE)
    gap = pos - neg
    entropy = -sum((p * F.ln(p + TINY) for p in (neu, pos)), neg * F.ln(neg + TINY))
    return df.withColumns(
        {
            "feat_sent_score": gap,
            "feat_sent_score_biased_center": gap / (1 - neu + TINY),
            "feat_sent_score_sigmoid_adj": gap / (pos + neg + TINY),
            "feat_sent_entropy": entropy,
            "feat_sent_score_entropy_adj": gap * (1 - entropy),
        }
    )


def score_text(
    df: DataFrame, col: str, make_scorer: Callable, labels: Iterable[str], batch_size: int = 256
) -> DataFrame:
    """Score texts in batches with a model loaded once per Python worker.

    ``make_scorer()`` returns ``f(texts) -> logits`` of shape (batch, labels).
    """
    model = predict_batch_udf(
        make_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    scored = df.withColumn("_logits", model(F.coalesce(F.col(col), F.lit(""))))
    scored = scored.withColumn("_p", softmax("_logits"))
    named = scored.withColumns({label: F.col("_p")[i] for i, label in enumerate(labels)})
    return score_algebra(named.drop("_logits", "_p"))


def _body(col: str) -> Column:
    return text.squeeze(F.coalesce(F.lower(F.col(col)), F.lit("")))


def _words(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, words): words without outer punctuation."""
    body = _body(col)
    # Only words that keep three or more signs are cut: short ones are emoticons.
    sign = r"!-/:-@\[-`{-~"
    outer = rf"(?<![^ ])[{sign}]*([^{sign} ][^ ]+[^{sign} ])[{sign}]*(?![^ ])"
    words = F.split(F.regexp_replace(body, outer, "$1"), " ")
    return df.select(key, F.when(body != "", words).otherwise(F.array().cast("array<string>")).alias("words"))


def _counts(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, n, mark): the number of words, punctuation emphasis.

    Cutting outer punctuation leaves every word in its place, so the spaces tell the number.
    """
    body = _body(col)
    spaces = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    shouts = F.least(F.regexp_count(F.col(col), F.lit("!")), F.lit(4)) * 0.292
    asks = F.regexp_count(F.col(col), F.lit(r"\?"))
    doubts = F.when(asks > 3, 0.96).when(asks > 1, asks * 0.18).otherwise(0.0)
    return df.select(
        key,
        F.when(body != "", spaces + 1).otherwise(0).alias("n"),
        F.coalesce(shouts + doubts, F.lit(0.0)).alias("mark"),
    )


def _negates(word: Column) -> Column:
    return word.isin(NEGATIONS) | word.contains("n't")


def _step(valence: Column, word: Column, known: Column, fade: float) -> Column:
    """Effect on a word's valence of one earlier word that is no lexicon term."""
    push = F.when(word.isin(INTENSIFIERS), BOOST).when(word.isin(DAMPENERS), -BOOST).otherwise(0.0)
    moved = valence + F.when(valence < 0, -push * fade).otherwise(push * fade)
    return F.when(word.isNull() | known, valence).otherwise(
        F.when(_negates(word), moved * FLIP).otherwise(moved)
    )


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, key: str, col: str) -> DataFrame:
    """(key, negative, neutral, positive, compound) from a (term, valence) lexicon.

    Only words found in the lexicon leave their row: the neutral ones are counted
    from the array size. The three words before come from the row's own array, so
    the single shuffle carries one partial sum per row.
    """
    movers = INTENSIFIERS + DAMPENERS
    terms = small(lexicon.filter(~F.col("term").isin(movers)).select("term", "valence"))
    # Of the words before, only negations can be terms and yet have an effect.
    negations = small(terms.filter(_negates(F.col("term"))).select("term").distinct())
    words = _words(df, key, col)
    # The words moved along by one to three places sit beside the words.
    none = F.lit(None).cast("string")
    before = {
        f"p{k}": F.slice(F.concat(F.array_repeat(none, k), "words"), F.lit(1), F.size("words")) for k in (1, 2, 3)
    }
    placed = (
        words.withColumn("but_at", F.array_position("words", "but") - 1)
        .withColumns({"term": F.col("words"), **before})
        .select(key, "but_at", F.posexplode(F.arrays_zip("term", *before)).alias("i", "w"))
        .select(key, "but_at", "i", "w.*")
    )
    hits = placed.join(terms, "term")
    for k in (1, 2, 3):
        known = negations.select(F.col("term").alias(f"n{k}"), F.lit(True).alias(f"known{k}"))
        hits = hits.withColumn(f"n{k}", F.when(_negates(F.col(f"p{k}")), F.col(f"p{k}"))).join(known, f"n{k}", "left")
        hits = hits.withColumn(
            "valence",
            _step(F.col("valence"), F.col(f"p{k}"), F.coalesce(f"known{k}", F.lit(False)), FADE[k - 1]),
        )
    weight = (
        F.when((F.col("but_at") >= 0) & (F.col("i") < F.col("but_at")), BEFORE_BUT)
        .when((F.col("but_at") >= 0) & (F.col("i") > F.col("but_at")), AFTER_BUT)
        .otherwise(1.0)
    )
    v = F.col("valence")
    sums = hits.withColumn("valence", v * weight).groupBy(key).agg(
        F.sum("valence").alias("s"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("up"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("down"),
        F.count(F.when(v != 0, 1)).alias("charged"),
    )
    counted = _counts(df, key, col).join(sums, key, "left")
    zero = F.lit(0.0)
    s, up, down = (F.coalesce(c, zero) for c in ("s", "up", "down"))
    mark = F.col("mark")
    s = F.when(s > 0, s + mark).when(s < 0, s - mark).otherwise(s)
    up, down = F.when(up > down, up + mark).otherwise(up), F.when(down > up, down + mark).otherwise(down)
    flat = F.col("n") - F.coalesce("charged", F.lit(0))
    total = up + down + flat
    share = {NEGATIVE: down, NEUTRAL: flat, POSITIVE: up}
    return counted.select(
        key,
        *[F.round(F.coalesce(F.try_divide(x, total), zero), 3).alias(c) for c, x in share.items()],
        F.round(s / F.sqrt(s * s + ALPHA), 4).alias("feat_sent_compound"),
    )


def score_feed(
    df: DataFrame, col: str, models: dict[str, Callable[[DataFrame, str], DataFrame]]
) -> DataFrame:
    """Clean the text and stack the scores of every model, keyed by ``sent_model``."""
    clean = df.withColumn(f"clean_sent_{col}", text.clean_sentiment(col))
    out = None
    for name, model in models.items():
        scored = model(clean, f"clean_sent_{col}").withColumn("sent_model", F.lit(name))
        out = scored if out is None else out.unionByName(scored, allowMissingColumns=True)
    if out is None:
        raise ValueError("name at least one sentiment model")
    return out


def lexicon_model(lexicon: DataFrame, key: str = "idx_news") -> Callable[[DataFrame, str], DataFrame]:
    def run(df: DataFrame, col: str) -> DataFrame:
        return score_algebra(df.join(lexicon_sentiment(df, lexicon, key, col), key))

    return run


def batch_model(make_scorer: Callable, labels: Iterable[str]) -> Callable[[DataFrame, str], DataFrame]:
    return lambda df, col: score_text(df, col, make_scorer, labels)


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, score: str, least: int = 5) -> DataFrame:
    """(term, valence) from labelled texts: four times the mean label of the texts
    that hold the term, less the overall mean; terms in ``least`` texts or more."""
    words = docs.join(labels, "doc_id").select(
        score, F.explode(F.array_distinct(text.vocabulary_tokens("text"))).alias("term")
    )
    base = labels.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg(score).alias("base"))
    return (
        words.groupBy("term")
        .agg(F.avg(score).alias("m"), F.count("*").alias("n"))
        .filter(F.col("n") >= least)
        .crossJoin(F.broadcast(base))
        .select("term", (4 * (F.col("m") - F.col("base"))).alias("valence"))
    )
