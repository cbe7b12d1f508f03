"""Lemmas and stop words as table joins; text for the embedding step."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.session import small


def suffix_lemmas(df: DataFrame, col: str, suffixes: Iterable[str] = ("ing", "ed", "ly", "s")) -> DataFrame:
    """(token, lemma) from the corpus itself: a token whose stem is also a token."""
    tokens = df.select(F.explode(F.split(text.clean_text(col), " ")).alias("token")).distinct()
    tokens = tokens.filter(F.length("token") > 0)
    ends = list(suffixes)
    cut = F.lit(None).cast("string")
    for s in reversed(ends):
        stem = F.expr(f"left(token, length(token) - {len(s)})")
        cut = F.when(F.col("token").endswith(s) & (F.length("token") >= len(s) + 3), stem).otherwise(cut)
    cuts = tokens.select("token", cut.alias("lemma")).filter("lemma IS NOT NULL")
    return cuts.join(tokens.select(F.col("token").alias("lemma")), "lemma", "left_semi").select("token", "lemma")


def lemmatize(
    df: DataFrame, lemmas: DataFrame, key: str, col: str, stop_words: Iterable[str] = text.STOP_WORDS
) -> DataFrame:
    """(key, lemmas): the row's tokens as lemmas, stop words left out, in order.

    Texts are dealt out by key while they are whole: one shuffle of the texts, and none of their
    tokens, as a key's tokens are then in one task up to their collection, which is
    bounded by the length of the key's texts. The small tables meet the tokens map-side.
    """
    stops = list(stop_words)
    # A number given is kept: joined by size, a few tasks would hold all tokens.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, col).repartition(tasks, key)
    tokens = rows.select(key, F.posexplode_outer(F.split(F.col(col), " ")).alias("i", "token"))
    joined = tokens.join(small(lemmas), "token", "left").withColumn("t", F.coalesce("lemma", "token"))
    # NULLs are not collected: a text without any kept token still has its row.
    kept = F.when((F.col("token") != "") & ~F.col("token").isin(stops), F.struct("i", "t"))
    ordered = joined.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("ts"))
    return ordered.select(key, F.array_join(F.col("ts.t"), " ").alias("lemmas"))


def prepare_embedding_text(
    df: DataFrame,
    col: str = "title_desc",
    terms: Iterable = text.MARKET_TERMS,
    lemmas: DataFrame | None = None,
    remove_date: bool = True,
    from_raw: bool = False,
    key: str = "idx_news",
) -> DataFrame:
    """Add ``clean_emb_<col>``: cleaned, lemmatised, block-listed terms and dates out.

    ``from_raw`` lemmatises the text as it came, without the cleaning.
    """
    name = f"clean_emb_{col}"
    out = df.withColumn(name, text.squeeze(F.col(col)) if from_raw else text.clean_text(col))
    if lemmas is not None:
        out = out.join(lemmatize(out, lemmas, key, name), key).drop(name).withColumnRenamed("lemmas", name)
    cleaned = text.remove_terms(name, terms)
    return out.withColumn(name, text.remove_dates(cleaned) if remove_date else cleaned)
