"""News feed: shaping, first-row-wins dedupe, contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import clock, text
from tidewire.operators.ordering import previous_row

COMMON_COLUMNS = ["date", "url", "author", "title", "subtitle", "source", "title_desc", "idx_news"]


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """Column names that start with one of the prefixes, in frame order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*with_prefix(df, prefix))


def distinct_columns(names: Iterable[str]) -> list[str]:
    """First of each repeated name."""
    return list(dict.fromkeys(names))


def shape_feed(
    raw: DataFrame,
    kept: Iterable[str] = ("idx_news", "date", "url", "author", "title", "subtitle"),
    *,
    source: str,
    author_prefixes: Iterable[str] = (),
) -> DataFrame:
    """Raw rows to typed news rows; ``title_desc`` is title + subtitle text.

    NULL title or subtitle gives a NULL ``title_desc``; an unreadable date NULL.
    """
    df = raw.select(*kept)
    is_text = dict(df.dtypes)["date"] == "string"
    date = clock.parse_feed_date("date") if is_text else F.col("date").cast("timestamp")
    return df.withColumns(
        {
            "author": text.remove_terms(F.col("author").cast("string"), author_prefixes),
            "source": F.lit(source),
            "date": date,
            "subtitle": text.html_text(F.col("subtitle").cast("string")),
        }
    ).withColumn("title_desc", F.concat(F.col("title").cast("string"), F.col("subtitle")))


def _digest(c: Column) -> Column:
    # The copies of a text meet by digest: wide strings never act as shuffle keys.
    return F.sha2(F.coalesce(F.concat(F.lit("t"), c), F.lit("")), 256)


def first_texts(df: DataFrame, col: str = "title_desc", key: str = "idx_news") -> DataFrame:
    """Keys of the first row of every distinct text.

    A minimum per digest combines before the shuffle, so a text with very many
    copies costs one row per map task.
    """
    return df.groupBy(_digest(F.col(col)).alias("_digest")).agg(F.min(key).alias(key)).select(key)


def first_times(df: DataFrame, col: str = "date", key: str = "idx_news") -> DataFrame:
    """Keys of the first row of every distinct time, lowest key first.

    A row without a readable time equals no other and stays.
    """
    untimed = F.when(F.col(col).isNull(), F.col(key))
    return df.groupBy(col, untimed.alias("_untimed")).agg(F.min(key).alias(key)).select(key)


def dedupe_text(df: DataFrame, col: str = "title_desc", key: str = "idx_news") -> DataFrame:
    return df.join(first_texts(df, col, key), key, "left_semi")


def dedupe_time(df: DataFrame, col: str = "date", key: str = "idx_news") -> DataFrame:
    return df.join(first_times(df, col, key), key, "left_semi")


def clean_feed(
    df: DataFrame,
    cols: str | list[str] = "title_desc",
    keep: Callable[[DataFrame], DataFrame] | None = None,
    terms: Iterable = text.COLUMN_PHRASES,
) -> DataFrame:
    """Language filter, cleaning, dedupe on text and then on time.

    ``keep`` is the row filter (for instance an English filter). Both dedupes run
    on (key, time, digest) rows; the wide rows move once, in the last join.
    """
    if not isinstance(cols, (str, list)):
        raise TypeError("cols must be a str or a list")
    names = [cols] if isinstance(cols, str) else cols
    kept = keep(df) if keep else df
    cleaned = kept.withColumns({c: text.clean_text(c, terms) for c in names})
    narrow = cleaned.select("idx_news", "date", _digest(F.col("title_desc")).alias("_digest"))
    by_text = narrow.groupBy("_digest").agg(F.min(F.struct("idx_news", "date")).alias("r"))
    return cleaned.join(first_times(by_text.select("r.*")), "idx_news", "left_semi")


def _breaks(df: DataFrame) -> DataFrame:
    narrow = previous_row(df.select("idx_news", "date"), ["idx_news"], {"_before": F.col("date")})
    return narrow.select(F.count(F.when(F.col("date") < F.col("_before"), 1)).alias("violations"))


def _repeats(df: DataFrame, key: Column) -> DataFrame:
    groups = df.groupBy(key.alias("_k")).agg(F.count("*").alias("n"))
    return groups.select(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def feed_contract(sent: DataFrame, emb: DataFrame, common: Iterable[str] = COMMON_COLUMNS) -> DataFrame:
    """(check, violations): order, uniqueness and row-for-row equality of two feeds."""
    checks = {}
    for name, df in (("sent", sent), ("emb", emb)):
        checks[f"{name}_date_sorted"] = _breaks(df)
        checks[f"{name}_date_unique"] = _repeats(df, F.col("date"))
        checks[f"{name}_text_unique"] = _repeats(df, _digest(F.col("title_desc")))
    others = [c for c in common if c != "idx_news"]
    both = (
        sent.select("idx_news", F.struct(*others).alias("s"), F.lit(1).alias("in_s"))
        .join(emb.select("idx_news", F.struct(*others).alias("e"), F.lit(1).alias("in_e")), "idx_news", "full_outer")
    )
    paired = F.col("in_s").isNotNull() & F.col("in_e").isNotNull()
    unequal = both.agg(
        F.count(F.when(~paired, 1)).alias("feed_rows"),
        *[
            F.count(F.when(paired & ~F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")), 1)).alias(f"feed_{c}")
            for c in others
        ],
    )
    names = unequal.columns
    table = unequal.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names])).alias("r")
    ).select("r.*")
    for name, df in checks.items():
        table = table.unionByName(df.select(F.lit(name).alias("check"), "violations"))
    return table


def assert_contract(sent: DataFrame, emb: DataFrame) -> None:
    broken = [r["check"] for r in feed_contract(sent, emb).filter("violations > 0").collect()]
    if broken:
        raise ValueError(f"feeds break the contract: {', '.join(sorted(broken))}")


def merge_features(sent: DataFrame, emb: DataFrame, col: str = "title_desc") -> DataFrame:
    """Common columns, cleaned texts and both feature families, one row per article.

    Rows pair where every common column agrees, NULL with NULL included. The
    equi-join runs on ``idx_news``; the other columns are a residual predicate.
    """
    s, e = sent.alias("s"), emb.alias("e")
    agree = F.col("s.idx_news") == F.col("e.idx_news")
    for c in COMMON_COLUMNS:
        if c != "idx_news":
            agree = agree & F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}"))
    emb_kept = [f"clean_emb_{col}"] + with_prefix(emb, "feat_emb", "embedding")
    sent_kept = [f"clean_sent_{col}"] + with_prefix(sent, "feat_sent")
    return s.join(e, agree).select(
        *[F.col(f"s.{c}") for c in COMMON_COLUMNS + sent_kept],
        *[F.col(f"e.{c}") for c in emb_kept],
    )
