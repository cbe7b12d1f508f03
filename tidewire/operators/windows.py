"""Rolling lookback windows: membership, eligibility, refit chains, blocks.

A window of the article dated t holds the articles with
``t - lookback < date <= t - horizon`` and the article itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ordering import last_marked, previous_row, running_total
from tidewire.session import cut_lineage, small

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_MINUTE = 60_000_000
# Rows of a range of time in the band join.
RANGE = 2048


@dataclass(frozen=True)
class Lookback:
    """``days`` back, ``horizon`` minutes of forward looking left out."""

    days: float = 7
    horizon: float = 30
    min_news: int = 10

    @property
    def span(self) -> int:
        return int(self.days * MICROS_PER_DAY)

    @property
    def gap(self) -> int:
        return int(self.horizon * MICROS_PER_MINUTE)


def timed(df: DataFrame, key: str = "idx_news", date: str = "date") -> DataFrame:
    """(key, t): narrow rows with the time in microseconds."""
    return df.select(key, F.unix_micros(F.col(date).cast("timestamp")).alias("t"))


def _first_time(rows: DataFrame) -> int:
    return rows.agg(F.min("t")).first()[0] or 0


def anchors(df: DataFrame, look: Lookback, key: str = "idx_news") -> DataFrame:
    """Rows later than the first date plus the lookback."""
    rows = timed(df, key)
    return rows.filter(F.col("t") > _first_time(rows) + look.span)


def is_member(member: Column, anchor: Column, look: Lookback) -> Column:
    inside = (member > anchor - look.span) & (member <= anchor - look.gap)
    return inside | (member == anchor)


def _time_ranges(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name`` (range) and ``name``_part, and the ranges: (name, name_part, lo, hi).

    Spark cuts the times at sampled quantiles into ranges of about ``most`` rows, however the
    times bunch. Rows of one instant cannot be cut by time: a range of over twice ``most``
    rows is dealt into hash parts.
    """
    stored = cut_lineage(rows)
    ranges = max(1, math.ceil(stored.count() / most))
    # Stored, so that every later job sees the same ranges.
    parted = cut_lineage(stored.repartitionByRange(ranges, "t").withColumn(name, F.spark_partition_id()))
    sizes = parted.groupBy(name).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.greatest(F.lit(1), F.floor(F.count("*") / (2 * most)) + 1).alias("_parts"))
    sizes = small(sizes)
    dealt = parted.join(sizes.select(name, "_parts"), name).withColumn(f"{name}_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias(f"{name}_part")
    return dealt, sizes.select(name, parts, "lo", "hi")


def window_members(
    df: DataFrame, look: Lookback, of: DataFrame | None = None, key: str = "idx_news", rows: int = RANGE
) -> DataFrame:
    """(anchor_id, anchor_t, member_id, member_t) by a band join on ranges of time.

    ``of`` restricts the anchors (columns key, t). Anchors and members are cut into ranges of about
    ``rows`` rows. A range of anchors meets the ranges of members that its windows can
    reach, so no key of the join holds more than a range of either side, whether the articles
    come over years or in one hour; the exact bounds are a residual of the join.
    """
    members, m_ranges = _time_ranges(timed(df, key).select(F.col(key).alias("member_id"), "t"), rows, "mr")
    at = anchors(df, look, key) if of is None else of
    asked, a_ranges = _time_ranges(at.select(F.col(key).alias("anchor_id"), "t"), rows, "ar")
    # Ranges meet by the lookback-wide buckets that both touch.
    width = max(look.span, 1)

    def touch(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_b")

    left = a_ranges.select("ar", "ar_part", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), touch(F.col("lo") - look.span, F.col("hi")))
    right = m_ranges.select("mr", "mr_part", "lo", "hi", touch(F.col("lo"), F.col("hi")))
    reach = left.join(right, "_b").filter((F.col("lo") <= F.col("a_hi")) & (F.col("hi") > F.col("a_lo") - look.span))
    pairs = small(reach.select("ar", "ar_part", "mr", "mr_part").distinct())
    keys = ["ar", "ar_part", "mr", "mr_part"]
    anchored = asked.join(pairs, ["ar", "ar_part"]).select(*keys, "anchor_id", F.col("t").alias("anchor_t"))
    reached = members.join(pairs, ["mr", "mr_part"]).select(*keys, "member_id", F.col("t").alias("member_t"))
    # The narrow sides give far wider output: tasks must not be merged by the bytes they read.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = anchored.repartition(tasks, *keys).join(reached.repartition(tasks, *keys), keys)
    met = met.filter(is_member(F.col("member_t"), F.col("anchor_t"), look))
    return met.select("anchor_id", "anchor_t", "member_id", "member_t")


def eligible_anchors(df: DataFrame, look: Lookback, key: str = "idx_news") -> DataFrame:
    """(key, t, n_members, eligible) without forming a single pair.

    Every anchor asks for the number of rows up to two times. Questions and rows
    are sorted together once and a running count answers all of them. Dates are
    unique, so the anchor adds itself when the horizon shuts it out.
    """
    rows, asked = timed(df, key), anchors(df, look, key)
    probes = asked.select(
        key, F.col("t").alias("anchor_t"),
        F.explode(F.array(
            F.struct((F.col("t") - look.span).alias("t"), F.lit(-1).alias("sign")),
            F.struct((F.col("t") - look.gap).alias("t"), F.lit(1).alias("sign")),
        )).alias("p"),
    ).select(key, "anchor_t", "p.*")
    stream = rows.select(key, F.lit(None).cast("bigint").alias("anchor_t"), "t", F.lit(0).alias("sign"))
    stream = stream.unionByName(probes).withColumn("ask", F.col("sign") != 0)
    counted = running_total(stream, ["t", "ask", key, "sign"], (~F.col("ask")).cast("int"), "upto")
    own = 1 if look.gap > 0 else 0
    return (
        counted.filter("ask")
        .groupBy(key, F.col("anchor_t").alias("t"))
        .agg((F.sum(F.col("sign") * F.col("upto")) + own).alias("n_members"))
        .withColumn("eligible", F.col("n_members") >= look.min_news)
    )


def refit_schedule(df: DataFrame, look: Lookback, key: str = "idx_news", every: bool = False) -> DataFrame:
    """(key, t, n_members, eligible, refit, chain_id) for every anchor.

    A fit happens at the first eligible anchor of a UTC day and after a skipped
    one; later anchors of the chain extend it. ``chain_id`` is the key of the
    fitting anchor. ``every`` fits at each eligible anchor.
    """
    rows = eligible_anchors(df, look, key)
    if every:
        fits = F.col("eligible")
        return rows.withColumn("refit", fits).withColumn("chain_id", F.when(fits, F.col(key)))
    order = ["t", key]
    prior = previous_row(rows, order, {"_t": F.col("t"), "_ok": F.col("eligible")})

    def day(c: str) -> Column:
        return F.floor(F.col(c) / MICROS_PER_DAY)

    broken = F.col("_t").isNull() | ~F.col("_ok") | (day("_t") != day("t"))
    flagged = prior.withColumn("refit", F.col("eligible") & F.coalesce(broken, F.lit(True)))
    chained = last_marked(flagged.drop("_t", "_ok"), order, F.col("refit"), F.col(key), "chain_id")
    return chained.withColumn("chain_id", F.when(F.col("eligible"), F.col("chain_id")))


def _split(df: DataFrame, chain: str, rows: int, width: int) -> DataFrame:
    """Add bucket ``_b`` (time) and ``_s`` (hash part) so that a block has about ``rows`` rows."""
    timed_rows = df.withColumn("_b", F.floor(F.col("t") / width))
    sizes = timed_rows.groupBy(chain, "_b").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    joined = timed_rows.join(small(sizes), [chain, "_b"])
    return joined.withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts")


def window_blocks(
    at: DataFrame, members: DataFrame, look: Lookback, chain: str = "chain_id", rows: int = 2048
) -> DataFrame:
    """Anchor blocks beside the member blocks their windows can reach.

    Both frames hold (chain, id, t, …) with equal columns. Time buckets are one
    lookback wide, so a block of anchors meets two buckets of members; hash parts
    bound every block whatever the number of rows in a bucket. The result holds
    the rows of both sides (``is_anchor``) under the group key ``(chain, pair)``.
    """
    width = max(look.span, 1)
    left, right = _split(at, chain, rows, width), _split(members, chain, rows, width)
    block = [chain, "_b", "_s"]
    lefts = left.select(*block).distinct().select(
        chain, F.col("_b").alias("_ab"), F.col("_s").alias("_as"),
        F.explode(F.array(F.col("_b") - 1, F.col("_b"))).alias("_b"),
    )
    pairs = lefts.join(right.select(*block).distinct(), [chain, "_b"]).withColumn(
        "pair", F.concat_ws("-", "_ab", "_as", "_b", "_s")
    )
    pairs = small(pairs)
    anchored = left.join(
        pairs.select(chain, F.col("_ab").alias("_b"), F.col("_as").alias("_s"), "pair"), block
    )
    return (
        anchored.withColumn("is_anchor", F.lit(True))
        .unionByName(right.join(pairs.select(*block, "pair"), block).withColumn("is_anchor", F.lit(False)))
        .drop("_b", "_s")
    )


def block_counts(points: DataFrame, group: list[str], rows: int) -> DataFrame:
    """(group, _parts): number of hash blocks of about ``rows`` points."""
    return small(points.groupBy(*group).agg(F.ceil(F.count("*") / rows).alias("_parts")))


def pair_blocks(points: DataFrame, group: list[str], key: str, counts: DataFrame) -> DataFrame:
    """Points of each group under all pairs of hash blocks: key (group, lo, hi).

    No group, however large, reaches a task whole.
    """
    split = points.join(counts, group).withColumn("block", F.pmod(F.xxhash64(key), F.col("_parts")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_o")
    return (
        split.select("*", other)
        .withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")})
        .drop("_o", "_parts")
    )
