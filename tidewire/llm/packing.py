"""Packing documents into sequences: a configuration linear program, then a greedy for the rest."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import partitions, store

EOS = 2
#: Rows handed to the tokenizer at once.
TOKENIZED_ROWS = 64
#: Characters of white space in a row from which a text goes to the slower library: the
#: pattern's look-ahead keeps one step of its stack for each and fails near a million.
LONG_SPACE = 200_000


def _encoder(vocabulary: str):
    """Ids of the byte-level vocabulary in a ``tokenizers`` file.

    The merges run in tiktoken, which gives the same ids several times faster: the ids
    are the ranks of the merges, the split pattern is the file's, and the strings of its
    added tokens are one id each wherever they stand in a text. Returns a function from a text to
    its ids.
    """
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        made = json.load(f)
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the
    # others, in order, for the characters from U+0100.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    long_space = re.compile(rf"\s{{{LONG_SPACE}}}")
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        if len(text) < LONG_SPACE or not long_space.search(text):
            return fast.encode(text, allowed_special="all")
        from tokenizers import Tokenizer

        slow = slow or Tokenizer.from_file(vocabulary)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def tokenize(docs: DataFrame, vocabulary: str, width: int = 1024) -> DataFrame:
    """The pieces of every row: doc_id, row_key, piece, start, length, ids_crc32.

    A document is its ids and then one id 2; a null or empty text is that id alone. Only
    a document longer than ``width`` is cut, into full pieces after a shorter first
    one. ``row_key`` tells repeated rows apart. Ids stay in the task; ``encode`` gives
    them for one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, TOKENIZED_ROWS):
                part = batch.slice(at, TOKENIZED_ROWS)
                out: list[tuple] = []
                for doc, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                    ids = np.array([*encode(text or ""), EOS], dtype="<u4")
                    first = len(ids) if len(ids) <= width else len(ids) % width or width
                    cuts = [0, *range(first, len(ids), width), len(ids)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((doc, key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("row_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])
    rows = docs.select("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, width: int) -> np.ndarray:
    """Unbounded knapsack: the lengths of the most valuable pattern that fits ``width``.

    ``values[l]`` is what a piece of length l is worth. The table is filled capacity by
    capacity, each step one vector operation over all lengths.
    """
    best = np.zeros(width + 1)
    pick = np.zeros(width + 1, dtype=np.int64)
    for room in range(1, width + 1):
        gain = values[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(np.argmax(gain))
        if gain[k] > best[room - 1] + 1e-15:
            best[room], pick[room] = gain[k], k + 1
        else:
            best[room], pick[room] = best[room - 1], 0
    out, room = [], width
    while room > 0:
        if pick[room]:
            out.append(pick[room])
            room -= pick[room]
        else:
            room -= 1
    return np.array(out, dtype=np.int64)


def solve(counts: np.ndarray, width: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences follow each.

    ``counts[l]`` pieces have length l. The configuration LP asks for the fewest patterns
    that cover all counts. Multiplicative weights hold a price per length: each round a
    knapsack DP prices the best pattern, and lengths it covers become cheaper. The
    average of the rounds, scaled to cover the counts, is rounded down; what is left is
    filled greedily (``fill``) until everything is placed; that is nearly all, as the rounds
    are too few for about 1,000 lengths (figures in the README). Work and memory depend on
    ``width`` and ``rounds``, never on the number of pieces.
    """
    counts = counts.astype(np.int64).copy()
    plan: dict[tuple[int, ...], int] = {}

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan[pattern] = plan.get(pattern, 0) + times
            for length in pattern:
                counts[length] -= times

    take((width,), int(counts[width]))
    used = np.flatnonzero(counts)
    if len(used):
        demand = counts[used].astype(float)
        weight = np.ones(len(used))
        tally: dict[tuple[int, ...], float] = {}
        covered = np.zeros(len(used))
        slot = np.zeros(width + 1, dtype=np.int64)
        slot[used] = np.arange(len(used))
        for _ in range(rounds):
            values = np.zeros(width + 1)
            values[used] = weight / demand
            chosen = price(values / values.sum(), width)
            have = np.bincount(slot[chosen], minlength=len(used))
            on = have > 0
            times = float(np.min(demand[on] / have[on]))
            pattern = tuple(sorted((int(x) for x in chosen), reverse=True))
            tally[pattern] = tally.get(pattern, 0.0) + times
            share = have * times / demand
            covered += share
            weight *= np.exp(-0.5 * share)
            weight = np.maximum(weight / weight.max(), 1e-12)
        scale = 1 / max(float(covered.max()), 1e-12)
        for pattern, times in sorted(tally.items(), key=lambda x: -x[1]):
            own = np.bincount(np.array(pattern), minlength=width + 1)
            on = own > 0
            take(pattern, min(int(times * scale), int(np.min(counts[on] // own[on]))))
    while counts.any():
        pattern = fill(counts, width)
        own = np.bincount(np.array(pattern), minlength=width + 1)
        on = own > 0
        take(pattern, int(np.min(counts[on] // own[on])))
    return list(plan.items())


def fill(counts: np.ndarray, width: int) -> tuple[int, ...]:
    """The longest piece left and, with it, what fills the sequence best."""
    longest = int(np.flatnonzero(counts)[-1])
    left = counts.copy()
    left[longest] -= 1
    out, room = [longest], width - longest
    while room > 0:
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            break
        # Exact fit by one or two pieces if there is one, else the longest that fits.
        length = int(have[-1])
        if length < room:
            two = have[(room - have >= 1) & (left[room - have] > (have == room - have))]
            if len(two):
                length = int(two[-1])
        left[length] -= 1
        out.append(length)
        room -= length
    return tuple(sorted(out, reverse=True))


@dataclass
class Plan:
    """For each length, the runs of places its pieces take in order of their rank."""

    width: int
    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]], width: int) -> Plan:
        plan, taken = cls(width), {}
        for pattern, times in patterns:
            offset = 0
            for length in pattern:
                rank = taken.get(length, 0)
                plan.runs.setdefault(length, []).append((rank, times, plan.sequences, offset))
                taken[length] = rank + times
                offset += length
            plan.sequences += times
        return plan


def pack(pieces: DataFrame, width: int = 1024, rounds: int = 400) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (any frame with a length column).

    The histogram of lengths (at most ``width`` rows) is all the driver sees; the plan it
    makes has runs of ranks per length, and a piece finds its place from its rank among
    the pieces of its length. Ranks come from counts per stored part and length, so no
    length is gathered in one task. Lengths must be 1 to ``width``; an empty table gives
    no rows.
    """
    bad = pieces.where((F.col("length") < 1) | (F.col("length") > width) | F.col("length").isNull())
    if not bad.isEmpty():
        raise ValueError(f"piece lengths must be 1 to {width}")
    names = pieces.columns
    spark = pieces.sparkSession
    histogram = np.zeros(width + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    plan = Plan.of(solve(histogram, width, rounds), width)
    # The plan as rows: as many as patterns have places, bounded by rounds and width.
    rows = [(length, rank, rank + n, seq, off) for length, runs in plan.runs.items() for rank, n, seq, off in runs]
    places = spark.createDataFrame(rows, "length long, low long, high long, sequence long, offset long")
    per_length = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "sequence", "offset"))).alias("_runs"))
    salt = F.pmod(F.xxhash64(*names), F.lit(partitions(spark))).cast("int")
    dealt = pieces.withColumn("_part", salt)
    counted = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")
    carried = counted.select("length", "_part", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_part").orderBy(*names))
    ranked = dealt.withColumn("_rank", inside - 1).join(carried, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    run = F.filter("_runs", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"]))
    placed = ranked.join(F.broadcast(per_length), "length").withColumn("_run", F.get(run, F.lit(0)))
    return placed.select(
        *names,
        (F.col("_run.sequence") + F.col("_rank") - F.col("_run.low")).alias("sequence_id"),
        F.col("_run.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, width: int = 1024) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs``; see ``tokenize`` and ``pack``."""
    return pack(store(tokenize(docs, vocabulary, width)), width)
