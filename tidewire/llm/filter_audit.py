"""Filter interaction audit: what every order of a set of filters removes, in one reading.

A row that fails some of the filters has a mask. Each mask stands for one wide integer with
64 bits for every counter of every step of every order, so a part's audit is the sum of its
rows' integers: a counter stays below 2^64, so none runs over into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import let, store, words_of

#: Counters of a step, in the order of their fields.
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Parts whose sums a task holds at once, and ways into which a part's sums are dealt.
HOLD, SALTS = 512, 32
WORD = 8


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang, null: empty), mask of every row: bit i stands for the i-th of ABCDE.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * [A-Z] > 10 * code
    points; D: any of #$%&*|; E: the text of a smaller doc_id too. A null text is empty. A
    null doc_id is smaller than none and has no smaller one; rows that share a doc_id and
    a text are no copies of each other. Texts are compared by SHA-256.
    """
    text = F.coalesce("text", F.lit(""))

    def bits(words: Column) -> Column:
        n, kinds = F.size(words), F.size(F.array_distinct(words))
        capitals = F.regexp_count(text, F.lit("[A-Z]"))
        fails = [n < 100, 100 * kinds < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    rows = store(docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), let(words_of(F.col("text")), bits).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    ))
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # Both keys of the join together name one text of one doc_id: a hot text spreads.
    copied = F.when(F.col("first").isNull(), 16).otherwise(0)
    judged = named.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + copied).alias("mask"))
    return judged.unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def with_labels(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic: whether any label row of the doc_id has quality, toxic = 1."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Equal rows count together first, so no doc_id, however often it comes, is hot in the join.
    keys = ["doc_id", "part", "mask"]
    counted = masked.where("doc_id is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    joined = counted.join(known, "doc_id", "left").select("part", "mask", "good", "toxic", "n")
    none = masked.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    rest = none.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return joined.na.fill({"good": False, "toxic": False}).unionByName(rest)


def step_fields(filters: int) -> np.ndarray:
    """The counters that a row of every (mask, good, toxic) adds to, one row each.

    Row number: mask + 2^filters * good + 2^(filters + 1) * toxic. Columns: for each of
    ``COUNTERS`` all steps of all orders, then for each filter the rows that fail it alone.
    """
    orders = np.array(list(permutations(range(filters))))
    mask = np.arange(1 << (filters + 2))
    fails = mask[:, None, None] >> orders[None] & 1
    before = np.cumsum(fails, axis=2) - fails
    removed, redundant = fails * (before == 0), fails * (before > 0)
    kept = (fails + before) == 0
    good, toxic = mask >> filters & 1, mask >> (filters + 1) & 1
    counters = [kept, removed, redundant, removed * good[:, None, None], removed * toxic[:, None, None]]
    alone = (mask & ((1 << filters) - 1))[:, None] == 1 << np.arange(filters)
    return np.concatenate([*(c.reshape(len(mask), -1) for c in counters), alone], axis=1).astype(np.uint64)


def _packed(fields: np.ndarray) -> int:
    return int.from_bytes(fields.astype("<u8").tobytes(), "little")


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``rows``: part (string), mask (bit i: fails the i-th filter), good, toxic (boolean), n
    (rows alike). Returns part, filter_order, step, the ``COUNTERS``, unique_fails (rows of the part
    that fail this filter alone) and shapley (removed by this filter over all orders). A part
    is there if it has a row; without rows there is no part. Up to seven filters.
    """
    k = len(letters)
    if not 1 <= k <= 7:
        raise ValueError("one to seven filters")
    table, steps = step_fields(k), factorial(k) * k
    width = WORD * table.shape[1]
    orders = ["".join(o) for o in permutations(letters)]
    place = np.array([[letters.index(c) for c in o] for o in orders]).ravel()
    between = pa.schema([("part", pa.string()), ("salt", pa.int32()), ("packed", pa.binary())])

    def emit(sums: dict) -> pa.RecordBatch:
        names = list(sums)
        salts = [TaskContext.get().partitionId() % SALTS] * len(names)
        packed = [sums[p].to_bytes(width, "little") for p in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(salts, pa.int32()), pa.array(packed, pa.binary())], schema=between)

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        integers: dict[int, int] = {}
        sums: dict[str, int] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            kind = batch.column(1).to_numpy() | batch.column(2).cast(pa.int32()).to_numpy() << k | batch.column(3).cast(pa.int32()).to_numpy() << (k + 1)
            times = batch.column(4).to_numpy()
            code = names.indices.to_numpy().astype(np.int64) * len(table) + kind
            words = names.dictionary.to_pylist()
            codes, at = np.unique(code, return_inverse=True)
            counts = np.zeros(len(codes), dtype=np.int64)
            np.add.at(counts, at, times)
            for c, n in zip(codes.tolist(), counts.tolist()):
                part, which = words[c // len(table)], c % len(table)
                if which not in integers:
                    integers[which] = _packed(table[which])
                sums[part] = sums.get(part, 0) + n * integers[which]
            if len(sums) >= HOLD:
                yield emit(sums)
                sums = {}
        if sums:
            yield emit(sums)

    def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
                sums[part] = sums.get(part, 0) + int.from_bytes(packed.as_py(), "little")
                if len(sums) >= HOLD:
                    yield emit(sums)
                    sums = {}
        if sums:
            yield emit(sums)

    def unpacked(part: str, total: int) -> pa.RecordBatch:
        fields = np.frombuffer(total.to_bytes(width, "little"), dtype="<u8").astype(np.int64)
        by = {c: fields[i * steps : (i + 1) * steps] for i, c in enumerate(COUNTERS)}
        shapley = np.bincount(place, weights=by["removed"], minlength=k)
        if by["removed"].sum() >= 1 << 53:
            shapley = np.array([sum(by["removed"][place == f].tolist()) for f in range(k)])
        columns = {
            "part": pa.array([part] * steps, pa.string()), "filter_order": pa.array(np.repeat(orders, k), pa.string()),
            "step": pa.array(np.tile(np.arange(1, k + 1), len(orders)).astype(np.int32)),
            **{c: pa.array(v) for c, v in by.items()},
            "unique_fails": pa.array(fields[len(COUNTERS) * steps :][place]), "shapley": pa.array(shapley.astype(np.int64)[place]),
        }
        return pa.RecordBatch.from_pydict(columns)

    def read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
                if part != now and now is not None:
                    yield unpacked(now, total)
                    total = 0
                now, total = part, total + int.from_bytes(packed.as_py(), "little")
        if now is not None:
            yield unpacked(now, total)

    shape = "part string, salt int, packed binary"
    # Stored, so that a task that runs again deals the same sums to the same places.
    partial = store(rows.select("part", F.col("mask").cast("int"), "good", "toxic", F.col("n").cast("bigint")).mapInArrow(add_rows, shape))
    dealt = partial.repartition("part", "salt").mapInArrow(add_sums, shape)
    longs = ", ".join(f"{c} long" for c in (*COUNTERS, "unique_fails", "shapley"))
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(read_out, f"part string, filter_order string, step int, {longs}")
