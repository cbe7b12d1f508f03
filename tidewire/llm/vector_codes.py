"""Vector code compression: short codes by product quantisation, learned in active-entry Lloyd rounds.

A vector is cut into parts, and each part becomes the index of its nearest codebook entry.
All arithmetic is on integers, so results do not depend on how the rows are partitioned. A
round stores every part's entry and its exact distance. In the next round a part whose entry
did not move still has that distance, so only entries that moved can be nearer: it is compared
with these alone. Parts whose entry moved are compared with the whole codebook.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import discard, store
from tidewire.session import small

#: Rows of one label meet the label's total under this many keys.
SALTS = 16


@dataclass
class Codebooks:
    """``entries``: (parts, entries, width) integers; ``compared``: distances taken in each pass."""

    entries: np.ndarray
    compared: list[int] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def finite(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds neither null nor non-finite components."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(ok, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, short lists filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def full_scan(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the lowest index on a tie, and its squared distance."""
    far = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(part)), code]


def active_scan(
    part: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the last round's answer; also how many distances it took.

    An entry that stayed was no better than a part's own one last round, so against an own
    entry that stayed too it is no better now, ties included.
    """
    code, far = code.copy(), far.copy()
    lost = moved[code]
    fixed = np.flatnonzero(~lost)
    changed = np.flatnonzero(moved)
    code[lost], far[lost] = full_scan(part[lost], book)
    if len(fixed) and len(changed):
        pick, near = full_scan(part[fixed], book[changed])
        pick = changed[pick]
        better = (near < far[fixed]) | ((near == far[fixed]) & (pick < code[fixed]))
        code[fixed[better]], far[fixed[better]] = pick[better], near[better]
    return code, far, int(lost.sum()) * len(book) + len(fixed) * len(changed)


def _pass(rows: DataFrame, book: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Every part's entry and distance under ``book``; rows with ``sums`` hold what the tasks
    added up: per part and entry the count, then the components' sums, at the end the
    distances taken. ``moved`` None: there is no earlier round."""
    parts, entries, width = book.shape
    names = ["vec_id", "label", "v", "code", "far", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int32).reshape(n, parts, width).astype(np.int64)
            code, far = np.zeros((n, parts), dtype=np.uint8), np.zeros((n, parts), dtype=np.int64)
            if moved is not None:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, parts)
                was = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.int64).reshape(n, parts)
            sums = np.zeros((parts, entries, 1 + width), dtype=np.int64)
            taken = 0
            for p in range(parts):
                if moved is None:
                    own, far[:, p] = full_scan(v[:, p], book[p])
                    taken += n * entries
                else:
                    own, far[:, p], count = active_scan(v[:, p], book[p], moved[p], old[:, p].astype(np.int64), was[:, p])
                    taken += count
                code[:, p] = own
                np.add.at(sums[p, :, 0], own, 1)
                np.add.at(sums[p, :, 1:], own, v[:, p])
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            columns = [*batch.columns[:3], pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary()), nothing]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            added = pa.array([[*sums.ravel().tolist(), taken]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in columns[:-1]), added], names=names)

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, v binary, code binary, far binary, sums array<long>")


def learn(
    vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame | None, Codebooks]:
    """The rows under their final codes (vec_id, label, v, code, far), stored, and the codebooks.

    Rows that ``finite`` drops are left out. A component x is floor(scale * x); one of 2^30 /
    sqrt(length) or more in size counts as non-finite, since squared distances must fit 64
    bits. The longest vector decides the length, rounded up to a multiple of ``parts``; shorter
    ones are filled up with zeros. The codebooks start as the parts of the ``entries`` smallest vec_ids,
    nulls last, equal ones by their vectors; with fewer rows there are fewer entries. No rows: None.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are one byte")
    known = finite(vectors, vector).select("vec_id", "label", F.col(vector).cast("array<double>").alias("x"))
    longest = known.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None, Codebooks(np.zeros((parts, 0, 0), dtype=np.int64))
    width = max(1, math.ceil(longest / parts))
    limit = 2.0**30 / math.sqrt(parts * width) / scale
    known = known.where(F.forall("x", lambda x: F.abs(x) < limit))
    first = known.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None, Codebooks(np.zeros((parts, 0, width), dtype=np.int64))
    start = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        start[i, : len(r.x)] = r.x
    books = Codebooks(np.floor(start * scale).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy())
    label = known.schema["label"].dataType.simpleString()
    names = ["vec_id", "label", "v"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(_matrix(batch.column(2), parts * width) * scale).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in v], pa.binary())], names=names)

    now = store(known.mapInArrow(whole, f"vec_id long, label {label}, v binary"))
    moved = None
    for nth in range(rounds + 1):
        read = now if moved is None else now.where("sums is null").drop("sums")
        after = store(_pass(read, books.entries, moved))
        discard(now)
        now = after
        sums = now.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n"))
        # As many numbers as the codebooks hold, whatever the rows.
        total = {r.pos: int(r.n) for r in sums.collect()}
        books.compared.append(total.pop(max(total)))
        if nth == rounds:
            break
        sums = np.array([total[i] for i in range(len(total))], dtype=np.int64).reshape(parts, -1, 1 + width)
        n = sums[:, :, :1]
        fresh = np.where(n > 0, np.floor_divide(sums[:, :, 1:], np.maximum(n, 1)), books.entries)
        moved = (fresh != books.entries).any(axis=2)
        books.entries = fresh
    return now.where("sums is null").drop("sums"), books


def compress(vectors: DataFrame, vector: str = "embedding", **options) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (two hex digits a part), error (squared distances over all parts), and the codebooks.

    Options and the treatment of odd rows: ``learn``.
    """
    rows, books = learn(vectors, vector, **options)
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if rows is None:
        return vectors.sparkSession.createDataFrame([], schema), books
    parts = len(books.entries)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int64).reshape(-1, parts).sum(axis=1)
            code = pa.array([c.hex() for c in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(far)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "code", "far").mapInArrow(spell, schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows with the same label, nulls together.

    The totals are broadcast if their measured bytes allow it; beyond that a label's rows
    meet its total under ``SALTS`` keys.
    """
    totals = small(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("r")
    joined = rows.join(spread.alias("t"), F.col("r.label").eqNullSafe(F.col("t.label")) & (F.col("r.salt") == F.col("t.salt")))
    return joined.select("r.vec_id", "r.label", "r.code", "r.error", "t.label_error")
