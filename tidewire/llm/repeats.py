"""Repeated windows at scale: from whole texts to small groups that a task can sort.

Every window of W symbols (bytes or words) contains an anchor, the k-gram with the
smallest hash in it; equal windows have equal anchors at equal distances. So texts are
cut into *contexts*: the windows that share an anchor. Anchors that occur once are done
with after one narrow shuffle; contexts that occur as a whole several times are repeats as
they are; only contexts whose anchor also occurs in a different context, which is where
copies begin, end or were edited, are cut again by longer anchors and compared window by
window by an operator's own method, in groups of one anchor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import symbols as sym
from tidewire.llm.common import discard, partitions, store

U = np.uint64
#: Contexts of one anchor that are compared in a task; more are keyed by their windows.
HOT = 4096
#: Contexts per task.
TASK = 20_000
#: Symbols of contexts that are cut at once: they overlap, so there are more than in the text.
CUT = 1 << 21


@dataclass(frozen=True)
class Shape:
    """What is compared: windows of ``window`` words or bytes, first and second anchors."""

    words: bool
    window: int
    coarse: int
    fine: int

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = sym.text_bytes(column)
        return sym.word_hashes(raw, offsets) if self.words else (raw, offsets)


def row_key() -> Column:
    """Tells rows apart: 64 bits over doc_id and text. Only rows alike in both share a key,
    and what repeats in one of them repeats in the other."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _pack(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows of a context in one number."""
    return (low.astype(np.int64) << 8) | count.astype(np.int64)


LOW = "shiftright(at, 8)"
COUNT = "(at & 255L)"


def contexts(docs: DataFrame, shape: Shape) -> DataFrame:
    """anchor, context, the ids of ``docs`` (all columns but text, which comes first), at of all contexts."""
    ids = docs.columns[1:]
    names = ["anchor", "context", *ids, "at"]

    def run(batches):
        for batch in batches:
            for a, b in sym.parts(sym.text_bytes(batch.column(0))[1]):
                values, offsets = shape.symbols(batch.column(0).slice(a, b - a))
                values, offsets, owner, begin = sym.long_runs(values, offsets, shape.window)
                got = sym.Runs(values, offsets).anchors(shape.coarse, shape.window)
                if len(got["run"]):
                    own = pa.array(a + owner[got["run"]])
                    at = _pack(got["low"] + begin[got["run"]], got["count"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got["anchor"].view(np.int64)), pa.array(got["context"].view(np.int64)), *(c.take(own) for c in batch.columns[1:]), pa.array(at)],
                        names=names,
                    )

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def refined(docs: DataFrame, open_: DataFrame, shape: Shape) -> DataFrame:
    """The contexts in ``open_`` (row, at, sure) cut again, with what lies round the anchor.

    Returns anchor, the ids of ``docs``, at, left (symbols before the anchor), around (their bytes
    and those behind), sure.
    """
    ids = docs.columns[1:]
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("at", "sure")).alias("cut"))
    joined = docs.join(wanted.hint("shuffle_hash"), "row").select("text", "cut", *ids)
    names = ["anchor", *ids, "at", "left", "around", "sure"]
    w, k = shape.window, shape.fine

    def cut(batch):
        values, offsets = shape.symbols(batch.column(0))
        lists = batch.column(1)
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = lists.flatten().field("at").to_numpy()
        sure = lists.flatten().field("sure").to_numpy(zero_copy_only=False)
        low, count = at >> 8, at & 255
        start = offsets[doc] + low
        size = count + w - 1
        for a, b in sym.parts(np.r_[0, np.cumsum(size)], CUT):
            yield slices(batch, values, *(x[a:b] for x in (doc, low, sure, start, size)))

    def slices(batch, values, doc, low, sure, start, size):
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        own = np.ascontiguousarray(values[index])
        got = sym.Runs(own, np.r_[0, ends]).anchors(k, w)
        r = got["run"]
        begin = (ends - size)[r]
        left = got["place"] - got["low"]
        stop = begin + got["low"] + got["count"] + w - 1
        a, b = begin + got["low"], begin + got["place"]
        around = [own[i:j].tobytes() + own[j + k : e].tobytes() for i, j, e in zip(a.tolist(), b.tolist(), stop.tolist())]
        own_ids = [c.take(pa.array(doc[r])) for c in batch.columns[2:]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(got["anchor"].view(np.int64)), *own_ids, pa.array(_pack(low[r] + got["low"], got["count"])),
                pa.array(left.astype(np.int32)), pa.array(around, pa.binary()), pa.array(sure[r]),
            ],
            names=names,
        )

    def run(batches):
        for batch in batches:
            for a, b in sym.parts(sym.text_bytes(batch.column(0))[1]):
                yield from cut(pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns], names=batch.schema.names))

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in ["anchor", *ids, "at"]) + ", left int, around binary, sure boolean")


def repeats(docs: DataFrame, shape: Shape, ordered: bool, compare: Callable) -> DataFrame:
    """row (``row_key``), low, count: runs of windows that repeat.

    ``ordered``: only windows that also start in a document with a smaller doc_id; otherwise
    windows that start anywhere else. ``compare(table, shape)`` is the operator's method for
    the groups of one task: it gives the rows and first windows and numbers of the runs that
    repeat. A null doc_id comes after all others here (2^63 - 1).
    """
    spark = docs.sparkSession
    ids = ["row", "doc_id"] if ordered else ["row"]
    keyed = docs.select("text", row_key().alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id")).select("text", *ids)
    every = store(contexts(keyed, shape))
    # Stored, so that both sides of the join are plain exchanges, which Spark can split.
    twice = store(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    shared = store(every.join(twice, "anchor"))
    discard(every, twice)
    one = F.min("doc_id").alias("first") if ordered else F.min(F.struct("row", "at")).alias("one")
    kinds = store(shared.groupBy("anchor", "context").agg(F.count("*").alias("times"), one))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    split = kinds.join(several, "anchor")
    if ordered:
        whole = shared.join(kinds.select("anchor", "context", "first"), ["anchor", "context"]).where("doc_id > first")
        open_ = shared.join(split.select("anchor", "context", "first"), ["anchor", "context"]).where("doc_id = first")
        open_ = open_.select("row", "at", F.lit(False).alias("sure"))
    else:
        whole = shared.join(kinds.where("times > 1").select("anchor", "context"), ["anchor", "context"])
        open_ = split.select("one.row", "one.at", (F.col("times") > 1).alias("sure"))
    whole = store(whole.select("row", "at"))
    open_ = store(open_)
    discard(shared, kinds)
    fine = store(refined(keyed, open_, shape))
    groups = store(fine.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    small, hot = groups.where(F.col("n") <= HOT).select("anchor"), groups.where(F.col("n") > HOT).select("anchor")
    tasks = max(partitions(spark), math.ceil(fine.count() / TASK))
    block = F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("block")

    def run(table):
        place, low, count = compare(table, shape)
        at = _pack((table.column("at").to_numpy()[place] >> 8) + low, count)
        return pa.Table.from_arrays([table.column("row").take(pa.array(place)), pa.array(at)], names=["row", "at"])

    grouped = fine.join(small, "anchor").select("*", block).groupBy("block").applyInArrow(lambda t: run(t), "row long, at long")
    found = store(whole.unionByName(grouped).unionByName(_by_window(fine.join(hot, "anchor"), shape, ordered)))
    discard(fine, open_, whole, groups)
    return found.select("row", F.expr(LOW).alias("low"), F.expr(COUNT).alias("count"))


def _by_window(fine: DataFrame, shape: Shape, ordered: bool) -> DataFrame:
    """The same question for anchors in very many contexts: one key per whole window."""
    unit = 8 if shape.words else 1
    size = (shape.window - shape.fine) * unit
    ids = ["row", "doc_id"] if ordered else ["row"]
    windows = fine.select(
        "anchor", *ids, "at", "sure", "left", "around", F.explode(F.expr(f"sequence(0L, {COUNT} - 1)")).alias("nth")
    ).select(
        *ids, "at", "sure", "nth",
        F.sha2(F.concat(F.col("anchor").cast("string").cast("binary"), F.lit(b"|"), (F.col("left") - F.col("nth")).cast("string").cast("binary"),
                        F.lit(b"|"), F.col("around").substr((F.col("nth") * unit + 1).cast("int"), F.lit(size))), 256).alias("window"),
    )
    if ordered:
        seen = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
        again = windows.join(seen, "window").where("doc_id > first")
    else:
        seen = windows.groupBy("window").agg(F.count("*").alias("n"), F.max("sure").alias("any")).where("n > 1 or any").select("window")
        again = windows.join(seen, "window")
    return again.select("row", F.expr(f"(shiftleft({LOW} + nth, 8) | 1L)").alias("at"))


def by_anchor(table: pa.Table):
    """Row numbers of each anchor's contexts, in order of doc_id (or row), then place."""
    first = "doc_id" if "doc_id" in table.column_names else "row"
    anchor, doc, at = (table.column(c).to_numpy() for c in ("anchor", first, "at"))
    order = np.lexsort((at, doc, anchor))
    cuts = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        yield order[a:b]


def runs_of(flags) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values."""
    out, start = [], None
    for i, x in enumerate([*flags, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            out.append((start, i - start))
            start = None
    return out


def remove(docs: DataFrame, found: DataFrame, shape: Shape, text: bool = False) -> DataFrame:
    """Take the symbols under ``found`` windows out of every row of ``docs``.

    Returns doc_id, n (symbols), n_removed, n_spans, kept_sha256, and with ``text`` all
    columns of ``docs`` with the kept text in place of theirs.
    """
    spans = found.groupBy("row").agg(F.collect_set(F.struct("low", "count")).alias("_spans"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if text else []
    rows = docs.select(row_key().alias("_row"), "doc_id", "text", *rest)
    joined = rows.join(spans.select(F.col("row").alias("_row"), "_spans").hint("shuffle_hash"), "_row", "left").select("doc_id", "text", *rest, "_spans")
    counted = "n long, n_removed long, n_spans long, kept_sha256 string"
    fields = docs.select("doc_id", *rest).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [counted] + ["text string"] * text)

    def one(raw: bytes, words: tuple | None, spans: list | None):
        n = len(words[0]) if words else len(raw)
        gone = []
        for low, count in sorted((s["low"], s["count"]) for s in spans or ()):
            stop = low + count + shape.window - 1
            if gone and low <= gone[-1][1]:
                gone[-1][1] = max(gone[-1][1], stop)
            else:
                gone.append([low, stop])
        edges = [0, *[e for span in gone for e in span], n]
        kept = list(zip(edges[::2], edges[1::2]))
        if words:
            body = b" ".join(raw[words[0][i] : words[1][i]] for a, b in kept for i in range(a, b))
            if not text:
                left = body
            elif gone:
                # What stands between kept words stays as it was.
                cuts = [0, *[x for a, b in gone for x in (int(words[0][a]), int(words[0][b]) if b < n else len(raw))], len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            else:
                left = raw
        else:
            body = left = b"".join(raw[a:b] for a, b in kept) if gone else raw
        return n, sum(b - a for a, b in gone), len(gone), hashlib.sha256(body).hexdigest(), left

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            raw, offsets = sym.text_bytes(column)
            start, stop, first = sym.word_spans(raw, offsets) if shape.words else (None, None, None)
            spans = batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                words = None
                if shape.words:
                    own = slice(first[i], first[i + 1])
                    words = ((start[own] - a), (stop[own] - a))
                out.append(one(raw[a:b].tobytes(), words, spans[i]))
            n, removed, runs, sha, left = zip(*out) if out else ((),) * 5
            columns = [batch.column(0), *batch.columns[2:-1], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", *rest, "n", "n_removed", "n_spans", "kept_sha256"]
            if text:
                # A span may cut a character in two; what is left of it cannot stay in a string.
                columns.append(pa.array([None if v is None and not x else x.decode("utf-8", "ignore") for v, x in zip(_nulls(column), left)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)


def _nulls(column: pa.Array) -> list:
    return [None if not v else True for v in column.is_valid().to_pylist()]
