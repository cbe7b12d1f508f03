"""Substring dedup: relative Lempel-Ziv factors against earlier documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.repeats import Shape, by_anchor, remove, repeats

WORDS = Shape(words=True, window=50, coarse=25, fine=40)


def compare(table: pa.Table, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factor every context of one task greedily against its anchor's reference block.

    The block of an anchor holds the distinct contexts of documents with smaller ids. All
    align at the anchor, so a factor's reach to either side is one comparison of arrays. A
    factor of at least a whole window is a duplicate span; the next factor is sought at the
    first window that goes past its end.
    """
    width = shape.window - shape.fine
    left = table.column("left").to_numpy()
    doc = table.column("doc_id").to_numpy()
    count = table.column("at").to_numpy() & 255
    around = [np.frombuffer(x, dtype=np.uint64) for x in table.column("around").to_pylist()]
    rows, lows, counts = [], [], []
    for group in by_anchor(table):
        if doc[group[0]] == doc[group[-1]]:
            continue
        n = len(group)
        # Symbols outward from the anchor; `reach` has how many there are.
        before, behind = np.zeros((n, width), dtype=np.uint64), np.zeros((n, width), dtype=np.uint64)
        reach = np.zeros((n, 2), dtype=np.int64)
        for i, r in enumerate(group.tolist()):
            a, b = around[r][: left[r]][::-1], around[r][left[r] :]
            before[i, : len(a)], behind[i, : len(b)], reach[i] = a, b, (len(a), len(b))
        block: list[int] = []  # distinct contexts
        seen: set[tuple] = set()
        fresh: list[int] = []
        for i, r in enumerate(group.tolist()):
            if i and doc[r] != doc[group[i - 1]]:
                block += fresh
                fresh = []
            key = (left[r], around[r].tobytes())
            if key not in seen:
                seen.add(key)
                fresh.append(i)
            if block:
                b = np.array(block)
                goes_left = _agree(before[b] == before[i], np.minimum(reach[b, 0], reach[i, 0]))
                goes_right = _agree(behind[b] == behind[i], np.minimum(reach[b, 1], reach[i, 1]))
                s = 0
                while s < count[r]:
                    back = left[r] - s
                    able = goes_left >= back
                    far = int(goes_right[able].max()) if able.any() else -1
                    if back + far >= width and far >= 0:
                        windows = back + far - width + 1
                        rows.append(r)
                        lows.append(s)
                        counts.append(min(windows, int(count[r]) - s))
                        s += windows
                    else:
                        s += 1
    return np.array(rows, dtype=np.int64), np.array(lows, dtype=np.int64), np.array(counts, dtype=np.int64)


def _agree(same: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading columns agree in each row, at most ``most``."""
    run = np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))
    return np.minimum(run, most)


def dedup(docs: DataFrame, text: bool = False) -> DataFrame:
    """Remove every word covered by 50 words that also start in a document with a smaller id.

    Per row: doc_id, n (words), n_removed, n_spans, kept_sha256 (kept words joined by one
    space), and with ``text`` the columns of ``docs`` with what is left. A null text has no
    words. Rows with one doc_id never remove each other's words; a null doc_id comes last.
    Windows never cross texts and are judged on the input. Words, anchors and contexts are
    compared by 64-bit hashes. A text of one row must fit a task.
    """
    found = repeats(docs, WORDS, ordered=True, compare=compare)
    return remove(docs, found, WORDS, text)
