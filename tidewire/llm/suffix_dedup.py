"""Suffix-array dedup: bytes in long strings that start somewhere else too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.repeats import Shape, by_anchor, remove, repeats, runs_of
from tidewire.llm.suffix import suffix_array

BYTES = Shape(words=False, window=200, coarse=100, fine=180)


def compare(table: pa.Table, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that repeat within the groups of one task, by one suffix array per anchor.

    A group's distinct contexts are laid end to end, each anchor as one symbol and an own,
    smallest symbol behind each context, so that no match crosses an end. Suffixes that
    share their first window stand next to each other in the suffix array.
    """
    left, around, at, sure = (table.column(c).to_pylist() for c in ("left", "around", "at", "sure"))
    width = shape.window - shape.fine  # symbols of a window beside its anchor
    rows, lows, counts = [], [], []
    for group in by_anchor(table):
        kinds: dict[tuple[int, bytes], list[int]] = {}
        for r in group.tolist():
            kinds.setdefault((left[r], around[r]), []).append(r)
        again = _repeated(list(kinds), width) if len(kinds) > 1 else {}
        for c, own in enumerate(kinds.values()):
            known = len(own) > 1 or sure[own[0]]
            n = at[own[0]] & 255
            found = [(0, n)] if known else runs_of(again.get(c, ()))
            for r in own:
                for low, count in found:
                    rows.append(r)
                    lows.append(low)
                    counts.append(count)
    return np.array(rows, dtype=np.int64), np.array(lows, dtype=np.int64), np.array(counts, dtype=np.int64)


def _repeated(kinds: list[tuple[int, bytes]], width: int) -> dict[int, list[bool]]:
    """For each context the windows that also start in another one."""
    g = len(kinds)
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    out = {}
    for c, (left, around) in enumerate(kinds):
        spelled = [g + b for b in around]
        text += [*spelled[:left], g + 256, *spelled[left:], g - 1 - c]
        owner += [(c, i) for i in range(len(around) + 2)]
        # A window holds the anchor and `width` more symbols.
        out[c] = [False] * max(0, len(around) - width + 1)
    before = None
    for p in suffix_array(text):
        c, i = owner[p]
        if i >= len(out[c]):
            continue
        left, around = kinds[c]
        here = (left - i, around[i : i + width])
        if before is not None and before[0] == here:
            out[c][i] = True
            out[before[1]][before[2]] = True
        before = (here, c, i)
    return out


def dedup(docs: DataFrame, text: bool = False) -> DataFrame:
    """Remove every byte covered by a 200-byte string that also starts anywhere else.

    Per row: doc_id, n (UTF-8 bytes), n_removed, n_spans (maximal removed runs), kept_sha256
    (of the bytes left), and with ``text`` the columns of ``docs`` with what is left. A null
    text is empty. Rows with equal texts remove each other from 200 bytes on, repeated rows
    too. Strings never cross texts and are judged on the input. Anchors and contexts are
    compared by 64-bit hashes. A text of one row must fit a task.
    """
    found = repeats(docs, BYTES, ordered=False, compare=compare)
    return remove(docs, found, BYTES, text)
