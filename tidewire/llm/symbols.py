"""Texts as arrays inside tasks: bytes, words, hashes of spans, window minimizers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Symbols hashed at once; more than this only for one longer document.
CHUNK = 1 << 18
_BASE = 0xD6E8FEB86659FD93  # any odd number
_PLACE = (1 << 22) - 1
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Powers:
    up = np.ones(1, dtype=U)
    down = np.ones(1, dtype=U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * CHUNK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, U(base))
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=U))
        return cls.up[:n], cls.down[:n]


class Runs:
    """Several sequences of 64-bit symbols laid end to end: ``offsets`` has their ends."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray) -> None:
        self.n, self.offsets = len(symbols), offsets
        up, self._down = _Powers.of(self.n + 1)
        self._sums = np.zeros(self.n + 1, dtype=U)
        np.cumsum((symbols.astype(U) + U(1)) * up[: self.n], out=self._sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the content of every span."""
        content = (self._sums[stop] - self._sums[start]) * self._down[start]
        return mix(content + (stop - start).astype(U) * U(0x9E3779B97F4A7C15))

    def all_hashes(self, k: int) -> np.ndarray:
        content = (self._sums[k:] - self._sums[:-k]) * self._down[: self.n - k + 1]
        return mix(content + U(k * 0x9E3779B97F4A7C15 % 2**64))

    def anchors(self, k: int, window: int) -> dict[str, np.ndarray]:
        """Every window's k-symbol minimizer, as runs of windows that share one.

        ``run``: sequence; ``low``, ``count``: first window and number of windows, ``place``: the
        anchor, all within the sequence; ``anchor``: its hash; ``context``: hash of all that the
        windows cover. Equal windows have equal anchors at equal distances.
        """
        empty = {c: np.zeros(0, dtype=np.int64) for c in ("run", "low", "count", "place")}
        empty |= {c: np.zeros(0, dtype=U) for c in ("anchor", "context")}
        if self.n < window:
            return empty
        if self.n > _PLACE:
            raise ValueError("cut longer sequences into overlapping ones")
        hashed = self.all_hashes(k)
        # Order by the upper bits; of equal ones the last place wins.
        key = (hashed & ~U(_PLACE)) | (U(_PLACE) - np.arange(len(hashed), dtype=U))
        width, size = window - k + 1, 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        place = _PLACE - (key & U(_PLACE)).astype(np.int64)
        run = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        starts = np.flatnonzero(run[: len(place)] == run[window - 1 : window - 1 + len(place)])
        if not len(starts):
            return empty
        at = place[starts]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (run[starts[1:]] != run[starts[:-1]])])
        low, last = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
        own, place = run[low], at[first]
        return {
            "run": own, "low": low - self.offsets[own], "count": last - low + 1, "place": place - self.offsets[own],
            "anchor": hashed[place],
            "context": self.hashes(low, last + window) ^ mix((place - low).astype(U) + U(1)),
        }


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about ``size`` symbols, at least one each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word (one entry more)."""
    solid = np.zeros(len(raw) + 2, dtype=bool)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    stop = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash per word, and each document's first word (one entry more)."""
    if lower:
        raw = _LOWER[raw]
    start, stop, first = word_spans(raw, offsets)
    return Runs(raw, offsets).hashes(start, stop), first


def long_runs(symbols: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut sequences too long for ``anchors`` into overlapping ones that hold all windows.

    Returns symbols, offsets, and for each piece its sequence and where it starts there.
    """
    most = _PLACE // 2
    if len(symbols) <= _PLACE:
        n = len(offsets) - 1
        return symbols, offsets, np.arange(n), np.zeros(n, dtype=np.int64)
    cut, owner, begin = [], [], []
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        for at in range(0, max(1, b - a - window + 1), most):
            cut.append(symbols[a + at : min(b, a + at + most + window - 1)])
            owner.append(d)
            begin.append(at)
    return np.concatenate(cut), np.r_[0, np.cumsum([len(c) for c in cut])], np.array(owner), np.array(begin)
