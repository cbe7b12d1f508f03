"""Block work inside tasks.

Distances are evaluated between two bounded blocks of vectors and reduced in the
task: what leaves it grows with the rows of the blocks, never with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(table: pa.Table, col: str) -> np.ndarray:
    values = table.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1)


def column(table: pa.Table, col: str) -> np.ndarray:
    return table.column(col).to_numpy()


def units(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def distances(a: np.ndarray, b: np.ndarray, metric: str, same: bool = False) -> np.ndarray:
    if metric == "cosine":
        d = np.maximum(1.0 - units(a) @ units(b).T, 0.0)
    elif metric == "euclidean":
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        d = np.sqrt(np.maximum(squares, 0.0))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    if same:
        np.fill_diagonal(d, 0.0)
    return d


def vectors(rows: np.ndarray) -> pa.Array:
    """A matrix as one list per row."""
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets[: len(rows) + 1]), pa.array(rows.ravel()))


def per_group(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(key values, table) -> {column: values}`` on each bounded group.

    The key columns are repeated in front of the returned ones. Rows are exchanged on all
    keys: a coarser partitioning left over from a join would put all blocks of a window into
    one task, and the halves of a union need not agree on one.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(key, table):
        values = tuple(k.as_py() for k in key)
        out = fn(values, table)
        n = len(next(iter(out.values())))
        arrays = {c: pa.array([v] * n, type=k.type) for c, v, k in zip(keys, values, key)}
        arrays.update({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in out.items()})
        return pa.table({c: arrays[c] for c in names})

    return df.repartition(*keys).groupBy(*keys).applyInArrow(run, schema)


def least_member(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component, whole arrays at a time."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def found(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of the nodes ``at``; pointers in ``root`` lead to smaller nodes."""
    out = root[at]
    while (root[out] != out).any():
        out = root[out]
    root[at] = out
    return out


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray, strip: int = 256) -> None:
    """Unite the sets of ``a`` and ``b`` where ``near``; a set's root is its least node."""
    for s in range(0, len(a), strip):
        ra, rb = found(root, a[s : s + strip]), found(root, b)
        u, v = np.nonzero(near[s : s + strip] & (ra[:, None] != rb[None, :]))
        if len(u):
            names, ends = np.unique(np.r_[ra, rb], return_inverse=True)
            root[names] = names[least_member(len(names), ends[u], ends[len(ra) + v])]
