"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import discard, store


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node in ``links`` (a, b).

    Alternates two steps until the links are stars round their roots: every node hands
    its larger neighbours to its smallest one, then its smaller ones. Minima are taken
    with map-side partial aggregation; the joins with them are plain equi-joins, whose
    hub nodes adaptive execution can split. Rounds grow with the logarithm of the
    component size. Links of a node with itself are ignored.
    """
    now = store(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    )
    while not _stars(now):
        # Large step: all neighbours, the larger ones move.
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        # Small step: smaller neighbours move, and the node itself.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u").where("u < v").distinct()
        )
        after = store(small)
        discard(now)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs itself."""
    ends = links.select(F.col("v").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        links.select(F.col("u").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()


class Forest:
    """Components of bounded blocks inside a task, joined by whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
