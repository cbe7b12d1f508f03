"""Near-duplicate vectors by p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import store
from tidewire.llm.graph import Forest, components

#: Vectors of one bucket that are compared in one task with those of one other block.
BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection of two points agrees."""
    s = width / distance
    return math.erf(s / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * s) * (1 - math.exp(-s * s / 2))


def tables_for(n: int, cosine: float, width: float = 1.0, recall: float = 0.999) -> tuple[int, int]:
    """Projections per table, so that buckets of random vectors stay small as ``n`` grows, and
    tables, so that a pair exactly at the threshold is met with probability ``recall``."""
    projections = max(4, math.ceil(math.log2(max(n, 2)) / 2))
    p = collision(math.sqrt(2 - 2 * cosine), width) ** projections
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _codes(dim: int, projections: int, tables: int, width: float, seed: int):
    """A function from unit rows to one 64-bit bucket code per table."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((dim, projections * tables))
    shift = rng.uniform(0, width, projections * tables)
    odd = rng.integers(1, 2**62, projections * tables, dtype=np.int64) * 2 + 1

    def codes(unit: np.ndarray) -> np.ndarray:
        cells = np.floor((unit @ directions + shift) / width).astype(np.int64)
        with np.errstate(over="ignore"):
            mixed = (cells * odd).reshape(len(unit), tables, projections).sum(axis=2)
            mixed ^= mixed >> 29
            return mixed * np.int64(-4658895280553007687)

    return codes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that no square runs over or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(rows: DataFrame, cosine: float = 0.98, width: float = 1.0, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label are normalised; each table hashes them by quantised Gaussian
    projections. Equal vectors fall together first and count as one with their number. A
    bucket is cut into blocks of bounded size; a task compares two blocks by exact
    cosine in double precision, counts a pair only in the first table where it meets, and
    returns counts and a spanning set of links, never the pairs. Every found pair is at or
    above ``cosine``; one exactly there is found with probability ``recall``, closer ones
    more surely.

    A vector that is null, of zero length, or holds null or non-finite components, and one
    with a null label, links with nothing (n_links 0, its own component), and so does a row
    whose vector's length differs. Repeated vec_ids count as separate vectors that share
    their component's smallest id; a null vec_id never is the smallest unless alone, and is
    kept then. kept: vec_id = component_id. Other columns are ignored.
    """
    spark = rows.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    keyed = rows.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("_good")).withColumn(
        "node", F.when(F.col("_good"), F.xxhash64("label", "embedding"))
    )
    ids = store(keyed.select("vec_id", "node"))
    distinct = store(
        keyed.where("_good").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    )
    lengths = [r[0] for r in distinct.select(F.size("embedding")).distinct().collect()]
    links, counts = [], []
    for dim in lengths:
        same = distinct.where(F.size("embedding") == dim)
        projections, tables = tables_for(same.count(), cosine, width, recall)
        found = _blocks(same, dim, projections, tables, cosine, width, seed)
        links.append(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        counts.append(found.where("links > 0").select("node", "links"))
    if not lengths:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked, counted = links[0], counts[0]
    for a, b in zip(links[1:], counts[1:]):
        linked, counted = linked.unionByName(a), counted.unionByName(b)
    roots = components(linked)
    degree = counted.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = (
        distinct.select("node", "copies").join(degree, "node", "left").join(roots, "node", "left")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    rooted = store(ids.where("node is not null").join(nodes, "node"))
    lowest = rooted.groupBy("root").agg(F.min("vec_id").alias("lowest"))
    # Rows that link with nothing would all meet under one null.
    alone = ids.where("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("lowest"))
    out = rooted.join(lowest, "root").select("vec_id", "n_links", "lowest").unionByName(alone)
    component = F.coalesce("lowest", "vec_id")
    return out.select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _blocks(vectors: DataFrame, dim: int, projections: int, tables: int, cosine: float, width: float, seed: int) -> DataFrame:
    """node, links (copies of other nodes linked with it), other (a spanning link)."""
    codes = _codes(dim, projections, tables, width, seed)

    def hash_(batches):
        for batch in batches:
            unit = _units(_matrix(batch.column(1)))
            flat = pa.array(codes(unit).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, flat)], names=["node", "label", "codes"])

    hashed = store(vectors.select("node", "embedding", "label").mapInArrow(hash_, "node long, label int, codes array<long>"))
    spread = hashed.select("node", "label", F.posexplode("codes").alias("table", "code"))
    keys = ["label", "table", "code"]
    # Only buckets of two or more go on; counts are combined before they are shuffled.
    size = spread.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    members = spread.join(size, keys).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = members.withColumn("part", F.pmod(F.col("node"), F.col("parts")).cast("int"))
    # A block meets itself and every other block of its bucket: a row goes to one pair each.
    placed = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *keys, "node", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high")
    )
    wide = vectors.select("node", "embedding", "copies").join(hashed.select("node", "codes"), "node")
    full = placed.join(wide, "node")

    def compare(key, table):
        t, low, high = (key[i].as_py() for i in (1, 3, 4))
        x = _units(_matrix(table.column("embedding").combine_chunks()))
        code = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(x), -1)[:, :t]
        node, copies, part = (table.column(c).to_numpy() for c in ("node", "copies", "part"))
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        degree = np.zeros(len(node), dtype=np.int64)
        forest = Forest(len(node))
        for at in range(0, len(left), 256):
            rows_ = left[at : at + 256]
            near = x[rows_] @ x[right].T >= cosine - 1e-9
            i, j = np.nonzero(near)
            i, j = rows_[i], right[j]
            ok = (i < j) if low == high else np.ones(len(i), dtype=bool)
            i, j = i[ok], j[ok]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            new = ~(code[i] == code[j]).any(axis=1) if t else np.ones(len(i), dtype=bool)
            i, j = i[exact], j[exact]
            new = new[exact]
            np.add.at(degree, i[new], copies[j[new]])
            np.add.at(degree, j[new], copies[i[new]])
            forest.join(i, j)
        joined = forest.root != np.arange(len(node))
        keep = (degree > 0) | joined
        return pa.table({
            "node": pa.array(node[keep]), "links": pa.array(degree[keep]),
            "other": pa.array(node[forest.root[keep]], mask=~joined[keep]),
        })

    return store(full.groupBy(*keys, "low", "high").applyInArrow(compare, "node long, links long, other long"))
