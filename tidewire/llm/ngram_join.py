"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted intersections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import symbols as sym
from tidewire.llm.common import discard, partitions, store
from tidewire.llm.graph import components

U = np.uint64
NEVER = np.iinfo(np.int64).max
#: Smallest shingle hashes by which documents meet, and how many of them a pair must share.
#: Each of the smallest hashes of a union is common with a chance of the Jaccard index: at
#: 0.75, of 48 fewer than 11 are with a chance of 6e-15, as rare as two equal 64-bit hashes
#: among a hundred pairs of documents. Sets of fewer shingles must share 3/4 of them.
MEET, LEAST = 48, 11
#: Documents of one tile that are compared in a task with those of one other block.
BLOCK = 512
#: Pivots drawn per large tile and round; a round that links one in so many sets has another follow.
TRIED, WORTH = 4, 16


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    out: list[np.ndarray] = []
    whole = sym.text_bytes(column)[1]
    for a, b in sym.parts(whole):
        raw, offsets = sym.text_bytes(column.slice(a, b - a))
        hashes, first = sym.word_hashes(raw, offsets, lower=True)
        runs = sym.Runs(hashes, first)
        every = runs.all_hashes(n) if len(hashes) >= n else np.zeros(0, dtype=U)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
            if y - x >= n:
                out.append(np.unique(every[x : y - n + 1]))
            elif y > x:
                out.append(runs.hashes(np.array([x]), np.array([y])))
            else:
                out.append(np.zeros(0, dtype=U))
    return out


def _name(hashes: np.ndarray) -> int:
    """One 64-bit name for a set."""
    if not len(hashes):
        return 0
    parts = np.array([hashes.sum(dtype=U), np.bitwise_xor.reduce(sym.mix(hashes)), len(hashes)], dtype=U)
    return int(sym.mix((parts * np.array([3, 5, 7], dtype=U)).sum(dtype=U, keepdims=True)).view(np.int64)[0])


def _bitmap(hashes: np.ndarray) -> bytes:
    """Two to four bits an element, a power of two in all."""
    bits = 1 << max(6, min(17, math.ceil(math.log2(2 * len(hashes)))))
    out = np.zeros(bits // 8, dtype=np.uint8)
    at = (hashes & U(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """All bitmaps at the smallest one's size: a bit is set if one that falls on it is."""
    size = min(map(len, bitmaps))
    rows = [np.bitwise_or.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, size // 8), axis=0) for b in bitmaps]
    return np.array(rows)


def sketches(docs: DataFrame, n: int, key: Column) -> DataFrame:
    """doc_id, row_key, size, node (name of the set; null without words), low (its smallest hashes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("low", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_name(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s[:MEET].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    rows = docs.select("doc_id", "text", key.cast("bigint").alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, size long, node long, low array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, bits, shingles for the nodes in ``wanted`` (node, key: a doc_id that has it)."""
    schema = pa.schema([("node", pa.int64()), ("bits", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b in sym.parts(sym.text_bytes(batch.column(1))[1]):
                part = batch.slice(a, b - a)
                node = part.column(0).to_pylist()
                sets = shingle_sets(part.column(1), n)
                # Another text of the same doc_id may have come along.
                own = [(k, s) for k, s in zip(node, sets) if len(s) and _name(s) == k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in own], pa.int64()), pa.array([_bitmap(s) for _, s in own], pa.binary()),
                        pa.array([s.tobytes() for _, s in own], pa.binary()),
                    ],
                    schema=schema,
                )

    texts = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"), "text")
    return texts.join(wanted.hint("shuffle_hash"), "key").select("node", "text").mapInArrow(run, "node long, bits binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sorted shingles."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = two.join(one.join(pairs.hint("shuffle_hash"), "a").hint("shuffle_hash"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, dtype=U), np.frombuffer(q, dtype=U)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def tiles(shared: DataFrame, percent: int) -> DataFrame:
    """(token, band) of every tile a row is in: its own size band and, as ``upper``, the one
    below. Linked sizes differ by less than one band, so every linked pair shares a tile."""
    step = math.log(100 / percent) * 1.01
    own = shared.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step).cast("int"))
    sides = F.array(F.struct(F.col("band").alias("band"), F.lit(False).alias("upper")), F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("upper")))
    return own.withColumn("t", F.explode(sides)).select("token", "t.band", "t.upper", "node", "size")


def meeting_points(nodes: DataFrame, percent: int) -> DataFrame:
    """node, size, key, need, known: the hashes by which a set may meet another, rarest first.

    Hashes of one set only are left out. A linked pair shares at least ``need`` hashes, so
    its rarest common one is not among the ``need - 1`` last of either set: sets do not
    meet by these, which are most of what frequent passages have in common. A set with fewer
    than ``need`` hashes left in common with any others links with none.
    """
    posted = nodes.select("node", F.explode("low").alias("token"))
    twice = store(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    known = posted.join(twice, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("known"))
    need = F.least(F.lit(LEAST), F.ceil(F.col("size") * percent / 100)).cast("int")
    out = store(
        nodes.join(known, "node").withColumn("need", need).where(F.size("known") >= F.col("need"))
        .select("node", "size", "key", "need", F.col("known.token").alias("known"))
    )
    discard(twice)
    return out


def _common(left, right, ends, flat, meets, token) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right row of a tile: hashes in common, and those of them at which the
    two would have met in an earlier tile."""
    rows, lefts = np.concatenate([left, right]), len(left)
    count = (ends[rows + 1] - ends[rows]).astype(np.int64)
    index = np.arange(count.sum()) + np.repeat(ends[rows] - (np.cumsum(count) - count), count)
    values, column, times = np.unique(flat[index], return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), count)
    held = times > 1
    number = np.cumsum(held) - 1
    ok = held[column]
    row, column, early = row[ok], number[column[ok]], (meets[index] & (flat[index] < token))[ok]
    shape = (lefts, len(rows) - lefts)
    shared, lower = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32)
    for at in range(0, int(held.sum()), 4096):
        part = (column >= at) & (column < at + 4096)
        for out, chosen in ((shared, part), (lower, part & early)):
            grid = np.zeros((len(rows), min(4096, int(held.sum()) - at)), dtype=np.float32)
            grid[row[chosen], column[chosen] - at] = 1
            out += grid[:lefts] @ grid[lefts:].T
    return shared, lower


def candidates(tiled: DataFrame, roots: DataFrame, signs: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different roots that share enough hashes and whose bitmaps allow a link, stored.

    In each tile the members of the most frequent root stand against the rest; blocks of the
    rest meet all blocks, so a large settled group costs nothing. A pair is looked at in the
    tile of its smallest common hash alone. ``best``: each set gives only its most promising
    partner; otherwise all pairs.
    """
    keys = ["token", "band"]
    known = tiled.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = known.groupBy(*keys, "root").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    top = (
        per_root.groupBy(*keys).agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"), F.min("least").alias("least"))
        .where(F.col("all") > F.col("top.n"))
    )
    split = known.join(top, keys).select(
        *keys, "upper", "node", "size", "root", "least", (F.col("root") != F.col("top.root")).alias("rest"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("others"),
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    side = F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int")
    # A row that stands on both sides of a pair of blocks travels once.
    as_any = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda r: F.struct(
        r.alias("left"), own.alias("right"), (F.col("rest") & (r == side)).alias("first"), F.lit(True).alias("second")))
    elsewhere = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != own)
    as_rest = F.transform(elsewhere, lambda b: F.struct(
        side.alias("left"), b.alias("right"), F.lit(True).alias("first"), F.lit(False).alias("second")))
    none = F.array().cast("array<struct<left:int,right:int,first:boolean,second:boolean>>")
    placed = split.withColumn("p", F.explode(F.concat(as_any, F.when(F.col("rest"), as_rest).otherwise(none))))
    # Many tiles share a task; one tile's pair of blocks is never split. Tiles with the same smallest
    # node, at most two per hash it meets by, have mostly the same sets: they go together.
    task = F.pmod(F.xxhash64("least", "p.left", "p.right"), F.lit(4 * partitions(tiled.sparkSession)))
    dealt = store(placed.select(
        "token", "node", "size", "root", "upper", "p.first", "p.second", F.xxhash64(*keys, "p.left", "p.right").alias("tile"),
        task.alias("task")))
    # A set's hashes and bitmap travel once to a task, and not once for each of its tiles there.
    told = dealt.select("task", "node").distinct().toDF("task", "node").join(signs, "node")

    def compare(table, signed):
        bitmaps, lists = signed.column("bits").to_pylist(), signed.column("known").combine_chunks()
        need, named = signed.column("need").to_numpy(), signed.column("node").to_numpy()
        table = table.filter(pc.is_in(table.column("node"), signed.column("node")))
        names = ("token", "node", "size", "root", "tile")
        token, node, size, root, tiles_ = (table.column(c).to_numpy() for c in names)
        by_name = np.argsort(named, kind="stable")
        at = by_name[np.searchsorted(named, node, sorter=by_name)] if len(node) else node
        upper, first, second = (table.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "first", "second"))
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        places = np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends))
        meets = places <= np.repeat(np.diff(ends) - need, np.diff(ends))
        order = np.argsort(tiles_, kind="stable")
        cuts = np.flatnonzero(np.r_[True, tiles_[order][1:] != tiles_[order][:-1]])
        out_a, out_b, out_s = [], [], []
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            rows = order[x:y]
            left, right = rows[first[rows]], rows[second[rows]]
            if not len(left) or not len(right) or (root[rows] == root[rows[0]]).all():
                continue
            able = root[left][:, None] != root[right][None, :]
            able &= ~(upper[left][:, None] & upper[right][None, :])
            small, large = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
            able &= 100 * small >= percent * large
            if not able.any():
                continue
            shared, lower = _common(at[left], at[right], ends, flat, meets, token[rows[0]])
            able &= (shared >= np.minimum.outer(need[at[left]], need[at[right]])) & (lower == 0)
            p, q = np.nonzero(able)
            if not len(p):
                continue
            i, j = left[p], right[q]
            own, place = np.unique(np.r_[i, j], return_inverse=True)
            bits = _folded([bitmaps[r] for r in at[own].tolist()])
            weight = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
            u, v = place[: len(i)], place[len(i) :]
            meet = np.concatenate([
                np.bitwise_count(bits[u[c : c + 4096]] & bits[v[c : c + 4096]]).sum(axis=1) for c in range(0, len(u), 4096)
            ]).astype(np.int64)
            # A bit that only one has stands for an element that only it has.
            most = np.minimum(size[i] - (weight[u] - meet), size[j] - (weight[v] - meet))
            ok = (100 + percent) * most >= percent * (size[i] + size[j])
            i, j, score = i[ok], j[ok], most[ok] / (size[i[ok]] + size[j[ok]])
            if best and len(i):
                by = np.lexsort((node[j], -score, i))
                by = by[np.r_[True, i[by][1:] != i[by][:-1]]]
                i, j, score = i[by], j[by], score[by]
            out_a.append(node[i])
            out_b.append(node[j])
            out_s.append(score)
        a, b = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (out_a, out_b))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "score": pa.array(np.concatenate(out_s) if out_s else np.zeros(0))})

    found = dealt.groupBy("task").cogroup(told.groupBy("task")).applyInArrow(lambda t, u: compare(t, u), "a long, b long, score double")
    if best:
        found = found.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    else:
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = store(found)
    discard(dealt)
    return found


def pivots(tiled: DataFrame, roots: DataFrame, seed: int) -> DataFrame:
    """(a, b): each set with the pivot, of another component, that it meets in most tiles.

    ``TRIED`` draws name a pivot per tile each, so rows grow with the places in tiles and
    never with their pairs.
    """
    keys = ["token", "band"]
    known = tiled.join(roots, "node", "left").select(*keys, "node", F.coalesce("root", "node").alias("root"))
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(seed + i)).alias("h"), F.col("node").alias("b"), F.col("root").alias("pivot_root"))) for i in range(TRIED)]
    drawn = known.groupBy(*keys).agg(F.array(*draws).alias("drawn"))
    met = known.join(drawn, keys).select(F.col("node").alias("a"), "root", F.explode("drawn").alias("p")).where("root != p.pivot_root")
    counted = met.groupBy("a", F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    return counted.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).where("m.n > 3").select("a", F.col("m.b").alias("b"))


def settle_large(tiled: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``links`` with those to pivots in the tiles of more than ``BLOCK`` rows.

    A large group of near copies would meet in all its tiles, block by block. Each round every set
    of another component than its pivots' is held against the best of them, until a round links
    fewer than one in ``WORTH`` of them: what is still apart then is little, or really different. The
    later rounds leave no link out, so this decides on work only.
    """
    large = tiled.groupBy("token", "band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("token", "band")
    held = store(tiled.join(large, ["token", "band"]))
    seed = 0
    while True:
        found = store(pivots(held, components(links), seed))
        fresh = store(verified(found, sets, percent))
        asked, linked = found.count(), fresh.count()
        links, seed = store(links.unionByName(fresh)), seed + TRIED
        discard(found, fresh)
        if WORTH * linked < asked or not linked:
            discard(held)
            return links


def join(docs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are lower-cased in A-Z. A set has the distinct n-word shingles; a text with fewer
    words is one shingle; one without words, or a null one, has none, links with nothing
    and is its own component. Two sets link from ``percent`` of their union in common.
    Equal sets fall together first, so copies never meet in pairs.

    Sets meet through their smallest hashes (``meeting_points``), in tiles of one hash and one band of
    sizes. A first round links each set with its tile's first one, where they meet most
    often; in large tiles drawn pivots follow until they link nothing (``settle_large``); then
    every set still apart offers its best partner; the last round checks
    all pairs of different components whose bitmaps allow a link. So groups of near copies
    settle before pairs are formed, and no link between components is left out. Shingles
    are compared by 64-bit hashes. Repeated rows are alike; rows that share a doc_id with
    different texts count one by one; a null doc_id is never the smallest one.
    """
    labelled = labels(docs, percent, n, F.lit(0))
    named = labelled.where("root is not null")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("lowest"))
    found = named.join(lowest, "root").select("doc_id", "size", F.coalesce("lowest", "doc_id").alias("component_id"))
    alone = labelled.where("root is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumnRenamed("size", "n_shingles")


def labels(docs: DataFrame, percent: int, n: int, key: Column) -> DataFrame:
    """Per row: doc_id, row_key (``key``), size, root (one name per component; null without words)."""
    rows = store(sketches(docs, n, key))
    nodes = store(
        rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("key"), F.first("size").alias("size"), F.first("low").alias("low")
        )
    )
    meeting = meeting_points(nodes, percent)
    discard(nodes)
    posted = meeting.select("node", "size", F.explode(F.slice("known", F.lit(1), F.size("known") - F.col("need") + 1)).alias("token"))
    twice = store(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"))
    tiled = store(tiles(posted.join(twice, "token"), percent))
    met = tiled.select("node").distinct()
    sets = store(sets_of(docs, meeting.join(met, "node").select("node", F.coalesce("key", F.lit(2**63 - 1)).alias("key")), n))
    signs = store(sets.select("node", "bits").join(meeting.select("node", "need", "known"), "node"))
    discard(twice)
    first = tiled.where("not upper").groupBy("token", "band").agg(F.min("node").alias("b"))
    meetings = tiled.join(first, ["token", "band"]).where("node != b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    chosen = meetings.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).where("m.n > 3").select("a", F.col("m.b").alias("b"))
    links = settle_large(tiled, store(verified(store(chosen), sets, percent)), sets, percent)
    for best in (True, False):
        roots = components(links)
        found = candidates(tiled, roots, signs, percent, best)
        links = store(links.unionByName(verified(found, sets, percent)))
        discard(found)
    roots = components(links)
    # Rows without words would all meet under one null.
    named = rows.where("node is not null").join(roots, "node", "left").select("doc_id", "row_key", "size", F.coalesce("root", "node").alias("root"))
    labelled = store(named.unionByName(rows.where("node is null").select("doc_id", "row_key", "size", F.col("node").alias("root"))))
    discard(rows, meeting, tiled, sets, signs)
    return labelled


def keep_one(docs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """One row of each component: the smallest doc_id, nulls last; of rows that share it, one.

    A row without words is its own component. The rows are stored with a key first, so that
    both reads see the same keys.
    """
    keyed = store(docs.withColumn("_row_key", F.monotonically_increasing_id()))
    labelled = labels(keyed, percent, n, F.col("_row_key"))
    first = labelled.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("m")
    )
    kept = first.select(F.col("m.row_key").alias("_row_key")).unionByName(
        labelled.where("root is null").select(F.col("row_key").alias("_row_key"))
    )
    return keyed.join(kept, "_row_key", "left_semi").drop("_row_key")
