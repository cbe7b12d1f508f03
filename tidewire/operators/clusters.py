"""Clustering of many windows at once.

Points are rows (window, node, embedding); ``node`` is a BIGINT that is unique in
its window and gives the row order. All windows, and all parameters of a sweep,
run in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.vectors import cosine_distance, euclidean_distance
from tidewire.operators import density, kernels
from tidewire.operators.components import connected_components
from tidewire.operators.ordering import number_rows
from tidewire.operators.silhouette import silhouette
from tidewire.operators.windows import Lookback, block_counts, pair_blocks, window_blocks
from tidewire.session import cut_lineage

NOISE = -1
# Points per block: a pair of blocks costs about 200 MB of distances in a task.
BLOCK = 3072
# Points that travel together to be counted, block by block: about 16 MB of vectors of 64 numbers.
TILE = 32768
# Parameters used where a sweep finds nothing.
DEFAULT_EPS, DEFAULT_SIZE_MIN, DEFAULT_K = 0.1, 5, 2
# Passes over the points that draw k-means centres; nearer squares count as copies of a centre.
ROUNDS, SAME = 4, 1e-9
PRIME = 2**31 - 1
# The eps grid of the headline run, 0.01 to below 1 in steps of 0.03.
EPS_GRID = [round(0.01 + 0.03 * i, 2) for i in range(33)]


def pair_distance(pairs: DataFrame, left: str, right: str, metric: str = "cosine") -> DataFrame:
    """Add ``dist`` for rows that already hold both vectors."""
    measure = {"cosine": cosine_distance, "euclidean": euclidean_distance}[metric]
    return pairs.withColumn("dist", measure(left, right))


# --- density clustering ---------------------------------------------------------


def neighbour_counts(
    points: DataFrame, grid: list[float], metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(window, node, deg[]): neighbours within each eps, the point included.

    Points travel in tiles of about ``tile``, once for each tile that they meet; in a task the distances are
    taken between blocks of ``rows``.
    """
    counts = block_counts(points, ["window"], max(tile, rows))
    order = np.argsort(grid)
    edges = np.asarray(grid)[order]
    width = len(edges) + 1

    def tally(bins: np.ndarray) -> np.ndarray:
        flat = (np.arange(len(bins))[:, None] * width + bins).ravel()
        return np.bincount(flat, minlength=len(bins) * width).reshape(len(bins), width)

    def count(key, t):
        lo, hi = key[1:]
        x, node, block = kernels.matrix(t, "embedding"), kernels.column(t, "node"), kernels.column(t, "block")
        a = block == lo
        xa, xb = x[a], x[a] if lo == hi else x[~a]
        sums = np.zeros((len(xa), width))
        other = sums if lo == hi else np.zeros((len(xb), width))
        for i in range(0, len(xa), rows):
            for j in range(i if lo == hi else 0, len(xb), rows):
                same = lo == hi and i == j
                # Bin k holds the distances that first fit the k-th smallest eps.
                bins = np.searchsorted(edges, kernels.distances(xa[i : i + rows], xb[j : j + rows], metric, same=same), side="left")
                sums[i : i + rows] += tally(bins)
                if not same:
                    other[j : j + rows] += tally(bins.T)
        held = [sums] if lo == hi else [sums, other]
        deg = np.empty((sum(map(len, held)), len(edges)))
        deg[:, order] = np.concatenate(held).cumsum(axis=1)[:, :-1]
        return {"node": node[a] if lo == hi else np.r_[node[a], node[~a]], "deg": kernels.vectors(deg)}

    partial = kernels.per_group(
        pair_blocks(points, ["window"], "node", counts), ["window", "lo", "hi"], count,
        "window bigint, lo bigint, hi bigint, node bigint, deg array<double>",
    )
    total = vector_to_array(Summarizer.sum(array_to_vector("deg")))
    # The summarizer's sum is a mean times a number of rows: 27.999999999999996 is 28.
    return partial.groupBy("window", "node").agg(F.transform(total, lambda x: F.round(x)).alias("deg"))


def _links(
    cored: DataFrame, params: list[tuple[float, int]], metric: str, counts: DataFrame, rows: int
) -> DataFrame:
    """(window, lo, hi, param, u, v, core): v is a core point in reach of u in one pair of tiles.

    Core points link to the first core point of their component inside the pair: a spanning star
    and not the whole neighbourhood. The distances are taken between blocks of ``rows``, whose
    components are merged in the task.
    """

    def link(key, t):
        lo, hi = key[1:]
        node = kernels.column(t, "node")
        by_node = np.argsort(node, kind="stable")
        node = node[by_node]
        x = kernels.matrix(t, "embedding")[by_node]
        block = kernels.column(t, "block")[by_node]
        core = kernels.matrix(t, "core")[by_node]
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        # Rows of one node are one node as soon as there are blocks to merge.
        cut_up = len(node) > rows
        start = np.searchsorted(node, node) if cut_up else np.arange(len(node))
        roots = [start.copy() for _ in params]
        borders: list[list[np.ndarray]] = [[] for _ in params]
        for i in range(0, len(a), rows):
            for j in range(i if lo == hi else 0, len(b), rows):
                same = lo == hi and i == j
                ai, bj = a[i : i + rows], b[j : j + rows]
                dist = kernels.distances(x[ai], x[bj], metric, same=same)
                for p, (eps, _) in enumerate(params):
                    near = dist <= eps
                    ca, cb = core[ai, p], core[bj, p]
                    kernels.merge(roots[p], ai[ca], bj[cb], near[np.ix_(ca, cb)])
                    # A border point has fewer than size_min points in reach.
                    u, v = np.nonzero(near[np.ix_(~ca, cb)])
                    borders[p].append(np.stack([ai[~ca][u], bj[cb][v]]))
                    if not same:
                        v, u = np.nonzero(near[np.ix_(ca, ~cb)])
                        borders[p].append(np.stack([bj[~cb][u], ai[ca][v]]))
        out = {"param": [], "u": [], "v": [], "core": []}
        for p, root in enumerate(roots):
            inner = np.flatnonzero(core[:, p])
            v = kernels.found(root, inner)
            kept = np.ones(len(inner), dtype=bool)
            if cut_up:
                # Between two tiles a point without a link says nothing: its own tile has it.
                kept = (start[inner] == inner) & ((lo == hi) | (v != inner))
            border = np.concatenate([np.zeros((2, 0), dtype=np.int64), *borders[p]], axis=1)
            border[1] = kernels.found(root, border[1])
            border = np.unique(border, axis=1)
            for u, v, flag in ((inner[kept], v[kept], True), (border[0], border[1], False)):
                out["param"].append(np.full(len(u), p, dtype=np.int32))
                out["u"].append(node[u])
                out["v"].append(node[v])
                out["core"].append(np.full(len(u), flag))
        return {c: np.concatenate(v) for c, v in out.items()}

    return kernels.per_group(
        pair_blocks(cored, ["window"], "node", counts), ["window", "lo", "hi"], link,
        "window bigint, lo bigint, hi bigint, param int, u bigint, v bigint, core boolean",
    )


def density_roots(
    points: DataFrame, params: Sequence[tuple[float, int]], metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(window, param, node, root) for core and border points; the rest is noise.

    ``root`` is the first core point of the cluster; a border point joins the
    reachable cluster whose first core point comes first.
    """
    params = list(params)
    grid = sorted({eps for eps, _ in params})
    counts = block_counts(points, ["window"], max(tile, rows))
    degrees = neighbour_counts(points, grid, metric, rows, tile)
    core = F.array(*[F.col("deg")[grid.index(eps)] >= size for eps, size in params])
    cored = points.join(degrees.select("window", "node", core.alias("core")), ["window", "node"])
    links = cut_lineage(_links(cored, params, metric, counts, rows))
    keys = ["window", "param"]
    stars = links.filter("core").select(*keys, "u", "v")
    whole = F.col("_parts") == 1
    # Inside one tile the stars are the components already.
    roots = stars.join(counts.filter(whole).select("window"), "window", "left_semi").withColumnRenamed("v", "root")
    cut_up = counts.filter(~whole).select("window")
    if not cut_up.isEmpty():
        merged = connected_components(stars.join(cut_up, "window", "left_semi"), keys)
        roots = cut_lineage(roots.unionByName(merged))
    borders = (
        links.filter("NOT core")
        .join(roots.withColumnRenamed("u", "v"), keys + ["v"])
        .groupBy(*keys, F.col("u").alias("node"))
        .agg(F.min("root").alias("root"))
    )
    return roots.select(*keys, F.col("u").alias("node"), "root").unionByName(borders)


def _numbered(roots: DataFrame) -> DataFrame:
    """Cluster numbers 0, 1, … per (window, param) in the order of the roots."""
    keys = ["window", "param"]
    ranked = number_rows(roots.select(*keys, "root").distinct(), keys + ["root"])
    first = ranked.groupBy(*keys).agg(F.min("rn").alias("_first"))
    numbers = ranked.join(first, keys).select(*keys, "root", (F.col("rn") - F.col("_first")).cast("int").alias("label"))
    return roots.join(numbers, keys + ["root"]).drop("root")


def _with_noise(points: DataFrame, labelled: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels for all points of the (window, param) rows in ``chosen``."""
    wanted = points.select("window", "node").join(chosen.select("window", "param"), "window")
    joined = wanted.join(labelled, ["window", "param", "node"], "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(NOISE)))


def _param_table(points: DataFrame, params: Sequence[tuple[float, int]]) -> DataFrame:
    """One row per (window, param)."""
    grid = F.array(*[
        F.struct(F.lit(i).alias("param"), F.lit(float(e)).alias("eps"), F.lit(int(s)).alias("size_min"))
        for i, (e, s) in enumerate(params)
    ])
    return points.select("window").distinct().select("window", F.explode(grid).alias("p")).select("window", "p.*")


def multi_eps(
    points: DataFrame, params: Sequence[tuple[float, int]], metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(window, param, node, label) for every (eps, size_min): nested densities."""
    points = cut_lineage(points)
    labelled = _numbered(density_roots(points, params, metric, rows, tile))
    return _with_noise(points, labelled, _param_table(points, params))


def forest_eps(
    points: DataFrame, grid: Sequence[float], size_min: int, metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(window, param, node, label) for every eps of ``grid``, all from one spanning forest."""
    params = [(float(e), size_min) for e in grid]
    forest = density.density_forest(points, size_min, metric, rows, max(eps for eps, _ in params), tile)
    return _labels_of(forest, cut_lineage(_param_table(forest.points, params)))


def dbscan(
    points: DataFrame, eps: float, size_min: int, metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """(window, node, label), -1 for noise; numbers follow the first core point."""
    return multi_eps(points, [(eps, size_min)], metric, rows, tile).drop("param")


def _fewest(best: DataFrame, score: str) -> DataFrame:
    """Highest score per window; the earliest candidate wins a tie."""
    rank = F.row_number().over(W.partitionBy("window").orderBy(F.desc(score), "param"))
    return best.withColumn("_r", rank).filter("_r = 1").drop("_r")


def eps_sweep(
    points: DataFrame, range_eps: Iterable[float] = EPS_GRID, size_min: int = 5,
    metric: str = "cosine", rows: int = BLOCK, tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """Labels and chosen (window, param, eps, size_min, nb_cluster): most labels, first eps wins."""
    grid = [float(e) for e in range_eps]
    if not grid:
        grid, size_min = [DEFAULT_EPS], DEFAULT_SIZE_MIN
    params = [(e, size_min) for e in grid]
    forest = density.density_forest(points, size_min, metric, rows, max(grid), tile)
    counted = _param_table(forest.points, params).join(density.grid_labels(forest, grid), ["window", "param"])
    chosen = cut_lineage(_fewest(counted, "nb_cluster"))
    return _labels_of(forest, chosen).drop("param"), chosen


def adaptive_sweep(
    points: DataFrame, size_min: int = 5, metric: str = "cosine", rows: int = BLOCK, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """Labels and chosen (window, eps, size_min, nb_cluster, eps_min): each window searches its own radii.

    ``density.adaptive_eps`` has the rule. All windows are searched in the same jobs; a
    window that is all noise at once, or holds copies, costs no more than the others.
    """
    forest = density.density_forest(points, size_min, metric, rows, 1.0, tile)
    found = density.adaptive_eps(forest, default=DEFAULT_EPS)
    chosen = cut_lineage(found.select("window", F.lit(0).alias("param"), "eps", F.lit(size_min).alias("size_min"), "nb_cluster", "eps_min"))
    return _labels_of(forest, chosen).drop("param"), chosen


def _labels_of(forest: density.Forest, chosen: DataFrame) -> DataFrame:
    """(window, param, node, label) of all points at the chosen radii of their windows."""
    labels = density.whole_labels(forest, chosen)
    cut_up = forest.counts.filter("_parts > 1")
    if cut_up.isEmpty():
        return labels
    labelled = _numbered(cut_lineage(density.forest_labels(forest, chosen)))
    large = forest.points.join(cut_up, "window", "left_semi")
    return labels.unionByName(_with_noise(large, labelled, chosen).select(*labels.columns))


def silhouette_sweep(
    points: DataFrame, range_eps: Iterable[float], range_size_min: Iterable[int],
    metric: str = "cosine", rows: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """As ``eps_sweep``, by the highest silhouette without noise; else the defaults."""
    sizes = list(range_size_min)
    grid = [(float(e), int(s)) for e in range_eps for s in sizes]
    params = grid + [(DEFAULT_EPS, DEFAULT_SIZE_MIN)]
    points = cut_lineage(points)
    labelled = cut_lineage(_numbered(density_roots(points, params, metric, rows)))
    vectors = points.select("window", "node", "embedding")
    tried = labelled.filter(F.col("param") < len(grid)).join(vectors, ["window", "node"])
    scores = silhouette(tried, ["window", "param"]).filter("label IS NULL").select("window", "param", "silhouette_score")
    table = _param_table(points, params).join(scores, ["window", "param"], "left")
    fallback = F.col("param") == len(grid)
    usable = table.filter(fallback | F.col("silhouette_score").isNotNull()).withColumn(
        "_score", F.when(fallback, -10.0).otherwise(F.col("silhouette_score")))
    chosen = cut_lineage(_fewest(usable, "_score").drop("_score"))
    return _with_noise(points, labelled, chosen).drop("param"), chosen


# --- labels that arrive one by one ----------------------------------------------


def label_vote(pairs: DataFrame, by: list[str], label: str = "label", n: str | None = None) -> DataFrame:
    """Most frequent label per group, the smallest one on a tie: (by, label, votes).

    ``n``: the column with the number of votes that a row stands for.
    """
    counts = pairs.groupBy(*by, label).agg((F.sum(n) if n else F.count("*")).alias("votes"))
    return _winner(counts, by, label)


def _winner(counts: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    best = F.max(F.struct("votes", (-F.col(label)).alias("_l")))
    return counts.groupBy(*by).agg(best.alias("_b")).select(
        *by, (-F.col("_b._l")).alias(label), F.col("_b.votes").alias("votes"))


def _ballots(new: DataFrame, known: DataFrame, look: Lookback, metric: str, rows: int) -> DataFrame:
    """(chain_id, id, label, votes): labelled members closer than eps, by label."""

    def poll(key, t):
        at = t.column("is_anchor").to_numpy(zero_copy_only=False)
        x, time, ids = kernels.matrix(t, "embedding"), kernels.column(t, "t"), kernels.column(t, "id")
        label, eps = kernels.column(t, "label"), kernels.column(t, "eps")
        gap = time[at][:, None] - time[~at][None, :]
        seen = (gap < look.span) & (gap >= look.gap) & (gap > 0)
        near = seen & (kernels.distances(x[at], x[~at], metric) < eps[at][:, None])
        out = {"id": [], "label": [], "votes": []}
        for one in np.unique(label[~at]):
            votes = near[:, label[~at] == one].sum(axis=1)
            hit = votes > 0
            out["id"].append(ids[at][hit])
            out["label"].append(np.full(hit.sum(), one, dtype=np.int32))
            out["votes"].append(votes[hit])
        return {c: np.concatenate(v) for c, v in out.items()}

    cols = ["chain_id", "id", "t", "embedding", "label", "eps"]
    at = new.withColumn("label", F.lit(0)).select(*cols)
    voters = known.filter(F.col("label") != NOISE).withColumn("eps", F.lit(0.0)).select(*cols)
    partial = kernels.per_group(
        window_blocks(at, voters, look, rows=rows), ["chain_id", "pair"], poll,
        "chain_id bigint, pair string, id bigint, label int, votes bigint",
    )
    return partial.groupBy("chain_id", "id", "label").agg(F.sum("votes").alias("votes"))


def incremental_labels(
    fitted: DataFrame, newcomers: DataFrame, look: Lookback, metric: str = "cosine", rows: int = BLOCK
) -> DataFrame:
    """(chain_id, id, t, embedding, label) of the articles that came after a fit.

    ``fitted``: (chain_id, id, t, embedding, label) of the fit's window;
    ``newcomers``: (chain_id, id, t, embedding, eps, size_min). An article takes the
    most frequent label among the labelled members closer than eps if more than
    ``size_min`` carry it, else noise. An article only looks at earlier ones, so
    repeating the vote for all of them settles on the one-by-one result; the rounds
    needed are the longest run of articles that depend on each other, and a horizon
    limits that run to a day divided by the horizon.
    """
    new = cut_lineage(newcomers)
    base = cut_lineage(_ballots(new, fitted, look, metric, rows))
    keys = ["chain_id", "id"]

    def decide(counts: DataFrame) -> DataFrame:
        best = _winner(counts, keys)
        label = F.when(F.col("votes") > F.col("size_min"), F.col("label")).otherwise(NOISE)
        return new.join(best, keys, "left").withColumn("label", F.coalesce(label, F.lit(NOISE)).cast("int")).drop("votes")

    votes, current = base, cut_lineage(decide(base))
    gone, come = current.limit(0), current.filter(F.col("label") != NOISE)
    # Only articles whose label changed vote again: out with the old label, in with the new.
    while not (gone.isEmpty() and come.isEmpty()):
        withdrawn = _ballots(new, gone, look, metric, rows).withColumn("votes", -F.col("votes"))
        changes = _ballots(new, come, look, metric, rows).unionByName(withdrawn)
        votes = cut_lineage(
            votes.unionByName(changes).groupBy(*keys, "label").agg(F.sum("votes").alias("votes")).filter("votes > 0"))
        after = decide(votes).join(current.select(*keys, F.col("label").alias("_before")), keys)
        after = cut_lineage(after)
        changed = after.filter(F.col("label") != F.col("_before"))
        gone = changed.withColumn("label", F.col("_before")).filter(F.col("label") != NOISE).drop("_before")
        come = changed.filter(F.col("label") != NOISE).drop("_before")
        current = after.drop("_before")
    return current.select("chain_id", "id", "t", "embedding", "label")


# --- k-means --------------------------------------------------------------------


def k_sqrt(n: Column) -> Column:
    """max(2, whole part of the square root)."""
    return F.greatest(F.lit(2), F.floor(F.sqrt(n)))


def _nearest(points: DataFrame, centres: DataFrame, labels: bool) -> DataFrame:
    """Assign each ``block`` of points to each ``batch`` of starts. Sums per centre, or with ``labels`` the assignment."""

    def assign(key, t):
        is_point = t.column("is_point").to_numpy(zero_copy_only=False)
        x, node = kernels.matrix(t, "embedding"), kernels.column(t, "node")
        pts, ctr = x[is_point], x[~is_point]
        k, init, c = (kernels.column(t, n)[~is_point] for n in ("k", "init", "c"))
        squares = kernels.distances(pts, ctr, "euclidean") ** 2
        out = {n: [] for n in ("k", "init", "c", "node", "n", "cost", "total")}
        for kk, ii in sorted(set(zip(k.tolist(), init.tolist()))):
            mine = np.flatnonzero((k == kk) & (init == ii))
            mine = mine[np.argsort(c[mine])]
            pick = squares[:, mine].argmin(axis=1)
            cost = squares[np.arange(len(pts)), mine[pick]]
            if labels:
                who, ids, n = c[mine][pick], node[is_point], np.ones(len(pts))
                totals = np.zeros((len(pts), 1))
            else:
                member = pick[None, :] == np.arange(len(mine))[:, None]
                who, ids, n = c[mine], np.zeros(len(mine), dtype=np.int64), member.sum(axis=1)
                totals, cost = member.astype(float) @ pts, member.astype(float) @ cost
            out["k"].append(np.full(len(who), kk, dtype=np.int32))
            out["init"].append(np.full(len(who), ii, dtype=np.int32))
            out["c"].append(who.astype(np.int32))
            out["node"].append(ids)
            out["n"].append(n.astype(np.float64))
            out["cost"].append(cost)
            out["total"].append(totals)
        joined = {c: np.concatenate(v) for c, v in out.items()}
        return {**joined, "total": kernels.vectors(joined["total"])}

    held = centres.select("window", "batch").distinct()
    none = F.lit(0)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)
    both = points.join(held, "window").select(
        "window", "block", "batch", "node", "embedding", none.alias("k"), none.alias("init"), none.alias("c"),
        F.lit(True).alias("is_point"),
    ).unionByName(centres.withColumn("block", F.explode(blocks)).select(
        "window", "block", "batch", F.lit(0).cast("bigint").alias("node"), "embedding", "k", "init", "c",
        F.lit(False).alias("is_point")))
    return kernels.per_group(
        both, ["window", "block", "batch"], assign,
        "window bigint, block bigint, batch bigint, k int, init int, c int, node bigint, n double, cost double, total array<double>",
    )


def uniform(node: np.ndarray, init: int, nth: int) -> np.ndarray:
    """A number in (0, 1) for every node, restart and round, by squares modulo a prime."""
    h = (node % PRIME * 48271 + (init * 69621 + nth * 16807 + 12345)) % PRIME
    h = (h * h + 3 * h + 7) % PRIME
    h = (h * 48271 + 11) % PRIME
    h = (h * h + 5) % PRIME
    return (h + 0.5) / PRIME


def _drawn(points: DataFrame, centres: DataFrame, nth: int, n_init: int) -> DataFrame:
    """(window, init, node, race, take): each block's ``take`` first points of every restart's race.

    Points run with a speed of their squared distance to the nearest centre so far (round 0: all
    alike), so the first ones are drawn with chances in proportion to it.
    """

    def draw(key, t):
        is_point = t.column("is_point").to_numpy(zero_copy_only=False)
        x, node, init = kernels.matrix(t, "embedding"), kernels.column(t, "node"), kernels.column(t, "init")
        pts, own, ctr = x[is_point], node[is_point], x[~is_point]
        take = int(kernels.column(t, "take")[is_point][0]) if len(pts) else 0
        out = {"init": [], "node": [], "race": []}
        squares = kernels.distances(pts, ctr, "euclidean") ** 2 if nth else None
        for i in range(n_init):
            far = np.ones(len(pts))
            if nth:
                mine = init[~is_point] == i
                far = squares[:, mine].min(axis=1) if mine.any() else far
            with np.errstate(divide="ignore"):
                race = np.where(far > SAME, -np.log(uniform(own, i, nth)) / far, np.inf)
            first = np.lexsort((own, race))[: 1 if nth == 0 else take]
            first = first[np.isfinite(race[first])]
            out["init"].append(np.full(len(first), i, dtype=np.int32))
            out["node"].append(own[first])
            out["race"].append(race[first])
        return {c: np.concatenate(v) for c, v in out.items()}

    none = F.lit(0)
    columns = ["window", "block", "node", "init", "take", "embedding", "is_point"]
    both = points.withColumns({"init": none, "is_point": F.lit(True)}).select(*columns).unionByName(
        centres.withColumns({
            "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)),
            "node": F.lit(0).cast("bigint"), "is_point": F.lit(False)}).select(*columns))
    return kernels.per_group(both, ["window", "block"], draw, "window bigint, block bigint, init int, node bigint, race double")


def seeds(points: DataFrame, widest: DataFrame, n_init: int, rows: int = BLOCK) -> DataFrame:
    """(window, init, c, embedding): starting centres of every restart, most important ones first.

    The first is drawn evenly; then ``ROUNDS`` rounds draw the others with chances in
    proportion to the squared distance from those before, several at a time, so the passes over the
    points do not grow with k. The first k of a restart serve as its start for k. ``widest``:
    (window, _kmax). Only a few rows per block leave the tasks.
    """
    sizes = points.groupBy("window").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    take = F.greatest(F.lit(1), F.ceil((F.col("_kmax") - 1) / ROUNDS)).cast("int")
    held = cut_lineage(points.join(sizes, "window").join(widest, "window").select(
        "window", "node", "embedding", F.pmod(F.xxhash64("node"), F.col("_parts")).alias("block"), "_parts", "_kmax", take.alias("take")))
    centres = None
    for nth in range(ROUNDS + 1):
        none = held.limit(0).select("window", F.lit(0).alias("init"), F.lit(0).alias("c"), "embedding", "_parts", "take")
        raced = _drawn(held, none if centres is None else centres, nth, n_init)
        ranked = raced.withColumn("_r", F.row_number().over(W.partitionBy("window", "init").orderBy("race", "node")))
        facts = held.select("window", "node", "embedding", "_parts", "take", "_kmax")
        before = F.when(F.lit(nth == 0), 0).otherwise(1 + (nth - 1) * F.col("take"))
        new = ranked.join(facts, ["window", "node"]).withColumn("c", (before + F.col("_r") - 1).cast("int"))
        new = new.filter((F.col("_r") <= F.when(F.lit(nth == 0), 1).otherwise(F.col("take"))) & (F.col("c") < F.col("_kmax")))
        new = cut_lineage(new.select("window", "init", "c", "embedding", "_parts", "take"))
        centres = new if centres is None else cut_lineage(centres.unionByName(new))
    return centres.select("window", "init", "c", "embedding")


def _in_node_order(labels: DataFrame) -> DataFrame:
    """Cluster numbers 0, 1, … in the order of their first members."""
    keys = ["window", "k"]
    firsts = labels.groupBy(*keys, "c").agg(F.min("node").alias("_first"))
    ranked = firsts.withColumn("label", (F.row_number().over(W.partitionBy(*keys).orderBy("_first")) - 1).cast("int"))
    return labels.join(ranked.select(*keys, "c", "label"), [*keys, "c"]).select(*keys, "node", "label")


def kmeans(
    points: DataFrame, ks: Sequence[int] | None = None, n_init: int = 20, tol: float = 1e-4, rows: int = BLOCK,
) -> DataFrame:
    """(window, k, node, label): Lloyd's method for all windows, k and restarts at once.

    ``ks=None`` takes the square-root rule per window. Restarts begin with ``seeds``; the lowest
    total cost (to nine decimals) wins, the first restart on a tie. A start leaves the loop when
    none of its centres moves by more than ``tol``; the loop ends with the last. A centre without
    points stays. Clusters are numbered by their first members.
    """
    points = cut_lineage(points.select("window", "node", "embedding"))
    if ks is None:
        wanted = points.groupBy("window").agg(k_sqrt(F.count("*")).cast("int").alias("k"))
    else:
        wanted = points.select("window").distinct().withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    wanted = cut_lineage(wanted)
    widest = wanted.groupBy("window").agg(F.max("k").alias("_kmax"))
    drawn = seeds(points, widest, n_init, rows)
    sizes = points.groupBy("window").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    # Points in blocks; whole starts, (k, init), in batches of about ``rows`` centres.
    before = F.sum("k").over(W.partitionBy("window").orderBy("k", "init")) - F.col("k")
    batches = wanted.withColumn("init", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1)))).withColumn(
        "batch", F.floor(before / rows)).join(sizes, "window")
    centres = cut_lineage(drawn.join(batches, ["window", "init"]).filter("c < k").select(
        "window", "k", "init", "c", "batch", "_parts", "embedding"))
    points = cut_lineage(points.join(sizes, "window").select(
        "window", "node", "embedding", F.pmod(F.xxhash64("node"), F.col("_parts")).alias("block")))
    keys = ["window", "k", "init", "c"]
    centres = centres.withColumn("live", F.lit(True))
    while not (live := centres.filter("live").drop("live")).isEmpty():
        sums = _nearest(points, live, labels=False).groupBy(*keys).agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
        mean = F.when(F.col("n") > 0, F.transform("total", lambda x: F.try_divide(x, F.col("n"))))
        moved = live.join(sums, keys, "left").select(
            *keys, "batch", "_parts", F.coalesce(mean, "embedding").alias("embedding"),
            euclidean_distance(F.coalesce(mean, "embedding"), F.col("embedding")).alias("_shift"))
        shift = F.max("_shift").over(W.partitionBy("window", "k", "init"))
        moved = moved.withColumn("live", F.coalesce(shift > tol, F.lit(False))).drop("_shift")
        centres = cut_lineage(moved.unionByName(centres.filter("NOT live")))
    centres = centres.drop("live")
    costs = _nearest(points, centres, labels=False).groupBy("window", "k", "init").agg(F.sum("cost").alias("cost"))
    best = costs.groupBy("window", "k").agg(F.min(F.struct(F.round("cost", 9), "init")).alias("b")).select("window", "k", "b.init")
    winners = centres.join(best, ["window", "k", "init"], "left_semi")
    return _in_node_order(cut_lineage(_nearest(points, winners, labels=True).select("window", "k", "node", "c")))


def k_select(
    points: DataFrame, method: str = "naive", range_k: Iterable[int] = (), metric: str = "cosine", n_init: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Labels and chosen (window, k): square-root rule, or the best silhouette."""
    points = cut_lineage(points)
    ks = list(range_k)
    if method == "naive":
        labels = cut_lineage(kmeans(points, None, n_init))
        return labels.drop("k"), labels.select("window", "k").distinct()
    if method != "silhouette_score":
        raise ValueError(f"unknown method {method!r}")
    labels = cut_lineage(kmeans(points, ks or [DEFAULT_K], n_init))
    scores = silhouette(labels.join(points.select("window", "node", "embedding"), ["window", "node"]), ["window", "k"]).filter("label IS NULL")
    rank = F.row_number().over(W.partitionBy("window").orderBy(F.desc_nulls_last("silhouette_score"), "k"))
    chosen = cut_lineage(scores.withColumn("_r", rank).filter("_r = 1").select("window", "k", "silhouette_score"))
    return labels.join(chosen.select("window", "k"), ["window", "k"]).drop("k"), chosen
