"""Queries: rolling windows, pair distances, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query, r6, s6
from tidewire.catalog.views import NEWS_SQL, VECTORS_SQL, article_clock, article_vectors
from tidewire.operators import clusters, windows
from tidewire.operators.features import window_counts
from tidewire.operators.silhouette import silhouette
from tidewire.operators.windows import Lookback
from tidewire.session import cut_lineage

DAYS, HORIZON = 7, 30
# A window is eligible with 99 % of the articles that an average one has.
MIN_NEWS_SQL = f"""(SELECT CAST(count(*) AS HUGEINT) * {99 * DAYS * windows.MICROS_PER_DAY}
  // (100 * (epoch_us(max(date)) - epoch_us(min(date)))) FROM news)"""


def look(spark, d) -> Lookback:
    """The lookback with the number of articles it needs, taken from the data."""
    n, first, last = article_clock(spark, d).agg(
        F.count("*"), F.unix_micros(F.min("date")), F.unix_micros(F.max("date"))).first()
    return Lookback(DAYS, HORIZON, 99 * DAYS * windows.MICROS_PER_DAY * n // (100 * (last - first)))


MEMBERS_SQL = """members AS (
  SELECT a.idx_news AS anchor_id, a.date AS anchor_date, m.idx_news AS member_id, m.date AS member_date
  FROM news a JOIN news m ON (m.date > a.date - INTERVAL 7 DAY AND m.date <= a.date - INTERVAL 30 MINUTE) OR m.date = a.date
  WHERE a.date > (SELECT min(date) FROM news) + INTERVAL 7 DAY)"""
ELIGIBLE_SQL = f"""eligible AS (SELECT anchor_id AS idx_news, anchor_date AS date, count(*) AS n_members,
  count(*) >= {MIN_NEWS_SQL} AS eligible FROM members GROUP BY ALL)"""
SCHEDULE_SQL = """lagged AS (SELECT *, lag(date) OVER (ORDER BY date) AS pd, lag(eligible) OVER (ORDER BY date) AS pe FROM eligible),
flagged AS (SELECT *, eligible AND (pd IS NULL OR NOT pe OR CAST(pd AS DATE) <> CAST(date AS DATE)) AS refit FROM lagged),
schedule AS (SELECT idx_news, date, n_members, eligible, refit, CASE WHEN eligible THEN
  last_value(CASE WHEN refit THEN idx_news END IGNORE NULLS) OVER (ORDER BY date) END AS chain_id FROM flagged)"""
WINDOW_SQL = f"{NEWS_SQL}, {MEMBERS_SQL}, {ELIGIBLE_SQL}, {SCHEDULE_SQL}"


@query("window_members", f"WITH {NEWS_SQL}, {MEMBERS_SQL} SELECT anchor_id, member_id FROM members")
def _(spark, d):
    return windows.window_members(article_clock(spark, d), look(spark, d)).select("anchor_id", "member_id")


@query("eligible_anchors", f"WITH {NEWS_SQL}, {MEMBERS_SQL}, {ELIGIBLE_SQL} SELECT idx_news, n_members, eligible FROM eligible")
def _(spark, d):
    return windows.eligible_anchors(article_clock(spark, d), look(spark, d)).select("idx_news", "n_members", "eligible")


@query("refit_schedule", f"WITH {WINDOW_SQL} SELECT idx_news, n_members, eligible, refit, chain_id FROM schedule")
def _(spark, d):
    out = windows.refit_schedule(article_clock(spark, d), look(spark, d))
    return out.select("idx_news", "n_members", "eligible", "refit", "chain_id")


# --- clustering of the refit windows ------------------------------------------------

EPS, SIZE_MIN = 0.64, 3
GRID = clusters.EPS_GRID


def refit_points(spark, d):
    """(window, node, embedding, label): members of every window that is fitted."""
    vectors = article_vectors(spark, d).select("idx_news", "embedding", "label")
    clock = article_clock(spark, d)
    span = look(spark, d)
    fits = windows.refit_schedule(clock, span).filter("refit")
    members = windows.window_members(clock, span, of=fits)
    rows = members.select(F.col("anchor_id").alias("window"), F.col("member_id").alias("node"))
    return rows.join(vectors.withColumnRenamed("idx_news", "node"), "node").select("window", "node", "embedding", "label")


POINTS_SQL = f"""{WINDOW_SQL}, {VECTORS_SQL},
dists AS MATERIALIZED (SELECT a.idx_news AS a, b.idx_news AS b, 1 - list_cosine_similarity(a.v, b.v) AS dist
  FROM vectors a JOIN vectors b ON b.date BETWEEN a.date - INTERVAL 7 DAY AND a.date + INTERVAL 7 DAY),
points AS MATERIALIZED (SELECT s.idx_news AS win, m.member_id AS node, v.label FROM schedule s
  JOIN members m ON m.anchor_id = s.idx_news JOIN vectors v ON v.idx_news = m.member_id WHERE s.refit),
nbr AS MATERIALIZED (SELECT p.win, p.node AS u, q.node AS w, q.label AS wl, p.label AS ul, d.dist FROM points p JOIN points q ON q.win = p.win
  JOIN dists d ON d.a = p.node AND d.b = q.node)"""

GRID_SQL = ", ".join(f"({i}, {e})" for i, e in enumerate(GRID))
# One clustering per window and eps: the smallest core point in reach, by recursion.
DBSCAN_SQL = f"""{POINTS_SQL},
params(param, eps) AS (VALUES {GRID_SQL}),
core AS MATERIALIZED (SELECT win, param, u FROM nbr JOIN params ON dist <= eps GROUP BY ALL HAVING count(*) >= {SIZE_MIN}),
edges AS MATERIALIZED (SELECT n.win, p.param, n.u, n.w FROM nbr n JOIN params p ON n.dist <= p.eps
  JOIN core a ON a.win = n.win AND a.param = p.param AND a.u = n.u
  JOIN core b ON b.win = n.win AND b.param = p.param AND b.u = n.w),
comp(win, param, u, root) USING KEY (win, param, u) AS (SELECT win, param, u, u FROM core
  UNION (SELECT e.win, e.param, e.w, min(r.root) FROM comp r JOIN edges e ON e.win = r.win AND e.param = r.param AND e.u = r.u
    JOIN recurring.comp c ON c.win = e.win AND c.param = e.param AND c.u = e.w WHERE r.root < c.root GROUP BY ALL)),
border AS (SELECT n.win, p.param, n.u, min(c.root) AS root FROM nbr n JOIN params p ON n.dist <= p.eps
  JOIN comp c ON c.win = n.win AND c.param = p.param AND c.u = n.w
  LEFT JOIN core k ON k.win = n.win AND k.param = p.param AND k.u = n.u WHERE k.u IS NULL GROUP BY ALL),
rooted AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
numbered AS (SELECT win, param, u, dense_rank() OVER (PARTITION BY win, param ORDER BY root) - 1 AS label FROM rooted),
labelled AS (SELECT p.win, g.param, p.node, coalesce(n.label, -1) AS label FROM points p CROSS JOIN params g
  LEFT JOIN numbered n ON n.win = p.win AND n.param = g.param AND n.u = p.node)"""


@query("pair_distance", f"""WITH {NEWS_SQL}, {VECTORS_SQL} SELECT a.idx_news, {s6('1 - list_cosine_similarity(a.v, b.v)')} AS cosine,
  {s6('list_distance(a.v, b.v)')} AS euclidean FROM vectors a JOIN vectors b ON b.idx_news = a.idx_news - 1""")
def _(spark, d):
    """Every article and the one before it."""
    v = article_vectors(spark, d)
    before = v.select((F.col("idx_news") + 1).alias("idx_news"), F.col("embedding").alias("before"))
    pairs = v.select("idx_news", "embedding").join(before, "idx_news")
    out = clusters.pair_distance(pairs, "embedding", "before").withColumnRenamed("dist", "cosine")
    out = clusters.pair_distance(out, "embedding", "before", "euclidean").withColumnRenamed("dist", "euclidean")
    return out.select("idx_news", r6("cosine").alias("cosine"), r6("euclidean").alias("euclidean"))


@query("neighbour_counts", f"""WITH RECURSIVE {POINTS_SQL}
SELECT win AS "window", u AS node, {", ".join(f"count(*) FILTER (dist <= {e}) AS n{i}" for i, e in enumerate(GRID))} FROM nbr GROUP BY win, u""")
def _(spark, d):
    out = clusters.neighbour_counts(refit_points(spark, d), GRID)
    return out.select("window", "node", *[F.col("deg")[i].cast("bigint").alias(f"n{i}") for i in range(len(GRID))])


@query("dbscan", f"""WITH RECURSIVE {DBSCAN_SQL} SELECT win AS "window", node, label FROM labelled WHERE param = {GRID.index(EPS)}""")
def _(spark, d):
    out = clusters.dbscan(refit_points(spark, d), EPS, SIZE_MIN)
    return out.select("window", "node", F.col("label").cast("bigint").alias("label"))


@query("dbscan_blocks", f"""WITH RECURSIVE {DBSCAN_SQL} SELECT win AS "window", node, label FROM labelled WHERE param = {GRID.index(EPS)}""")
def _(spark, d):
    """Windows cut into several blocks, whose clusters are merged."""
    out = clusters.dbscan(refit_points(spark, d), EPS, SIZE_MIN, rows=64)
    return out.select("window", "node", F.col("label").cast("bigint").alias("label"))


@query("multi_eps", f"""WITH RECURSIVE {DBSCAN_SQL} SELECT win AS "window", param, node, label FROM labelled""")
def _(spark, d):
    out = clusters.multi_eps(refit_points(spark, d), [(e, SIZE_MIN) for e in GRID])
    return out.select("window", "param", "node", F.col("label").cast("bigint").alias("label"))


@query("eps_sweep", f"""WITH RECURSIVE {DBSCAN_SQL},
counts AS (SELECT win, param, count(DISTINCT label) AS nb_cluster FROM labelled GROUP BY ALL),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY win ORDER BY nb_cluster DESC, param) = 1)
SELECT l.win AS "window", l.node, l.label, CAST(p.eps AS DOUBLE) AS eps, b.nb_cluster
FROM labelled l JOIN best b USING (win, param) JOIN params p USING (param)""")
def _(spark, d):
    labels, chosen = clusters.eps_sweep(refit_points(spark, d), GRID, SIZE_MIN)
    return labels.join(chosen, "window").select(
        "window", "node", F.col("label").cast("bigint").alias("label"), "eps", "nb_cluster")


@query("forest_eps", f"""WITH RECURSIVE {DBSCAN_SQL} SELECT win AS "window", param, node, label FROM labelled""")
def _(spark, d):
    """The labels of all 33 eps from one spanning forest."""
    out = clusters.forest_eps(refit_points(spark, d), GRID, SIZE_MIN)
    return out.select("window", "param", "node", F.col("label").cast("bigint").alias("label"))


@query("forest_eps_blocks", f"""WITH RECURSIVE {DBSCAN_SQL} SELECT win AS "window", param, node, label FROM labelled""")
def _(spark, d):
    """The same from windows cut into blocks, whose forests are put together."""
    out = clusters.forest_eps(refit_points(spark, d), GRID, SIZE_MIN, rows=100)
    return out.select("window", "param", "node", F.col("label").cast("bigint").alias("label"))


# The radii at which a window's label number can rise: the first step at or above a core distance.
ADAPTIVE_SQL = f"""{POINTS_SQL},
reach AS MATERIALIZED (SELECT win, u, list_sort(list(dist))[{SIZE_MIN}] AS core FROM nbr GROUP BY win, u),
starts AS (SELECT win, CASE WHEN min(core) > 1e-12 THEN list_filter(list_transform(range(0, 13), lambda i: 0.1::DOUBLE / pow(10::DOUBLE, i)),
  lambda r: r < min(core))[1] END AS low FROM reach GROUP BY win),
steps AS (SELECT DISTINCT win, low, CASE WHEN k > 0 AND low + (k - 1) * (low * 0.1::DOUBLE) >= core THEN k - 1 WHEN low + k * (low * 0.1::DOUBLE) < core THEN k + 1 ELSE k END AS param
  FROM (SELECT win, low, core, greatest(0, CAST(ceil((core - low) / (low * 0.1::DOUBLE)) AS BIGINT)) AS k FROM starts JOIN reach USING (win) WHERE low IS NOT NULL)),
params AS MATERIALIZED (SELECT win, param, low + param * (low * 0.1::DOUBLE) AS eps FROM steps WHERE low + param * (low * 0.1::DOUBLE) < 1
  UNION SELECT win, 0, coalesce(low, 0.1) FROM starts),
core AS MATERIALIZED (SELECT win, param, u, eps FROM reach JOIN params USING (win) WHERE core <= eps),
edges AS MATERIALIZED (SELECT n.win, a.param, n.u, n.w FROM nbr n JOIN core a ON a.win = n.win AND a.u = n.u AND n.dist <= a.eps
  JOIN core b ON b.win = n.win AND b.param = a.param AND b.u = n.w),
comp(win, param, u, root) USING KEY (win, param, u) AS (SELECT win, param, u, u FROM core
  UNION (SELECT e.win, e.param, e.w, min(r.root) FROM comp r JOIN edges e ON e.win = r.win AND e.param = r.param AND e.u = r.u
    JOIN recurring.comp c ON c.win = e.win AND c.param = e.param AND c.u = e.w WHERE r.root < c.root GROUP BY ALL)),
border AS MATERIALIZED (SELECT n.win, c.param, n.u, min(r.root) AS root FROM nbr n JOIN core c ON c.win = n.win AND c.u = n.w AND n.dist <= c.eps
  JOIN comp r ON r.win = c.win AND r.param = c.param AND r.u = c.u
  WHERE NOT EXISTS (FROM core o WHERE o.win = n.win AND o.param = c.param AND o.u = n.u) GROUP BY ALL),
rooted AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
sizes AS (SELECT win, count(*) AS n FROM points GROUP BY win),
counts AS (SELECT p.win, p.param, p.eps, s.low, count(DISTINCT r.root) + CASE WHEN count(r.u) < any_value(z.n) THEN 1 ELSE 0 END AS nb
  FROM params p JOIN starts s USING (win) JOIN sizes z USING (win) LEFT JOIN rooted r ON r.win = p.win AND r.param = p.param GROUP BY ALL),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY win ORDER BY nb DESC, param) = 1),
numbered AS (SELECT r.win, r.u, dense_rank() OVER (PARTITION BY r.win ORDER BY r.root) - 1 AS label FROM rooted r JOIN best USING (win, param))"""


@query("adaptive_eps", f"""WITH RECURSIVE {ADAPTIVE_SQL}
SELECT p.win AS "window", p.node, coalesce(n.label, -1) AS label, b.low AS eps_min, {s6('b.eps')} AS eps, CASE WHEN b.low IS NOT NULL THEN b.nb END AS nb_cluster
FROM points p JOIN best b USING (win) LEFT JOIN numbered n ON n.win = p.win AND n.u = p.node""")
def _(spark, d):
    """Every window searches radii of its own."""
    labels, chosen = clusters.adaptive_sweep(refit_points(spark, d), SIZE_MIN)
    return labels.join(chosen, "window").select(
        "window", "node", F.col("label").cast("bigint").alias("label"), "eps_min", r6("eps").alias("eps"), "nb_cluster")


# Mean distance to each cluster, pair by pair.
def _silhouette_sql(rows: str, keys: str) -> str:
    k = [c.strip() for c in keys.split(",")]
    same = " AND ".join(f"a.{c} = b.{c}" for c in k)
    return f"""per AS (SELECT {', '.join('a.' + c for c in k)}, a.node, a.label, b.label AS other, sum(d.dist) AS s, count(*) AS n
  FROM {rows} a JOIN {rows} b ON {same} JOIN dists d ON d.a = a.node AND d.b = b.node
  WHERE a.label <> -1 AND b.label <> -1 GROUP BY ALL),
ab AS (SELECT {keys}, node, label, max(CASE WHEN other = label THEN n END) AS n,
  max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM per GROUP BY {keys}, node, label),
sil AS (SELECT {keys}, node, label, CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("silhouette", f"""WITH RECURSIVE {POINTS_SQL}, {_silhouette_sql('points', 'win')}
SELECT win AS "window", CAST(label AS BIGINT) AS label, {s6('avg(s)')} AS silhouette_score FROM sil GROUP BY GROUPING SETS ((win, label), (win))""")
def _(spark, d):
    out = silhouette(refit_points(spark, d), ["window"])
    return out.select("window", F.col("label").cast("bigint").alias("label"), r6("silhouette_score").alias("silhouette_score"))


@query("silhouette_sweep", f"""WITH RECURSIVE {DBSCAN_SQL}, {_silhouette_sql('labelled', 'win, param')},
scores AS (SELECT win, param, avg(s) AS score FROM sil GROUP BY ALL HAVING avg(s) IS NOT NULL),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY win ORDER BY score DESC, param) = 1)
SELECT w.win AS "window", CAST(coalesce(p.eps, 0.1) AS DOUBLE) AS eps, {s6('b.score')} AS silhouette_score
FROM (SELECT DISTINCT win FROM points) w LEFT JOIN best b USING (win) LEFT JOIN params p USING (param)""")
def _(spark, d):
    _, chosen = clusters.silhouette_sweep(refit_points(spark, d), GRID, [SIZE_MIN])
    return chosen.select("window", "eps", r6("silhouette_score").alias("silhouette_score"))


@query("label_vote", f"""WITH {NEWS_SQL}, {VECTORS_SQL}, {MEMBERS_SQL}
SELECT * FROM (SELECT anchor_id, CAST(label AS BIGINT) AS label, count(*) AS votes
  FROM members JOIN vectors v ON v.idx_news = member_id WHERE label <> -1 AND member_id <> anchor_id GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY votes DESC, label) = 1""")
def _(spark, d):
    span, clock = look(spark, d), cut_lineage(article_clock(spark, d))
    labels = article_vectors(spark, d).select("idx_news", "label").filter("label <> -1")
    voters = cut_lineage(windows.timed(clock).join(labels, "idx_news"))
    at = windows.anchors(clock, span)
    # An article has no vote on itself.
    own = voters.groupBy(F.col("idx_news").alias("anchor_id"), "label").agg(F.count("*").alias("own"))
    votes = at.withColumnRenamed("idx_news", "anchor_id").join(window_counts(at, voters, span), "t").join(own, ["anchor_id", "label"], "left")
    votes = votes.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter("n > 0")
    out = clusters.label_vote(votes, ["anchor_id"], n="n")
    return out.select("anchor_id", F.col("label").cast("bigint").alias("label"), "votes")


def chain_labels(spark, d, fit=lambda p: clusters.eps_sweep(p, GRID, SIZE_MIN)):
    """Fit every chain's first window, then label the later articles one by one."""
    from tidewire.plans import cluster_features

    vectors = article_vectors(spark, d)
    return cluster_features.chain_labels(vectors.select("idx_news", "date", "embedding"), look(spark, d), fit=fit)


SEARCHED = """SELECT win, param, p.eps FROM (SELECT win, param, count(DISTINCT label) AS nb FROM labelled GROUP BY ALL) JOIN params p USING (param)
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY nb DESC, param) = 1"""
# An eps at which some of the late articles join a cluster and some do not.
WIDE = GRID[24]
FIXED = f"SELECT DISTINCT win, param, CAST({WIDE} AS DOUBLE) AS eps FROM labelled WHERE param = {GRID.index(WIDE)}"


def _told_sql(best: str) -> str:
    """Step by step: the n-th late article of every chain votes among the articles labelled so far."""
    return f"""{DBSCAN_SQL}, best AS ({best}),
spans AS (SELECT chain_id, min(date) AS first, max(date) AS last FROM schedule WHERE eligible GROUP BY 1 HAVING max(date) > min(date)),
late AS MATERIALIZED (SELECT s.chain_id, v.idx_news AS id, v.date, b.eps, row_number() OVER (PARTITION BY s.chain_id ORDER BY v.date) AS n
  FROM spans s JOIN best b ON b.win = s.chain_id
  JOIN vectors v ON v.date > s.first - INTERVAL {HORIZON} MINUTE AND v.date <= s.last AND v.date <> s.first),
late_nbr AS MATERIALIZED (SELECT l.chain_id, l.id, d.b AS other FROM late l JOIN dists d ON d.a = l.id AND d.dist < l.eps
  JOIN news o ON o.idx_news = d.b WHERE o.date > l.date - INTERVAL {DAYS} DAY AND o.date <= l.date - INTERVAL {HORIZON} MINUTE),
told(chain_id, id, label, n) USING KEY (chain_id, id) AS (
  SELECT l.win, l.node, l.label, 0 FROM labelled l JOIN best USING (win, param)
  UNION (SELECT chain_id, id, CASE WHEN votes > {SIZE_MIN} THEN label ELSE -1 END, n FROM (
    SELECT l.chain_id, l.id, l.n, r.label, count(r.label) AS votes
    FROM (SELECT DISTINCT chain_id, n FROM told) t JOIN late l ON l.chain_id = t.chain_id AND l.n = t.n + 1
    LEFT JOIN late_nbr o ON o.chain_id = l.chain_id AND o.id = l.id
    LEFT JOIN recurring.told r ON r.chain_id = l.chain_id AND r.id = o.other AND r.label <> -1 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY votes DESC, label) = 1))"""


def _late_sql(best: str) -> str:
    return f"WITH RECURSIVE {_told_sql(best)} SELECT chain_id, id AS idx_news, label FROM told WHERE n > 0"


@query("incremental_labels", _late_sql(SEARCHED))
def _(spark, d):
    labels = chain_labels(spark, d).newcomers
    return labels.select("chain_id", F.col("id").alias("idx_news"), F.col("label").cast("bigint").alias("label"))


@query("incremental_labels_fixed", _late_sql(FIXED))
def _(spark, d):
    """The same with one eps for all windows."""
    from tidewire.plans.cluster_features import make_fit

    fit = make_fit("dbscan", opti=False, clustering_params={"eps": WIDE, "size_min": SIZE_MIN})
    labels = chain_labels(spark, d, fit).newcomers
    return labels.select("chain_id", F.col("id").alias("idx_news"), F.col("label").cast("bigint").alias("label"))


@query("k_sqrt", f"""WITH {WINDOW_SQL} SELECT idx_news, greatest(2, CAST(floor(sqrt(n_members)) AS BIGINT)) AS k FROM schedule""")
def _(spark, d):
    rows = windows.eligible_anchors(article_clock(spark, d), look(spark, d))
    return rows.select("idx_news", clusters.k_sqrt(F.col("n_members")).alias("k"))


def _kmeans_sql(ks: str, restarts: int, rounds: int = clusters.ROUNDS) -> str:
    """Seeding round by round, then Lloyd's method as a recursion over the centres still moving."""
    prime, drawn = clusters.PRIME, []
    for r in range(1, rounds + 1):
        drawn.append(f"""s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL
  SELECT win, init, c, node FROM (SELECT f.win, f.init, f.node, kmax, take, row_number() OVER (PARTITION BY f.win, f.init ORDER BY d.e / f.far, f.node) AS rn,
    1 + {r - 1} * take + rn - 1 AS c FROM (SELECT p.win, s.init, p.node, min(pow(list_distance(p.v, q.v), 2)) AS far
      FROM pts p JOIN s{r - 1} s USING (win) JOIN pts q ON q.win = s.win AND q.node = s.node GROUP BY ALL) f
    JOIN draws d ON d.win = f.win AND d.node = f.node AND d.init = f.init AND d.nth = {r} JOIN widest w ON w.win = f.win WHERE f.far > {clusters.SAME})
  WHERE rn <= take AND c < kmax)""")
    return f"""{POINTS_SQL},
pts AS MATERIALIZED (SELECT p.win, p.node, v.v FROM points p JOIN vectors v ON v.idx_news = p.node),
ks AS MATERIALIZED ({ks}),
widest AS MATERIALIZED (SELECT win, max(k) AS kmax, greatest(1, CAST(ceil((max(k) - 1) / {rounds}.0) AS BIGINT)) AS take FROM ks GROUP BY win),
draws AS MATERIALIZED (SELECT win, node, init, nth, (node % {prime} * 48271 + (init * 69621 + nth * 16807 + 12345)) % {prime} AS h0,
  (h0 * h0 + 3 * h0 + 7) % {prime} AS h1, (h1 * 48271 + 11) % {prime} AS h2, (h2 * h2 + 5) % {prime} AS h3, -ln((h3 + 0.5) / {prime}) AS e
  FROM pts, (SELECT unnest(range(0, {restarts})) AS init), (SELECT unnest(range(0, {rounds + 1})) AS nth)),
s0 AS MATERIALIZED (SELECT win, init, CAST(0 AS BIGINT) AS c, node FROM draws WHERE nth = 0 QUALIFY row_number() OVER (PARTITION BY win, init ORDER BY e, node) = 1),
{", ".join(drawn)},
cent(win, k, init, c, v, live, step) USING KEY (win, k, init, c) AS (
  SELECT s.win, ks.k, s.init, s.c, q.v, true, 0 FROM s{rounds} s JOIN ks USING (win) JOIN pts q ON q.win = s.win AND q.node = s.node WHERE s.c < ks.k
  UNION (SELECT win, k, init, c, v, max(shift) OVER (PARTITION BY win, k, init) > 0.0001, step + 1 FROM (
    SELECT o.win, o.k, o.init, o.c, coalesce(m.v, o.v) AS v, list_distance(coalesce(m.v, o.v), o.v) AS shift, o.step FROM cent o LEFT JOIN (
      SELECT win, k, init, c, list(x ORDER BY j) AS v FROM (
        SELECT a.win, a.k, a.init, a.m.c AS c, j, avg(p.v[j]) AS x FROM (
          SELECT p.win, o.k, o.init, p.node, min({{'d': list_distance(p.v, o.v), 'c': o.c}}) AS m FROM cent o JOIN pts p USING (win) WHERE o.live GROUP BY ALL) a
        JOIN pts p ON p.win = a.win AND p.node = a.node, (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL) GROUP BY ALL) m
    ON m.win = o.win AND m.k = o.k AND m.init = o.init AND m.c = o.c WHERE o.live))),
final AS MATERIALIZED (SELECT p.win, o.k, o.init, p.node, min({{'d': list_distance(p.v, o.v), 'c': o.c}}) AS m FROM cent o JOIN pts p USING (win) GROUP BY ALL),
won AS (SELECT win, k, init FROM (SELECT win, k, init, sum(pow(m.d, 2)) AS cost FROM final GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY win, k ORDER BY round(cost, 9), init) = 1),
firsts AS (SELECT win, k, node, min(node) OVER (PARTITION BY win, k, m.c) AS lowest FROM final JOIN won USING (win, k, init)),
grouped AS MATERIALIZED (SELECT win, k, node, dense_rank() OVER (PARTITION BY win, k ORDER BY lowest) - 1 AS label FROM firsts)"""


SQUARE_ROOT = "SELECT win, greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS k FROM pts GROUP BY win"
SOME_KS = "SELECT DISTINCT win, k FROM pts, (SELECT unnest(range(2, 8)) AS k)"
RESTARTS = 20


@query("kmeans", f"""WITH RECURSIVE {_kmeans_sql(SQUARE_ROOT, RESTARTS)} SELECT win AS "window", k, node, label FROM grouped""")
def _(spark, d):
    out = clusters.kmeans(refit_points(spark, d), n_init=RESTARTS)
    return out.select("window", F.col("k").cast("bigint").alias("k"), "node", F.col("label").cast("bigint").alias("label"))


@query("k_select", f"""WITH RECURSIVE {_kmeans_sql(SOME_KS, RESTARTS)}, {_silhouette_sql('grouped', 'win, k')},
scores AS (SELECT win, k, avg(s) AS score FROM sil GROUP BY ALL)
SELECT win AS "window", k, {s6('score')} AS silhouette_score FROM scores QUALIFY row_number() OVER (PARTITION BY win ORDER BY score DESC NULLS LAST, k) = 1""")
def _(spark, d):
    _, chosen = clusters.k_select(refit_points(spark, d), "silhouette_score", range(2, 8), n_init=RESTARTS)
    return chosen.select("window", F.col("k").cast("bigint").alias("k"), r6("silhouette_score").alias("silhouette_score"))
