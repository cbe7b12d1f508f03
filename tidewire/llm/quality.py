"""Quality rules: a decision list learned by sequential covering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACE, discard, let, store, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

Get = Callable[[str], Column]


def _per_word(count: str) -> Callable[[Get], Column]:
    return lambda get: get(count) / F.greatest(get("n_words"), F.lit(1))


#: What conditions may look at: name -> expression over the counts.
FEATURES: dict[str, Callable[[Get], Column]] = {
    "n_words": lambda get: get("n_words"),
    "mean_word": _per_word("word_chars"),
    "symbol_share": _per_word("n_symbols"),
    "dup_lines": lambda get: get("n_dup_lines"),
    "repeat_share": _per_word("n_repeat_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def test(self, get: Get) -> Column:
        value = FEATURES[self.feature](get)
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice; ``windows`` has one hash per start."""

    def covered(ordered: Column) -> Column:
        def same(i: Column, x: Column) -> Column:
            other = F.get(ordered, i)
            return F.coalesce(other["hash"] == x["hash"], F.lit(False))

        twice = F.filter(ordered, lambda x, i: same(i - 1, x) | same(i + 1, x))
        starts = F.array_sort(F.transform(twice, lambda x: x["at"]))
        before = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
        return F.aggregate(
            starts,
            before,
            lambda acc, s: F.struct(s.alias("last"), (acc["words"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("words")),
            lambda acc: acc["words"],
        )

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    return let(ordered, covered)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` with the counts of every whole text, row by row and without a shuffle.

    With ``rules`` also base_failed and kept.
    """
    text = F.coalesce("text", F.lit(""))

    def counts(words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            let(
                windows,
                lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_repeated(w)),
            ).cast("bigint").alias("n_repeat_words"),
        )

    # Words and windows are bound inside the expression: however the optimizer moves it,
    # a text is split once per evaluation.
    made = let(words_of(F.col("text")), counts)
    if rules is not None:
        made = let(made, lambda c: c.withField("base_failed", base_failed(c.getItem)).withField("kept", ~base_failed(c.getItem) & ~matches(rules, c.getItem)))
    return docs.select(*keep, made.alias("_counts")).select(*keep, "_counts.*")


def base_failed(get: Get = F.col) -> Column:
    return (get("n_words") < 20) | (100 * get("n_repeat_words") > 30 * get("n_words"))


def matches(rules: list[Rule], get: Get = F.col) -> Column:
    """Whether a rule of the list fires: the list as ordered conditional expressions."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [c.test(get) for c in rule])
        out = F.when(test, True) if out is None else out.when(test, True)
    return F.lit(False) if out is None else out.otherwise(False)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    bins: int = 24,
    max_rules: int = 6,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_support: int = 10,
) -> list[Rule]:
    """Rules whose matches are bad documents (quality 0), most precise first.

    Sequential covering on at most about ``max_labelled`` labelled documents (drawn by
    the hash of doc_id; the bound on what is fitted, not on what is judged): a rule
    grows by the condition with the best FOIL gain, is pruned on the third of the
    documents held out, and joins the list if its held-out precision is at least
    ``min_precision``; what it covers is set aside for the next one. All statistics
    are counts per feature, bin and label, made by Spark; the driver sees at most
    features x bins x 2 rows. Documents labelled twice count as bad if one label says
    so; null labels are left out; without labels of both kinds the list is empty.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marked.count()
    if n == 0:
        return []
    share = min(1.0, max_labelled / n)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # About max_labelled rows of two numbers: bounded by the parameter.
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    counted = store(measure(joined, ("doc_id", "quality")))
    table = store(
        counted.where(~base_failed()).select(
            "*",
            (F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0).alias("_held"),
            *[e(F.col).cast("double").alias(f"_{f}") for f, e in FEATURES.items()],
        )
    )
    spread = [q / bins for q in range(1, bins)]
    row = table.agg(*[F.percentile_approx(f"_{f}", spread, 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(row[f] or ())) for f in FEATURES}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = table.where(~matches(rules))
        rule = _grow(rest.where("not _held"), cuts, max_conditions, min_support)
        rule = _prune(rest.where("_held"), rule)
        if not rule:
            break
        bad, good = _counts(rest.where("_held"), rule)
        if bad < max(1, min_support // 3) or bad < min_precision * (bad + good):
            break
        rules.append(rule)
    discard(counted, table)
    return rules


def _counts(rows: DataFrame, rule: Rule) -> tuple[int, int]:
    got = rows.where(matches([rule])).agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") != 0)).first()
    return got[0], got[1]


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int, support: int) -> Rule:
    import math

    rule: Rule = ()
    while len(rule) < most:
        now = rows.where(matches([rule])) if rule else rows
        bins = [
            F.struct(F.lit(f).alias("feature"), reduce(lambda a, c: a + c, [(F.col(f"_{f}") > c).cast("int") for c in cuts[f]], F.lit(0)).alias("bin"))
            for f in cuts
            if cuts[f]
        ]
        if not bins:
            break
        seen = (
            now.select((F.col("quality") == 0).alias("bad"), F.explode(F.array(*bins)).alias("b"))
            .groupBy("b.feature", "b.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        )
        by = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in seen}
        first = next(iter(f for f in cuts if cuts[f]))
        p0, n0 = (sum(by.get((first, b), (0, 0))[k] for b in range(len(cuts[first]) + 1)) for k in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, own in cuts.items():
            for i, c in enumerate(own):
                for above in (True, False):
                    side = range(i + 1, len(own) + 1) if above else range(i + 1)
                    p, q = (sum(by.get((f, b), (0, 0))[k] for b in side) for k in (0, 1))
                    if p < support:
                        continue
                    g = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Condition(f, above, float(c)), g
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(held: DataFrame, rule: Rule) -> Rule:
    """Drop last conditions while the held-out value (bad - good) / (bad + good) does not fall."""

    def worth(r: Rule) -> float:
        bad, good = _counts(held, r)
        return (bad - good) / (bad + good) if bad + good else -1.0

    best = worth(rule) if rule else -1.0
    while len(rule) > 1:
        shorter = worth(rule[:-1])
        if shorter < best:
            break
        rule, best = rule[:-1], shorter
    return rule


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    A document fails the base with fewer than 20 words or with over 30 % of its words
    in repeated 8-word windows; it is kept if it passes and no rule matches. A null or
    empty text has no words and fails. Rows with one doc_id are judged one by one;
    columns not in ``keep`` are left out. Word windows are compared by 64-bit hashes.
    """
    return measure(docs, keep, rules)
