"""Language identification with character n-grams (naive Bayes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut_lineage, small


LONGEST = 3
# Characters that a task holds as numbers at once.
HELD = 1 << 22
# A character takes 21 bits of a run's number: its code point and one, 0 where the text has ended.
BITS = 21


def _runs(body: str) -> np.ndarray:
    """For each position of a text the number of the up to ``LONGEST`` characters that begin there.

    Every n-gram is a prefix of exactly one of them.
    """
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
    out = np.zeros(len(points), dtype=np.int64)
    for i in range(LONGEST):
        out[: len(points) - i] |= points[i:] << (BITS * (LONGEST - 1 - i))
    return out


def _text_of(run: int) -> str:
    points = (run >> (BITS * i) & ((1 << BITS) - 1) for i in range(LONGEST - 1, -1, -1))
    return "".join(chr(p - 1) for p in points if p)


def _number(gram: Column) -> Column:
    """The number of a run that is this gram and ends."""
    at = [F.when(F.length(gram) > i, F.shiftleft((F.ascii(F.substring(gram, i + 1, 1)) + 1).cast("bigint"), BITS * (LONGEST - 1 - i))) for i in range(LONGEST)]
    return sum((F.coalesce(x, F.lit(0).cast("bigint")) for x in at), F.lit(0).cast("bigint"))


def _prefixes(run: str) -> Column:
    """The numbers of the 1 to ``LONGEST`` characters that a run begins with."""
    ends = [BITS * i for i in range(LONGEST)]
    held = [F.when(F.col(run).bitwiseAND(F.lit((1 << BITS) - 1 << end)) != 0, F.col(run).bitwiseAND(F.lit(-1 << end))) for end in ends]
    return F.explode(F.array_compact(F.array(*held)))


def _counted(df: DataFrame, by: str, col: str, whole: bool = False) -> DataFrame:
    """(by, run, n): runs counted per row; with ``whole`` (by, run, n, start) per value of ``by`` in a part
    of a task's rows, and the text of the run.

    Rows stay one per distinct run, of a text or of many.
    """

    def count(batches):
        for batch in batches:
            key, bodies = batch.column(0), batch.column(1)
            if whole:
                values = key.dictionary_encode()
                key, at = values.dictionary, values.indices.fill_null(len(values.dictionary)).to_numpy()
                key = pa.concat_arrays([key, pa.nulls(1, key.type)])
            else:
                at = np.arange(batch.num_rows)
            waiting, size = [], 0
            for i in range(batch.num_rows):
                if bodies[i].is_valid:
                    waiting.append((at[i], _runs(bodies[i].as_py())))
                    size += len(waiting[-1][1])
                if waiting and (size >= HELD or i + 1 == batch.num_rows):
                    yield tally(key, waiting)
                    waiting, size = [], 0

    def tally(key, waiting):
        if whole:
            groups = {}
            for i, runs in waiting:
                groups.setdefault(i, []).append(runs)
            waiting = [(i, np.concatenate(runs)) for i, runs in groups.items()]
        found = [(i, *np.unique(runs, return_counts=True)) for i, runs in waiting]
        run = np.concatenate([f[1] for f in found])
        at = np.concatenate([np.full(len(f[1]), f[0], dtype=np.int64) for f in found])
        out = {by: key.take(pa.array(at)), "run": pa.array(run), "n": pa.array(np.concatenate([f[2] for f in found]))}
        if whole:
            out["start"] = pa.array([_text_of(x) for x in run.tolist()], pa.string())
        return pa.RecordBatch.from_pydict(out)

    kind = df.schema[by].dataType.simpleString()
    rows = df.select(by, F.lower(F.col(col)).alias("_body"))
    return rows.mapInArrow(count, f"`{by}` {kind}, run bigint, n bigint" + (", start string" if whole else ""))


def train_languages(df: DataFrame, col: str, lang: str = "lang") -> DataFrame:
    """(gram, logp map by language): smoothed log probabilities, stored once.

    The table grows with the alphabet and not with the corpus.
    """
    runs = _counted(df.select(F.col(lang).alias("lang"), col), "lang", col, whole=True)
    runs = runs.groupBy("lang", "run").agg(F.first("start").alias("start"), F.sum("n").alias("n"))
    long = [F.when(F.length("start") >= n, F.substring("start", 1, n)) for n in range(1, LONGEST + 1)]
    grams = runs.select("lang", F.explode(F.array_compact(F.array(*long))).alias("gram"), "n")
    counts = cut_lineage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    by_gram = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("seen"))
    vocab = by_gram.count()

    def logp(name: str) -> Column:
        seen = F.coalesce(F.try_element_at("seen", F.lit(name)), F.lit(0))
        return F.ln((seen + 1) / F.lit(float(totals[name] + vocab)))

    entries = [x for name in sorted(totals) for x in (F.lit(name), logp(name))]
    return cut_lineage(by_gram.select("gram", F.create_map(*entries).alias("logp")))


def detect_language(df: DataFrame, model: DataFrame, key: str, col: str) -> DataFrame:
    """(key, detected): best language; texts without a known gram are absent.

    The distinct character runs of the corpus are scored first. Against that small
    table each text's counts of runs collapse to one sum per language.
    """
    langs = sorted(r["l"] for r in model.select(F.explode(F.map_keys("logp")).alias("l")).distinct().collect())
    runs = _counted(df, key, col)
    known = model.select(_number(F.col("gram")).alias("gram"), *[F.col("logp")[lang].alias(lang) for lang in langs])
    sums = [F.sum(lang).alias(lang) for lang in langs]
    scores = (
        _counted(df.select(F.lit(0).alias("_all"), col), "_all", col, whole=True).select("run").distinct()
        .select("run", _prefixes("run").alias("gram")).join(known, "gram").groupBy("run").agg(*sums)
    )
    scored = runs.join(small(scores), "run").groupBy(key).agg(*[F.sum(F.col("n") * F.col(lang)).alias(lang) for lang in langs])
    # Equal scores go to the alphabetically first language.
    ranked = F.array(*[F.struct((-F.col(lang)).alias("s"), F.lit(lang).alias("lang")) for lang in langs])
    return scored.select(key, F.array_min(ranked)["lang"].alias("detected"))


def keep_language(
    df: DataFrame, wanted: str = "en", lang: str | None = None,
    model: DataFrame | None = None, key: str = "idx_news", col: str = "title_desc",
) -> DataFrame:
    """Rows in one language, by an existing column or by detection."""
    if lang:
        return df.filter(F.col(lang) == wanted)
    found = detect_language(df, model, key, col).filter(F.col("detected") == wanted)
    return df.join(found.select(key), key, "left_semi")
