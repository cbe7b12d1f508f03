"""Return regressions: frame, collinearity, lasso and least squares.

One pass over the rows sums their cross products; everything after that is small
matrix work whose size depends on the number of features and not of rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.errors.exceptions.captured import UnsupportedOperationException

from tidewire.operators import kernels
from tidewire.operators.feed import distinct_columns, with_prefix
from tidewire.operators.ordering import chrono_split, contiguous_folds
from tidewire.session import cut_lineage


def model_frame(df: DataFrame, key: str = "idx_news") -> DataFrame:
    """Rows with all targets present; features as doubles with NULL as 0."""
    targets, feats = with_prefix(df, "target"), with_prefix(df, "feat")
    kept = df.dropna("any", subset=targets).select(
        key, "date", *[F.col(c).cast("double").alias(c) for c in distinct_columns(feats + targets)]
    )
    return kept.fillna(0.0, subset=feats)


def split_frame(frame: DataFrame, key: str = "idx_news") -> DataFrame:
    """The frame with its chronological 60/20/20 ``split``, stored once."""
    return cut_lineage(chrono_split(frame, ["date", key], key))


def cross_products(df: DataFrame, columns: list[str], by: str) -> dict[object, np.ndarray]:
    """Sum of [1, x][1, x]ᵀ per value of ``by``; tasks send one matrix each."""
    rows = df.select(by, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    kind = dict(rows.dtypes)[by]

    def partial(batches):
        sums: dict[object, np.ndarray] = {}
        arrow_type = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            arrow_type = t.schema.field(by).type
            x = kernels.matrix(t, "x")
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            group = np.array(t.column(by).to_pylist(), dtype=object)
            for g in set(group.tolist()):
                part = x[group == g]
                sums[g] = sums.get(g, 0.0) + part.T @ part
        for g, m in sums.items():
            n = len(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * n, type=arrow_type), pa.array(np.arange(n, dtype=np.int32)), kernels.vectors(m)],
                names=[by, "i", "row"],
            )

    parts = rows.mapInArrow(partial, f"{by} {kind}, i int, row array<double>")
    total = parts.groupBy(by, "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out: dict[object, dict[int, list[float]]] = {}
    # At most (values of ``by``) x (features + 1) rows reach the driver.
    for r in total.collect():
        out.setdefault(r[by], {})[r["i"]] = r["row"]
    return {g: np.array([m[i] for i in sorted(m)]) for g, m in out.items()}


# --- collinearity -----------------------------------------------------------------


def inflation(gram: np.ndarray) -> np.ndarray:
    """Variance inflation without a constant, from the Gram matrix."""
    size = np.sqrt(np.diag(gram))
    scale = np.where(size > 0, size, 1.0)
    c = gram / np.outer(scale, scale)
    if np.all(size > 0) and np.linalg.cond(c) < 1e10:
        return np.diag(np.linalg.inv(c)).copy()
    out = np.full(len(c), np.nan)
    for i in np.flatnonzero(size > 0):
        rest = np.delete(np.arange(len(c)), i)
        r2 = c[i, rest] @ np.linalg.pinv(c[np.ix_(rest, rest)], rcond=1e-10) @ c[rest, i]
        out[i] = 1.0 / (1.0 - r2) if 1.0 - r2 > 1e-10 else np.inf
    return out


def vif_table(train: DataFrame, features: Iterable[str], thresh: float = 5.0) -> DataFrame:
    """(feature, step, vif, kept): drops the largest VIF above ``thresh`` until none is.

    ``step`` counts the drops; kept features carry their final VIF.
    """
    names = distinct_columns(features)
    m = cross_products(train.withColumn("_all", F.lit(0)), names, "_all")[0][1:, 1:]
    left, rows = list(range(len(names))), []
    while left:
        vif = inflation(m[np.ix_(left, left)])
        worst = int(np.nanargmax(vif)) if not np.all(np.isnan(vif)) else None
        if worst is None or not vif[worst] > thresh:
            rows += [(names[i], None, float(v), True) for i, v in zip(left, vif)]
            break
        rows.append((names[left[worst]], len(rows) + 1, float(vif[worst]), False))
        left.pop(worst)
    return train.sparkSession.createDataFrame(rows, "feature string, step int, vif double, kept boolean")


def reduce_vif(train: DataFrame, features: Iterable[str], thresh: float = 5.0) -> list[str]:
    table = vif_table(train, features, thresh).filter("kept").select("feature").collect()
    kept = {r["feature"] for r in table}
    return [f for f in distinct_columns(features) if f in kept]


# --- lasso ------------------------------------------------------------------------


def _descend(g: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent for ½wᵀgw - cᵀw + alpha·|w| from the start ``w``."""
    w = w.copy()
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(w)):
            if g[j, j] <= 0:
                continue
            pull = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / g[j, j]
            moved = max(moved, abs(new - w[j]) * np.sqrt(g[j, j]))
            w[j] = new
        if moved <= tol:
            break
    return w


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(gram, pull, feature means, target mean), per row, of a [1, x, y] matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    return cov[:-1, :-1], cov[:-1, -1], mean[:-1], mean[-1]


def lasso_cv(
    train: DataFrame, features: Iterable[str], target: str, key: str = "idx_news", folds: int = 5,
    n_alphas: int = 100, ratio: float = 1e-3, max_iter: int = 5000, tol: float = 1e-9,
) -> tuple[DataFrame, float]:
    """((feature, coef), alpha) on features scaled by the training rows.

    Folds are contiguous in time; the penalty with the lowest mean held-out error of a
    descending logarithmic grid is refitted on all rows. The rows are read once.
    """
    names = distinct_columns(features)
    # Products of centred values: a large mean costs no digits.
    mean = train.agg(*[F.avg(F.col(c).cast("double")) for c in [*names, target]]).first()
    centred = [(F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip([*names, target], mean)]
    folded = contiguous_folds(train.select(key, "date", *centred), ["date", key], key, folds)
    raw = cross_products(folded, names + [target], "fold")
    scale = np.abs(np.array([m or 0.0 for m in mean[:-1]]))
    total = sum(raw.values())
    rest = total[0, 1:-1] / total[0, 0]
    std = np.sqrt(np.maximum(np.diag(total)[1:-1] / total[0, 0] - rest**2, 0.0))
    shift = np.eye(len(total))
    safe = np.where(std > 1e-12 * np.maximum(scale, 1e-300), std, np.inf)
    for j in range(len(names)):
        shift[j + 1, j + 1] = 1.0 / safe[j]
        shift[j + 1, 0] = -rest[j] / safe[j]
    parts = {f: shift @ m @ shift.T for f, m in raw.items()}
    whole = sum(parts.values())
    g, c, _, _ = _centred(whole)
    top = np.abs(c).max() if len(c) else 0.0
    spread = tol * max(np.sqrt(whole[-1, -1] / whole[0, 0]), 1e-300)
    if top <= 0:
        best, w = 0.0, np.zeros(len(names))
    else:
        alphas = top * np.logspace(0, np.log10(ratio), n_alphas)
        errors = np.zeros((len(parts), n_alphas))
        for i, (f, held) in enumerate(sorted(parts.items())):
            gf, cf, zf, yf = _centred(whole - held)
            w = np.zeros(len(names))
            for k, alpha in enumerate(alphas):
                w = _descend(gf, cf, alpha, w, max_iter, spread)
                v = np.concatenate([[-(yf - zf @ w)], -w, [1.0]])
                errors[i, k] = v @ held @ v / held[0, 0]
        at = int(errors.mean(axis=0).argmin())
        best, w = float(alphas[at]), np.zeros(len(names))
        for alpha in alphas[: at + 1]:
            w = _descend(g, c, alpha, w, max_iter, spread)
    rows = [(n, float(x)) for n, x in zip(names, w)]
    return train.sparkSession.createDataFrame(rows, "feature string, coef double"), best


def lasso(
    train: DataFrame, features: Iterable[str], target: str, vif: bool = False, key: str = "idx_news", **options
) -> tuple[DataFrame, float]:
    """Lasso on all features or, with ``vif``, on those that survive the VIF pruning."""
    names = reduce_vif(train, features) if vif else distinct_columns(features)
    return lasso_cv(train, names, target, key, **options)


def selected(coefficients: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Coefficients above ``eps``; the comparison is signed, so negative ones go."""
    return coefficients.filter(F.col("coef") > eps)


# --- least squares ----------------------------------------------------------------


def ols(train: DataFrame, features: Iterable[str], target: str):
    """((term, coef, std_err, t, p), fitted model) with an intercept.

    A rank-deficient fit has coefficients but no standard errors.
    """
    names = distinct_columns(features)
    assembler = VectorAssembler(inputCols=names, outputCol="_x")
    model = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="prediction", solver="normal").fit(
        assembler.transform(train))
    coefs = [*model.coefficients.toArray().tolist(), model.intercept]
    try:
        s = model.summary
        extra = list(zip(s.coefficientStandardErrors, s.tValues, s.pValues))
    except UnsupportedOperationException:
        # A singular normal matrix: another solver gave the coefficients.
        extra = [(None, None, None)] * len(coefs)
    rows = [(n, float(b), *e) for n, b, e in zip([*names, "const"], coefs, extra)]
    table = train.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, t double, p double")
    return table, lambda df: model.transform(assembler.transform(df)).drop("_x")


def hold_out_metrics(predicted: DataFrame, target: str) -> DataFrame:
    """(mse, r2) of the predictions."""
    y, e = F.col(target), F.col(target) - F.col("prediction")
    return predicted.agg(
        F.avg(e * e).alias("mse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    )
