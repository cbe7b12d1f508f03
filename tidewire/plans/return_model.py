"""From feature rows and price bars to fitted return models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import market, regression
from tidewire.operators.feed import with_prefix


def fit_return_models(
    features: DataFrame, bars: DataFrame, target: str = "target_180min",
    horizons: tuple[int, ...] = (15, 30, 60, 90, 180), vif: bool = False, eps: float = 1e-5,
) -> dict[str, DataFrame]:
    """Least squares and lasso on the first 60 % of the rows in time, errors on the last 20 %."""
    with_targets = market.add_forward_return(features, bars, list(horizons), "target")
    frame = regression.split_frame(regression.model_frame(with_targets))
    train, test = (frame.filter(F.col("split") == s) for s in ("train", "test"))
    names = with_prefix(frame, "feat")
    coefficients, predict = regression.ols(train, names, target)
    penalised, alpha = regression.lasso(train, names, target, vif)
    return {
        "ols": coefficients,
        "ols_metrics": regression.hold_out_metrics(predict(test), target),
        "lasso": penalised.withColumn("alpha", F.lit(alpha)),
        "lasso_selected": regression.selected(penalised, eps),
    }
