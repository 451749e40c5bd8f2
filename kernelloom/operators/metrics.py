"""Forecast scores on arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.functions.arrays import mean

LEAST = 1e-12


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(mean(F.zip_with(y, yhat, lambda a, b: (a - b) * (a - b))))


def relative_rmse(y: Column, yhat: Column) -> Column:
    """RMSE over the root mean square of y; 0 where that is next to 0."""
    size = F.sqrt(mean(F.transform(y, lambda v: v * v)))
    return F.when(size > LEAST, rmse(y, yhat) / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def mase(y: Column, yhat: Column, history: Column) -> Column:
    """Mean absolute error over the history's mean absolute step; 0 where that is next to 0."""
    error = mean(F.zip_with(y, yhat, lambda a, b: F.abs(a - b)))
    n = F.size(history)
    steps = F.zip_with(F.slice(history, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(history, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    size = F.when(n > 1, mean(steps)).otherwise(0.0)
    return F.when(size > LEAST, error / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def scored(predictions: DataFrame, y: str = "future", yhat: str = "future_pred", history: str = "history") -> DataFrame:
    a, b, h = F.col(y), F.col(yhat), F.col(history)
    return predictions.withColumns({"rmse": rmse(a, b), "relative_rmse": relative_rmse(a, b), "mase": mase(a, b, h)})


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """n_test, mean_rmse, mean and median of the relative error and of MASE, by the given columns."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("n_test"), F.avg("rmse").alias("mean_rmse"), F.avg("relative_rmse").alias("mean_rel_rmse"), F.median("relative_rmse").alias("median_rel_rmse"),
        F.avg("mase").alias("mean_mase"), F.median("mase").alias("median_mase"),
    )


def model_summary(scores: DataFrame, *by: str) -> DataFrame:
    """``summary`` with what the models were: kernel, n_train, lengthscale, gamma, of rows by ``run_all_domains``."""
    models = scores.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("kernel", "n_train", "lengthscale", "gamma")])
    return models.join(summary(scores, *by), list(by)) if by else models.join(summary(scores))
