"""Regression scores (EVL) and the tables behind the score charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.operators.distribution import histogram, with_diagonal

_EPS = 2.220446049250313e-16  # fixed value: the smallest |actual| that MAPE divides by


def with_residual(df: DataFrame, actual: str, predicted: str, name: str = "residual") -> DataFrame:
    """SCA11: actual minus predicted."""
    return df.withColumn(name, F.col(actual) - F.col(predicted))


def score_columns(actual: str, predicted: str) -> list[Column]:
    """EVL01-03 as aggregates: RMSE, MAPE (a fraction) and R2. A constant target scores R2 1 when
    predicted exactly, else 0."""
    y, p = F.col(actual), F.col(predicted)
    error = y - p
    sse = F.sum(error * error)
    sst = F.regr_syy(y, y)
    r2 = F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    return [
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(_EPS))).alias("MAPE"),
        r2.alias("R2"),
    ]


def metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row of scores."""
    return df.agg(*score_columns(actual, predicted))


def by_model(predictions: DataFrame, actual: str, models: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide predictions to ``(keep..., actual, model, predicted)``; ``models`` maps name to column."""
    renamed = predictions.select(*keep, actual, *[F.col(c).alias(name) for name, c in models.items()])
    return renamed.unpivot([*keep, actual], list(models), "model", "predicted")


def evaluate(predictions: DataFrame, actual: str, models: Mapping[str, str]) -> DataFrame:
    """EVL04, EVL07: scores of all models from one pass, best RMSE first."""
    long = by_model(predictions, actual, models)
    return long.groupBy("model").agg(*score_columns(actual, "predicted")).orderBy("RMSE", "model")


def best_model(scores: DataFrame) -> DataFrame:
    """SRT03: the row with the lowest RMSE."""
    return scores.orderBy("RMSE", "model").limit(1)


def residual_histogram(predictions: DataFrame, actual: str, models: Mapping[str, str], bins: int = 40) -> DataFrame:
    """EVL05: residual bins per model, each over the model's own range."""
    long = with_residual(by_model(predictions, actual, models), actual, "predicted")
    return histogram(long, "residual", bins, keys=["model"])


def actual_vs_predicted(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """EVL06: every row's pair of values, and the common range of both axes."""
    return with_diagonal(predictions.select(actual, predicted), actual, predicted)
