"""ML01, ML02 and Q07-Q09, Q53, Q54: the route-by-quarter table, the fare models and their scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.functions.scalars import flag_ge, route_key, safe_divide
from routestats.operators.aggregate import aggregate_capacity, aggregate_fares
from routestats.operators.clean import ensure_column, fill_const, impute_median, require_columns
from routestats.operators.distribution import corr_matrix
from routestats.operators.evaluate import actual_vs_predicted, evaluate, residual_histogram
from routestats.operators.joins import join_calendar, join_on
from routestats.operators.models import MODELS, Fit, ModelResults, fit_models, predict, prediction_table, with_split
from routestats.operators.scale import group_sizes
from routestats.operators.topk import head
from routestats.operators.windows import lag_by, partition_mean, rolling_mean
from routestats.plans import cleaning
from routestats.plans.schemas import ROUTE_KEYS
from routestats.session import materialize
from routestats.sources.tables import matrix_wide, read_optional, write_matrix, write_table

SATURATED_AT = 0.8  # fixed value: load factor from which a route counts as saturated

# Model inputs, in order, and the target.
IMPUTED = [
    "load_factor", "route_avg_load_factor", "lag_load_factor", "rolling_load_factor_2",
    "market_distance", "avg_fuel_price", "passengers_db1b",
]
FEATURES = [*IMPUTED, "is_saturated"]
TARGET = "avg_fare"


def build_analysis_table(
    fares: DataFrame, capacity: DataFrame, fuel: DataFrame, save_to: str | None = None, ordered: bool = True
) -> DataFrame:
    """ML01, Q07: fares and capacity per route and quarter, with fuel price and load factor.

    Both fact tables shrink to route and quarter before they meet, partitioned alike, so the join
    moves nothing again and no route can be hot in it. The result is sorted by route key, which a
    later step that regroups it has no use for (``ordered=False``).
    """
    routes = join_on(
        aggregate_fares(fares, ROUTE_KEYS, "MARKET_FARE", "PASSENGERS", "MARKET_DISTANCE"),
        aggregate_capacity(capacity, ROUTE_KEYS, "PASSENGERS", "SEATS", "DEPARTURES_PERFORMED"),
        ROUTE_KEYS,
    )
    table = (
        join_calendar(routes, fuel, "observation_date", {"avg_fuel_price": F.avg("DJFUELUSGULF")})
        .withColumn("load_factor", safe_divide("passengers_t100", "seats"))
        .withColumn("route", route_key("ORIGIN", "DEST"))
        .withColumn("is_saturated", flag_ge("load_factor", SATURATED_AT))
    )
    table = table.orderBy(*ROUTE_KEYS) if ordered else table
    return write_table(table, save_to) if save_to else table


def with_route_features(analysis: DataFrame) -> DataFrame:
    """WIN01-03 on the route history: its longest route is counted once, and while it is short one
    shuffle by route serves all three."""
    df = ensure_column(analysis, "route", route_key("ORIGIN", "DEST"))
    bound = group_sizes(df, ["route"])[0]
    order = ["YEAR", "QUARTER"]
    df = partition_mean(df, ["route"], "load_factor", "route_avg_load_factor", group_rows=bound)
    df = lag_by(df, ["route"], order, "load_factor", "lag_load_factor", fill="load_factor", group_rows=bound)
    return rolling_mean(
        df, ["route"], order, "load_factor", "rolling_load_factor_2", 2, 1, fill="load_factor", group_rows=bound
    )


def build_model_frame(analysis: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """ML02: features and target without gaps in the features.

    Route features come before imputation. Medians are over all rows unless ``fit_on`` names
    others, e.g. the training rows with their route features.
    """
    df = with_route_features(analysis)
    if fit_on is None and set(IMPUTED) <= set(df.columns):
        df = materialize(df, "route-features")  # the medians and the result both read it
    df = impute_median(df, IMPUTED, 0.0, fit_on)
    if "is_saturated" in df.columns:
        df = fill_const(df, {"is_saturated": 0}, "int")
    return require_columns(df, [*FEATURES, TARGET]).dropna(subset=[*FEATURES, TARGET])


def split_frame(analysis: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """ML02, ML03: the stored model frame, its rows marked ``is_test`` or not."""
    frame = materialize(build_model_frame(analysis).select(*ROUTE_KEYS, *FEATURES, TARGET), "model-frame")
    return materialize(with_split(frame, ROUTE_KEYS, test, seed), "split")


def run_modeling(
    analysis: DataFrame,
    test: float = 0.2,
    seed: int = 42,
    models: Mapping[str, Fit] = MODELS,
    save_to: str | None = None,
) -> ModelResults:
    """Q08: split, fit every model, predict the test rows, correlate all model rows."""
    return fit_split(split_frame(analysis, test, seed), models, save_to)


def fit_split(marked: DataFrame, models: Mapping[str, Fit] = MODELS, save_to: str | None = None) -> ModelResults:
    """ML09-ML12 on a frame that is already split."""
    train, held = marked.where(~F.col("is_test")), marked.where("is_test")
    fitted = fit_models(train, FEATURES, TARGET, models)
    predictions = materialize(prediction_table(fitted, held, ROUTE_KEYS, FEATURES, TARGET), "predictions")
    correlation = corr_matrix(marked, [*FEATURES, TARGET])
    if save_to:
        write_matrix(correlation, f"{save_to}/correlation_matrix", [*FEATURES, TARGET])
        write_table(predictions, f"{save_to}/test_predictions")
        for name, model in fitted.items():
            model.write().overwrite().save(f"{save_to}/models/{name}")
    return ModelResults([*FEATURES], TARGET, list(ROUTE_KEYS), fitted, train, held, predictions, correlation)


def correlation_table(results: ModelResults) -> DataFrame:
    """SNK03: the labelled square form of the correlations."""
    return matrix_wide(results.correlation, [*results.features, results.target])


def evaluate_results(results: ModelResults, save_to: str | None = None) -> DataFrame:
    """Q09: one row of scores per model, best first.

    ``save_to`` also gets the tables behind the charts: the residual bins of all models, and every
    actual value with its prediction for each model.
    """
    actual, columns = f"actual_{results.target}", results.prediction_columns
    scores = evaluate(results.predictions, actual, columns)
    if not save_to:
        return scores
    write_table(residual_histogram(results.predictions, actual, columns), f"{save_to}/residuals")
    for name, column in columns.items():
        write_table(actual_vs_predicted(results.predictions, actual, column), f"{save_to}/actual_vs_predicted/{name}")
    return write_table(scores, f"{save_to}/model_metrics")


def predict_fares(
    frame: DataFrame,
    model: PipelineModel | None = None,
    name: str = "linear_regression",
    model_path: str | None = None,
) -> DataFrame:
    """ML11: predicted fares from one model, given or stored; nothing is refitted."""
    fitted = model or PipelineModel.load(f"{model_path}/{name}")
    return predict(fitted, name, frame, "predicted_avg_fare")


def report_tables(spark: SparkSession, outputs: str, rows: int = 50) -> dict[str, DataFrame] | None:
    """Q53: scores and the first predictions, or None while there are no outputs."""
    scores = read_optional(spark, f"{outputs}/evaluation/model_metrics")
    predictions = read_optional(spark, f"{outputs}/modeling/test_predictions")
    if scores is None or predictions is None:
        return None
    return {"metrics": scores.orderBy("RMSE", "model"), "predictions": head(predictions, rows, ROUTE_KEYS)}


def run_all(
    spark: SparkSession,
    raw_folder: str,
    work: str,
    period: cleaning.Period = cleaning.Period(),
    models: Mapping[str, Fit] = MODELS,
) -> DataFrame:
    """Q54: clean, join, model, score; every stage is stored. Returns the scores, best model first."""
    tables = cleaning.preprocess(spark, raw_folder, f"{work}/cleaned", period)
    build_analysis_table(tables["db1b"], tables["t100"], tables["fuel"], f"{work}/cleaned/analysis_table")
    analysis = spark.read.parquet(f"{work}/cleaned/analysis_table")
    results = run_modeling(analysis, models=models, save_to=f"{work}/outputs/modeling")
    return evaluate_results(results, f"{work}/outputs/evaluation")
