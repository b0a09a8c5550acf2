"""Q38-Q46: ticket fares, distances and destinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import safe_divide
from routestats.operators.aggregate import group_mean, scalar_stats, value_counts
from routestats.operators.distribution import (
    box_stats,
    corr_matrix,
    histogram,
    lower_triangle,
    pair_data,
    pair_marginals,
    scatter_data,
)
from routestats.operators.filters import clip_below_quantile
from routestats.operators.joins import lookup, semi_top_k
from routestats.operators.quantiles import quantiles
from routestats.operators.topk import order_by_value, top_k
from routestats.plans.schemas import AIRPORT_STATE

MEASURES = ["PASSENGERS", "MARKET_FARE", "MARKET_DISTANCE"]
BOXED = ["MARKET_FARE", "MARKET_DISTANCE", "PASSENGERS", "FARE_PER_MILE"]
FARE_BINS, DISTANCE_BINS, CLIP, PAIR_SAMPLE, SCATTER_SAMPLE = 60, 50, 0.99, 3000, 5000


def fare_histogram(df: DataFrame) -> DataFrame:
    """Q38: fare bins."""
    return histogram(df, "MARKET_FARE", FARE_BINS)


def fare_center(df: DataFrame) -> DataFrame:
    """Q38: mean and median fare."""
    median = quantiles(df, ["MARKET_FARE"], [0.5]).select("value").scalar()
    return scalar_stats(df, {"mean_fare": F.avg("MARKET_FARE")}).withColumn("median_fare", median)


def distance_histogram(df: DataFrame) -> DataFrame:
    """Q39: distance bins."""
    return histogram(df, "MARKET_DISTANCE", DISTANCE_BINS)


def distance_mean(df: DataFrame) -> DataFrame:
    """Q39: mean distance."""
    return scalar_stats(df, {"mean_distance": F.avg("MARKET_DISTANCE")})


def fare_scatter(df: DataFrame, keys: Sequence[str], n: int = SCATTER_SAMPLE) -> DataFrame:
    """Q40: sampled distances and fares."""
    return scatter_data(df, "MARKET_DISTANCE", "MARKET_FARE", n, keys).select("MARKET_DISTANCE", "MARKET_FARE")


def top_airports(df: DataFrame, col: str, k: int = 15) -> DataFrame:
    """Q41: destinations or origins with the most tickets."""
    return top_k(value_counts(df, col), k, "n", [col])


def fare_at_top_destinations(df: DataFrame, k: int = 15) -> DataFrame:
    """Q42: mean fare at the most frequent destinations, lowest first."""
    return order_by_value(group_mean(semi_top_k(df, "DEST", k), ["DEST"], "MARKET_FARE", "mean_fare"), "mean_fare", ["DEST"])


def with_fare_per_mile(df: DataFrame) -> DataFrame:
    """Q43: fare per mile; missing where the distance is zero."""
    return df.withColumn("FARE_PER_MILE", safe_divide("MARKET_FARE", "MARKET_DISTANCE"))


def _fare_per_mile_clipped(df: DataFrame) -> DataFrame:
    return clip_below_quantile(with_fare_per_mile(df).dropna(subset=["FARE_PER_MILE"]), "FARE_PER_MILE", CLIP)


def fare_per_mile_histogram(df: DataFrame) -> DataFrame:
    """Q43: fare-per-mile bins below the 99th percentile."""
    return histogram(_fare_per_mile_clipped(df), "FARE_PER_MILE", FARE_BINS)


def fare_per_mile_mean(df: DataFrame) -> DataFrame:
    """Q43: mean of the clipped fare per mile."""
    return scalar_stats(_fare_per_mile_clipped(df), {"mean_fare_per_mile": F.avg("FARE_PER_MILE")})


def correlations(df: DataFrame) -> DataFrame:
    """Q44: correlation of the three measures."""
    return corr_matrix(df, MEASURES)


def correlations_lower(df: DataFrame) -> DataFrame:
    """Q44: the same, lower triangle."""
    return lower_triangle(correlations(df), MEASURES)


def with_dest_state(df: DataFrame) -> DataFrame:
    """Q45: the destination's state, "Other" for airports not listed."""
    return lookup(df, "DEST", AIRPORT_STATE, "DEST_STATE", "Other")


def pair_sample(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q45: sampled rows of the three measures with the destination state."""
    return pair_data(with_dest_state(df), MEASURES, n, keys, "DEST_STATE")


def pair_densities(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q45: the densities by state on the diagonal of that pair plot."""
    return pair_marginals(pair_sample(df, keys, n), MEASURES, "DEST_STATE")


def boxes_by_state(df: DataFrame) -> DataFrame:
    """Q46: box statistics of four measures by destination state, without "Other"."""
    listed = with_dest_state(with_fare_per_mile(df)).where(F.col("DEST_STATE") != "Other")
    return box_stats(listed, "DEST_STATE", BOXED)
