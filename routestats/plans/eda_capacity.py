"""Q30-Q37: seats, passengers and load factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import route_key, safe_divide, sum0
from routestats.operators.aggregate import count_where, group_agg, group_sum
from routestats.operators.distribution import (
    box_stats,
    corr_matrix,
    histogram,
    lower_triangle,
    pair_data,
    pair_marginals,
    scatter_data,
)
from routestats.operators.filters import active_or_all, clip_below_quantile
from routestats.operators.profile import describe_exact
from routestats.operators.topk import top_k, top_k_then_sort
from routestats.plans.fare_model import SATURATED_AT

MEASURES = ["DEPARTURES_PERFORMED", "SEATS", "PASSENGERS", "LOAD_FACTOR"]
BINS, CLIP, PAIR_SAMPLE, SCATTER_SAMPLE = 50, 0.99, 3000, 5000


def with_load_factor(df: DataFrame) -> DataFrame:
    """Q30: passengers per seat; missing where there are no seats."""
    return df.withColumn("LOAD_FACTOR", safe_divide("PASSENGERS", "SEATS"))


def active_segments(df: DataFrame) -> DataFrame:
    """Q30: segments with seats; if there are none, all of them at load factor 0."""
    return active_or_all(with_load_factor(df), F.col("SEATS") > 0, {"LOAD_FACTOR": 0.0})


def seat_counts(df: DataFrame) -> DataFrame:
    """Q30: how many segments have seats, none, or are there at all."""
    return count_where(
        df, {"active": F.col("SEATS") > 0, "zero_seats": F.col("SEATS") == 0, "segments": F.lit(True)}
    )


def load_factor_histogram(df: DataFrame) -> DataFrame:
    """Q30: load factor bins."""
    return histogram(active_segments(df), "LOAD_FACTOR", BINS)


def load_factor_describe(df: DataFrame) -> DataFrame:
    """Q30: load factor profile."""
    return describe_exact(active_segments(df), ["LOAD_FACTOR"])


def clipped_histogram(df: DataFrame, col: str) -> DataFrame:
    """Q31: bins of PASSENGERS or SEATS below their 99th percentile."""
    return histogram(clip_below_quantile(active_segments(df), col, CLIP), col, BINS)


def _routes(df: DataFrame) -> DataFrame:
    return active_segments(df).withColumn("Route", route_key("ORIGIN", "DEST", " to "))


def top_routes(df: DataFrame, k: int = 15) -> DataFrame:
    """Q32: routes with the most passengers."""
    return top_k(group_sum(_routes(df), ["Route"], "PASSENGERS", "total_pax"), k, "total_pax", ["Route"])


def busiest_route_load(df: DataFrame, k: int = 15) -> DataFrame:
    """Q33: mean of the segments' load factors on the busiest routes, with the reference line."""
    routes = group_agg(_routes(df), ["Route"], {"avg_lf": F.avg("LOAD_FACTOR"), "total_pax": sum0("PASSENGERS")})
    return top_k_then_sort(routes, k, "total_pax", "avg_lf", ["Route"]).withColumn("threshold", F.lit(SATURATED_AT))


def top_origins(df: DataFrame, k: int = 15) -> DataFrame:
    """Q34: origins with the most departures."""
    sums = group_sum(active_segments(df), ["ORIGIN"], "DEPARTURES_PERFORMED", "departures")
    return top_k(sums, k, "departures", ["ORIGIN"])


def seats_scatter(df: DataFrame, keys: Sequence[str], n: int = SCATTER_SAMPLE) -> DataFrame:
    """Q35: sampled seats and passengers, with the ends of the full-load diagonal, which starts at 0."""
    return scatter_data(active_segments(df), "SEATS", "PASSENGERS", n, keys, start=0.0)


def correlations(df: DataFrame) -> DataFrame:
    """Q36: correlation of the four measures."""
    return corr_matrix(active_segments(df), MEASURES)


def correlations_lower(df: DataFrame) -> DataFrame:
    """Q36: the same, lower triangle."""
    return lower_triangle(correlations(df), MEASURES)


def pair_sample(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q37: sampled rows of the four measures."""
    return pair_data(active_segments(df), MEASURES, n, keys)


def pair_histograms(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q37: the histograms on the diagonal of that pair plot."""
    return pair_marginals(pair_sample(df, keys, n), MEASURES)


def boxes(df: DataFrame) -> DataFrame:
    """Q37: box statistics of the four measures."""
    return box_stats(active_segments(df), None, MEASURES)
