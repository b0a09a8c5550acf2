"""Q19-Q29: flight delays, cancellations and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import day_name, hhmm_hour, route_key
from routestats.operators.aggregate import group_mean, group_size, scalar_stats, value_counts
from routestats.operators.distribution import box_stats, histogram, kde
from routestats.operators.filters import filter_between
from routestats.operators.joins import conform, semi_top_k, with_global
from routestats.operators.profile import describe_exact
from routestats.operators.topk import order_by_value, top_k
from routestats.plans.schemas import DAY_ORDER

# Minutes shown in the delay histogram, and its bins.
DELAY_LO, DELAY_HI, DELAY_BINS = -60, 300, 80


def _flown(df: DataFrame) -> DataFrame:
    return df.where(F.col("Cancelled") == 0)


def delay_histogram(df: DataFrame) -> DataFrame:
    """Q19: delays of flown flights between -60 and 300 minutes."""
    shown = filter_between(_flown(df).dropna(subset=["Delay"]), "Delay", DELAY_LO, DELAY_HI)
    return histogram(shown, "Delay", DELAY_BINS)


def delay_mean(df: DataFrame) -> DataFrame:
    """Q19: mean delay of flown flights, over all minutes."""
    return scalar_stats(_flown(df), {"mean_delay": F.avg("Delay")})


def delay_describe(df: DataFrame) -> DataFrame:
    """Q19: the delay profile of flown flights."""
    return describe_exact(_flown(df), ["Delay"])


def top_airlines(df: DataFrame, k: int = 15) -> DataFrame:
    """Q20: airlines with the most flights."""
    return top_k(value_counts(df, "Airline Name"), k, "n", ["Airline Name"])


def mean_delay_by_airline(df: DataFrame, k: int = 15) -> DataFrame:
    """Q21: mean delay per airline name, among the k most frequent carrier codes."""
    means = group_mean(semi_top_k(df, "Carrier", k), ["Airline Name"], "Delay", "mean_delay")
    return order_by_value(means, "mean_delay", ["Airline Name"])


def cancellation_rate_by_airline(df: DataFrame, k: int = 15) -> DataFrame:
    """Q22: cancelled percentage per airline name, same airlines."""
    rates = group_mean(semi_top_k(df, "Carrier", k), ["Airline Name"], "Cancelled", "cancel_rate", 100.0)
    return order_by_value(rates, "cancel_rate", ["Airline Name"])


def daily_volume(df: DataFrame) -> DataFrame:
    """Q23: flights per day, and the mean over days."""
    return with_global(group_size(df, ["Date"]), {"mean_n": F.avg("n")}).orderBy("Date")


def top_routes(df: DataFrame, k: int = 15) -> DataFrame:
    """Q24: busiest routes."""
    routes = df.withColumn("Route", route_key("Origin", "Dest", " to "))
    return top_k(value_counts(routes, "Route"), k, "n", ["Route"])


def mean_delay_by_weekday(df: DataFrame) -> DataFrame:
    """Q25: mean delay for each of the seven weekdays, in order."""
    means = group_mean(df.withColumn("DayOfWeek", day_name("Date")), ["DayOfWeek"], "Delay", "mean_delay")
    return conform(means, "DayOfWeek", DAY_ORDER)


def mean_delay_by_hour(df: DataFrame) -> DataFrame:
    """Q26: mean delay per departure hour."""
    hours = df.withColumn("DepHour", hhmm_hour("Dep_Time"))
    return group_mean(hours, ["DepHour"], "Delay", "mean_delay").orderBy("DepHour")


def boxes_by_airline(df: DataFrame, k: int = 8) -> DataFrame:
    """Q27: delay boxes for airlines of the k most frequent codes; codes are ranked on all flights."""
    return box_stats(_flown(semi_top_k(df, "Carrier", k)), "Airline Name", ["Delay"])


def _by_weekday(df: DataFrame) -> DataFrame:
    return _flown(df).withColumn("DayOfWeek", day_name("Date"))


def boxes_by_weekday(df: DataFrame) -> DataFrame:
    """Q28: delay boxes per weekday, in order."""
    return conform(box_stats(_by_weekday(df), "DayOfWeek", ["Delay"]), "DayOfWeek", DAY_ORDER)


def density_by_weekday(df: DataFrame, grid: int = 100) -> DataFrame:
    """Q28: delay density per weekday."""
    return kde(_by_weekday(df), "DayOfWeek", "Delay", grid)


def top_origins(df: DataFrame, k: int = 15) -> DataFrame:
    """Q29: origins with the most flights."""
    return top_k(value_counts(df, "Origin"), k, "n", ["Origin"])


def cancellation_rate(df: DataFrame) -> DataFrame:
    """Q52: cancelled percentage, rounded for the report."""
    return scalar_stats(df, {"cancellation_rate": F.bround(F.avg("Cancelled") * 100, 2)})
