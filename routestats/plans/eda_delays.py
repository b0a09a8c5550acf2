"""Q10-Q18: delay causes by carrier, airport and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import label, sum0
from routestats.operators.aggregate import group_rate, group_sum, unpivot_totals, with_share
from routestats.operators.distribution import box_stats, corr_matrix, lower_triangle, pair_data, pair_marginals
from routestats.operators.joins import semi_top_k
from routestats.operators.topk import order_by_value, top_k

# Measures and labels of the charts.
CAUSES = {
    "carrier_delay": "Carrier",
    "weather_delay": "Weather",
    "nas_delay": "NAS",
    "security_delay": "Security",
    "late_aircraft_delay": "Late Aircraft",
}
CORRELATED = ["arr_flights", "arr_del15", "arr_delay", *CAUSES]
PAIRED = [
    "arr_flights", "arr_del15", "arr_delay", "carrier_delay", "weather_delay", "nas_delay", "late_aircraft_delay",
]
BOXED = [*CAUSES, "arr_delay"]
PAIR_SAMPLE = 3000


def cause_totals(df: DataFrame) -> DataFrame:
    """Q10: delay minutes per cause and their shares."""
    return with_share(unpivot_totals(df, CAUSES, "cause", "total_minutes"), "total_minutes")


def rate_by_carrier(df: DataFrame) -> DataFrame:
    """Q11: percentage of delayed flights per carrier, lowest first."""
    rates = group_rate(df, ["carrier_name"], "arr_del15", "arr_flights", "total_delayed", "total_flights", "delay_rate")
    return order_by_value(rates, "delay_rate", ["carrier_name"])


def airports_by_delay(df: DataFrame, k: int = 15) -> DataFrame:
    """Q12: airports with the most delay minutes."""
    return top_k(group_sum(df, ["airport_name"], "arr_delay", "arr_delay"), k, "arr_delay", ["airport_name"])


def carriers_by_cancellations(df: DataFrame, k: int = 15) -> DataFrame:
    """Q13: carriers with the most cancellations."""
    return top_k(group_sum(df, ["carrier_name"], "arr_cancelled", "arr_cancelled"), k, "arr_cancelled", ["carrier_name"])


def rate_by_month(df: DataFrame) -> DataFrame:
    """Q14: percentage of delayed flights per month, labelled."""
    rates = group_rate(df, ["month"], "arr_del15", "arr_flights", "total_delayed", "total_flights", "delay_rate")
    return rates.withColumn("month_label", label("Month", "month")).orderBy("month")


def correlations(df: DataFrame) -> DataFrame:
    """Q15: correlation of the delay measures."""
    return corr_matrix(df, CORRELATED)


def correlations_lower(df: DataFrame) -> DataFrame:
    """Q15: the same, lower triangle."""
    return lower_triangle(correlations(df), CORRELATED)


def pair_sample(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q16: sampled complete rows of seven measures."""
    return pair_data(df.dropna(subset=PAIRED), PAIRED, n, keys)


def pair_histograms(df: DataFrame, keys: Sequence[str], n: int = PAIR_SAMPLE) -> DataFrame:
    """Q16: the histograms on the diagonal of that pair plot."""
    return pair_marginals(pair_sample(df, keys, n), PAIRED)


def boxes_by_carrier(df: DataFrame, k: int = 6) -> DataFrame:
    """Q17: box statistics of six measures for the carriers with the most flights."""
    return box_stats(semi_top_k(df, "carrier_name", k, sum0("arr_flights")), "carrier_name", BOXED)


def airports_by_diversions(df: DataFrame, k: int = 10) -> DataFrame:
    """Q18: airports with the most diversions."""
    return top_k(group_sum(df, ["airport_name"], "arr_diverted", "arr_diverted"), k, "arr_diverted", ["airport_name"])


def months_covered(df: DataFrame) -> DataFrame:
    """Q52: the months present, in order."""
    return df.select(F.col("month")).distinct().orderBy("month")
