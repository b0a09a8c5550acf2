"""Q47-Q51: the daily fuel price.

A price series should have one row per day, but nothing here relies on it: a longer one is worked on in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import iso_week, iso_year, sign_class
from routestats.operators.aggregate import count_where, group_mean
from routestats.operators.clean import fill_const
from routestats.operators.distribution import histogram, series_data
from routestats.operators.profile import describe_exact
from routestats.operators.windows import diff, rolling_mean

BINS, WINDOW = 20, 7


def price_frame(df: DataFrame) -> DataFrame:
    """PRJ02: the short column name the fuel analyses use."""
    return df.withColumnRenamed("DJFUELUSGULF", "price")


def price_series(df: DataFrame) -> DataFrame:
    """Q47: prices in time order, without gaps, and their mean."""
    return series_data(df, "observation_date", "price")


def price_histogram(df: DataFrame) -> DataFrame:
    """Q48: price bins."""
    return histogram(df, "price", BINS)


def with_change(df: DataFrame) -> DataFrame:
    """Q49: change from the day before; missing next to a missing price."""
    return diff(df, ["observation_date"], "price", "price_change")


def change_bars(df: DataFrame) -> DataFrame:
    """Q49: changes with gaps as 0, and their sign class."""
    bars = with_change(df).select("observation_date", "price_change", sign_class("price_change").alias("sign"))
    return fill_const(bars, {"price_change": 0.0}).orderBy("observation_date")


def change_counts(df: DataFrame) -> DataFrame:
    """Q49: days up, down and unchanged."""
    change = F.col("price_change")
    return count_where(with_change(df), {"up": change > 0, "down": change < 0, "unchanged": change == 0})


def change_describe(df: DataFrame) -> DataFrame:
    """Q49: profile of the changes."""
    return describe_exact(with_change(df), ["price_change"])


def rolling(df: DataFrame) -> DataFrame:
    """Q50: mean of the last seven rows, where all seven have a price."""
    out = rolling_mean(df, [], ["observation_date"], "price", "rolling_7d", WINDOW)
    return out.select("observation_date", "price", "rolling_7d").orderBy("observation_date")


def weekly_mean(df: DataFrame, by_year: bool = False) -> DataFrame:
    """Q51: mean price per ISO week; ``by_year`` keeps the weeks of different years apart."""
    weeks = df.withColumns({"iso_year": iso_year("observation_date"), "week": iso_week("observation_date")})
    keys = ["iso_year", "week"] if by_year else ["week"]
    return group_mean(weeks, keys, "price", "mean_price").orderBy(*keys)
