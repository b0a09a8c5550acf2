"""Grouped and global aggregation (AGG).

Every aggregate here has a partial form, so a hot key shrinks to one row per task before the
shuffle. Rows with a missing key are dropped, as the dataframe libraries do (N3).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import nan_to_null, pct, safe_divide, sum0


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """AGG20: named aggregates per key."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def aggregate_fares(df: DataFrame, keys: Sequence[str], fare: str, passengers: str, distance: str) -> DataFrame:
    """AGG01: mean fare and distance over rows (not passenger-weighted), and total passengers."""
    return group_agg(
        df,
        keys,
        {"avg_fare": F.avg(fare), "passengers_db1b": sum0(passengers), "market_distance": F.avg(distance)},
    )


def aggregate_capacity(df: DataFrame, keys: Sequence[str], passengers: str, seats: str, departures: str) -> DataFrame:
    """AGG02: three totals per key."""
    return group_agg(
        df,
        keys,
        {"passengers_t100": sum0(passengers), "seats": sum0(seats), "departures_performed": sum0(departures)},
    )


def with_year_quarter(df: DataFrame, ts: str, year: str = "YEAR", quarter: str = "QUARTER") -> DataFrame:
    """SCA05: calendar year and quarter of a date."""
    return df.withColumns({year: F.year(ts), quarter: F.quarter(ts)})


def rollup_calendar(df: DataFrame, ts: str, aggs: Mapping[str, Column], year: str = "YEAR", quarter: str = "QUARTER") -> DataFrame:
    """AGG03: daily rows to one row per calendar quarter."""
    return group_agg(with_year_quarter(df, ts, year, quarter), [year, quarter], aggs)


def group_rate(
    df: DataFrame, keys: Sequence[str], num: str, den: str, num_name: str, den_name: str, rate: str
) -> DataFrame:
    """AGG04, FLT12: ratio of sums in percent, for keys whose denominator is positive."""
    sums = group_agg(df, keys, {den_name: sum0(den), num_name: sum0(num)})
    return sums.where(F.col(den_name) > 0).withColumn(rate, pct(num_name, den_name))


def group_mean(df: DataFrame, keys: Sequence[str], col: str, name: str, scale: float = 1.0) -> DataFrame:
    """AGG05; with ``scale=100`` on a 0/1 flag, AGG06."""
    mean = F.avg(col)
    return group_agg(df, keys, {name: mean if scale == 1.0 else mean * F.lit(scale)})


def group_sum(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """AGG07: sum per key; an all-missing group is 0."""
    return group_agg(df, keys, {name: sum0(col)})


def value_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """AGG10: rows per non-missing value."""
    return group_agg(df, [key], {name: F.count(F.lit(1))})


def group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """AGG11: rows per key."""
    return group_agg(df, keys, {name: F.count(F.lit(1))})


def mean_of_group_counts(df: DataFrame, keys: Sequence[str], name: str = "mean_n") -> DataFrame:
    """AGG12: mean over the keys of their row counts."""
    return group_size(df, keys).agg(F.avg("n").alias(name))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """AGG13: distinct non-missing values per column, NaN left out, one row per column.

    Exact counts de-duplicate ``(column, value)`` before the shuffle, then count per column in two
    steps, so no task holds a column's whole value set. ``approx`` opts in to a sketch.
    """
    kinds = dict(df.dtypes)
    # Zero is one value whatever its sign, which its text form would tell apart.
    known = {c: nan_to_null(F.col(c)) + 0.0 if kinds[c] in ("double", "float") else F.col(c) for c in cols}
    if approx:
        sketches = df.agg(*[F.approx_count_distinct(known[c]).alias(c) for c in cols])
        return sketches.unpivot([], list(cols), "column", "n")
    texts = df.select(*[known[c].cast("string").alias(c) for c in cols])
    pairs = texts.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)))
    return pairs.groupBy("column").agg(F.count("value").alias("n"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """AGG14: the distinct values in order."""
    return df.select(col).distinct().orderBy(col)


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG15: smallest and largest value over one or more columns."""
    lows, highs = [F.min(c) for c in cols], [F.max(c) for c in cols]
    if len(lows) == 1:
        return df.agg(lows[0].alias("lo"), highs[0].alias("hi"))
    return df.agg(F.least(*lows).alias("lo"), F.greatest(*highs).alias("hi"))


def count_where(df: DataFrame, preds: Mapping[str, Column]) -> DataFrame:
    """AGG16: how many rows satisfy each condition, in one pass."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in preds.items()])


def unpivot_totals(df: DataFrame, labels: Mapping[str, str], key: str = "label", value: str = "total") -> DataFrame:
    """AGG17, PRJ03: column totals as rows, under display labels."""
    totals = df.agg(*[sum0(c).alias(name) for c, name in labels.items()])
    return totals.unpivot([], list(labels.values()), key, value)


def with_share(df: DataFrame, value: str, name: str = "share_pct") -> DataFrame:
    """AGG18: each row's percentage of the column total."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, safe_divide(F.col(value), total) * F.lit(100.0))


def scalar_stats(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """AGG21: one row of named global statistics."""
    return df.agg(*[c.alias(n) for n, c in stats.items()])
