"""Q52: the profile of each dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats.operators.aggregate import distinct_counts, value_range
from routestats.operators.profile import column_types, describe_exact, missing_counts, shape

# The columns whose distinct values each profile counts, and whose range it shows.
DISTINCT = {
    "delays": ["carrier", "airport"],
    "competition": ["Carrier", "Origin", "Dest"],
    "t100": ["ORIGIN", "DEST"],
    "db1b": ["ORIGIN", "DEST"],
    "fuel": [],
}
RANGED = {"delays": None, "competition": "Date", "t100": None, "db1b": "MARKET_FARE", "fuel": "observation_date"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, name: str, *parts: str) -> dict[str, object]:
    """Shape, types, missing counts, numeric summary, distinct counts and range of one dataset, or
    only the named parts of it."""
    build = {
        "shape": lambda: shape(df),
        "types": lambda: column_types(df),
        "missing": lambda: missing_counts(df),
        "describe": lambda: describe_exact(df, numeric_columns(df)),
    }
    if DISTINCT[name]:
        build["distinct"] = lambda: distinct_counts(df, DISTINCT[name])
    if RANGED[name]:
        build["range"] = lambda: value_range(df, [RANGED[name]])
    return {part: build[part]() for part in parts or build}


def volatility(df: DataFrame, col: str = "price") -> DataFrame:
    """AGG19: sample standard deviation, rounded for the report."""
    return df.agg(F.bround(F.stddev_samp(col), 4).alias("std"))
