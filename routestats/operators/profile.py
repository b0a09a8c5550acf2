"""Table profiles (PRF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import number
from routestats.operators.quantiles import quantile_arrays


def shape(df: DataFrame) -> DataFrame:
    """PRF01: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    """PRF01: column names and types; runs no job."""
    return df.dtypes


def missing_counts(df: DataFrame) -> DataFrame:
    """PRF02: missing values per column, NaN among them, in one pass."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    gone = {c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if c in floats else F.lit(False)) for c in df.columns}
    counts = df.agg(*[F.count_if(gone[c]).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing")


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRF03: count, mean, std, min, quartiles and max per numeric column, all exact."""
    numbers = df.select(*[number(c).alias(c) for c in cols])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
        for c in cols
    ]
    moments = numbers.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    quartiles = quantile_arrays(numbers, cols, [0.25, 0.5, 0.75])  # one row per column
    qv = F.col("qv")
    return moments.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min",
        qv[0].alias("q25"), qv[1].alias("q50"), qv[2].alias("q75"), "max",
    )
