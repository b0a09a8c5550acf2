"""Coercion, filling and column bookkeeping (CLN, PRJ)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats.functions.scalars import number, text_to_double
from routestats.operators.quantiles import quantiles


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN01: double, with NULL for whatever is not a number."""

    def as_number(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            return text_to_double(c)
        return number(c)

    return df.withColumns({c: as_number(c) for c in cols})


def parse_timestamp(df: DataFrame, col: str, fmt: str | None = None, kind: str = "timestamp_ntz") -> DataFrame:
    """CLN02: strict; an unreadable value fails the job."""
    c = F.col(col)
    if fmt and isinstance(df.schema[col].dataType, T.StringType):
        c = F.to_timestamp(c, fmt)
    return df.withColumn(col, c.cast(kind))


def cast_int_strict(df: DataFrame, col: str) -> DataFrame:
    """CLN03: integer; a missing value fails the job."""
    missing = F.raise_error(F.lit(f"cannot convert a missing {col} to int")).cast("int")
    return df.withColumn(
        col, F.when(F.col(col).isNull(), missing).otherwise(F.col(col).cast("double").cast("int"))
    )


def fill_from(df: DataFrame, col: str, other: str) -> DataFrame:
    """CLN05: missing values come from another column."""
    return df.withColumn(col, F.coalesce(F.col(col), F.col(other)))


def fill_const(df: DataFrame, values: Mapping[str, Any], kind: str | None = None) -> DataFrame:
    """CLN07, CLN09: missing values become a constant; ``kind`` casts the result."""

    def filled(c: str, v: Any) -> Column:
        out = F.coalesce(F.col(c), F.lit(v))
        return out.cast(kind) if kind else out

    return df.withColumns({c: filled(c, v) for c, v in values.items()})


def impute_median(
    df: DataFrame, cols: Sequence[str], default: float = 0.0, fit_on: DataFrame | None = None
) -> DataFrame:
    """CLN06: missing values become the column's median, or ``default`` when it has none.

    Absent columns are skipped. All medians come from one pass; ``fit_on`` takes them from
    another table, such as the training rows.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    medians = quantiles(df if fit_on is None else fit_on, present, [0.5])
    row = medians.agg(
        F.struct(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in present])
    ).scalar()
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), row.getField(c), F.lit(default)) for c in present}
    )


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ04: raise with the names of the missing columns; runs no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def ensure_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """PRJ05: derive the column only if it is absent."""
    return df if name in df.columns else df.withColumn(name, expr)
