"""Row filters (FLT). Plain comparisons stay plain ``where`` calls, so they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.operators.quantiles import quantiles
from routestats.operators.scale import join_sized
from routestats.session import materialize


def filter_between(df: DataFrame, col: str, lo: Any, hi: Any) -> DataFrame:
    """FLT01, FLT09: closed range. Bounds take the column's own type, so the scan can use them;
    on a timestamp, a bound without a clock time means midnight."""
    kind = df.schema[col].dataType
    return df.where(F.col(col).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def filter_eq(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """FLT02: all the equalities hold."""
    return df.where(reduce(and_, [F.col(c) == F.lit(v) for c, v in wanted.items()]))


def filter_in(df: DataFrame, col: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """FLT03, FLT04: membership in literals, or in the first column of a table of any size."""
    if isinstance(values, DataFrame):
        members = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return join_sized(df, members, [col], "left_semi")
    return df.where(F.col(col).isin(list(values)))


def filter_any_in(df: DataFrame, cols: Sequence[str], values: Sequence[Any]) -> DataFrame:
    """FLT05: at least one of the columns is a member; one pass, no join."""
    return df.where(reduce(or_, [F.col(c).isin(list(values)) for c in cols]))


def active_or_all(df: DataFrame, active: Column, fill: Mapping[str, Any]) -> DataFrame:
    """FLT08: the active rows, or, when there are none, all rows with ``fill`` values set.

    Which of the two is asked once, up to the first active row, so that the result is a plain plan:
    the filter reaches the scan.
    """
    some = df.where(active)
    if not some.isEmpty():
        return some
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in fill.items()})


def clip_below_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """FLT10: rows strictly below the exact quantile."""
    # Stored, so that later passes over the result do not compute it again.
    bound = materialize(quantiles(df, [col], [q]).select("value"), "bound").scalar()
    return df.where(F.col(col) < bound)
