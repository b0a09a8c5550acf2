"""Ordered-series operators (WIN). Every one names its order; rows carry none of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from routestats.operators.scale import GROUP_ROWS, join_sized, over_ordered


def partition_mean(
    df: DataFrame, keys: Sequence[str], col: str, name: str, group_rows: int | None = None
) -> DataFrame:
    """WIN01: mean of the key's rows on every row; missing where a key is missing.

    With ``group_rows``, the counted size of the largest key, at most GROUP_ROWS this is a keyed
    window, which can share its shuffle with WIN02 and WIN03; otherwise a partial aggregate joined
    back, so that a hot key stays split.
    """
    if group_rows is not None and group_rows <= GROUP_ROWS:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        return df.withColumn(name, F.when(known, F.avg(col).over(Window.partitionBy(*keys))))
    means = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(col).alias(name))
    return join_sized(df, means, keys).select(*df.columns, name)


def _known(keys: Sequence[str], c: Column) -> Column:
    for k in keys:
        c = F.when(F.col(k).isNotNull(), c)
    return c


def lag_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    col: str,
    name: str,
    n: int = 1,
    fill: str | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """WIN02: the value n rows earlier within the key; ``fill`` names a column for the gaps."""

    def build(w: WindowSpec) -> dict[str, Column]:
        value = _known(keys, F.lag(col, n).over(w))
        return {name: value if fill is None else F.coalesce(value, F.col(fill))}

    return over_ordered(df, keys, order, n, build, group_rows)


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    col: str,
    name: str,
    n: int,
    min_periods: int | None = None,
    fill: str | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """WIN03, WIN05: mean over the last n rows (rows, not days), skipping missing values.

    Missing unless at least ``min_periods`` (default n) of them have a value.
    """
    needed = n if min_periods is None else min_periods

    def build(w: WindowSpec) -> dict[str, Column]:
        rows = w.rowsBetween(1 - n, 0)
        mean = F.when(F.count(col).over(rows) >= needed, F.avg(col).over(rows))
        value = _known(keys, mean)
        return {name: value if fill is None else F.coalesce(value, F.col(fill))}

    return over_ordered(df, keys, order, n - 1, build, group_rows)


def diff(
    df: DataFrame,
    order: Sequence[str],
    col: str,
    name: str,
    keys: Sequence[str] = (),
    group_rows: int | None = None,
) -> DataFrame:
    """WIN04: change from the row before."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {name: _known(keys, F.col(col) - F.lag(col, 1).over(w))}

    return over_ordered(df, keys, order, 1, build, group_rows)
