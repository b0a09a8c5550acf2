"""Joins (JOIN) and unions (SET)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.operators.aggregate import rollup_calendar
from routestats.operators.scale import join_sized
from routestats.operators.topk import top_k
from routestats.session import materialize


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """JOIN01: equi-join. Inputs aggregated on ``keys`` are already partitioned on them, so the
    join adds no exchange, and one row per key leaves nothing to skew."""
    return left.join(right, list(keys), how)


def join_calendar(
    left: DataFrame, daily: DataFrame, ts: str, aggs: Mapping[str, Column], year: str = "YEAR", quarter: str = "QUARTER"
) -> DataFrame:
    """JOIN02: roll a dated table up to quarters and attach the result by year and quarter.

    The rollup has at most four rows per calendar year, however long the daily table is; that is
    the bound the broadcast rests on.
    """
    return left.join(F.broadcast(rollup_calendar(daily, ts, aggs, year, quarter)), [year, quarter], "left")


def semi_top_k(df: DataFrame, key: str, k: int, by: Column | None = None) -> DataFrame:
    """JOIN03: the rows whose key is among the k largest by ``by`` (row count by default).

    The k keys are stored, so that several passes over the result rank them only once; they are
    broadcast if they are few.
    """
    value = F.count(F.lit(1)) if by is None else by
    ranked = df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias("_by"))
    top = materialize(top_k(ranked, k, "_by", [key]).select(key), "top-keys")
    return join_sized(df, top, [key], "left_semi", stored=True).select(*df.columns)


def lookup(df: DataFrame, key: str, dim: DataFrame | Mapping[Any, Any], name: str, default: Any) -> DataFrame:
    """JOIN04, CLN08: label rows from a dimension, ``default`` where it has no entry.

    A mapping is a literal in the program and thereby small. A table is ``(key, label)``, and is
    broadcast only if counted small. A key that it has twice gets the largest of its labels, so rows
    are never multiplied; missing keys and labels are no entries.
    """
    if isinstance(dim, Mapping):
        rows = [(k, v) for k, v in dim.items()]
        labels = df.sparkSession.createDataFrame(rows, [key, name])
        joined = df.join(F.broadcast(labels), key, "left")
    else:
        one = dim.toDF(key, "_label").dropna().groupBy(key).agg(F.max("_label").alias(name))
        joined = join_sized(df, one, [key])
    return joined.select(*df.columns, F.coalesce(F.col(name), F.lit(default)).alias(name))


def conform(df: DataFrame, key: str, domain: Sequence[Any]) -> DataFrame:
    """JOIN05: one row per value of the ordered domain, missing where ``df`` has none."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    positions = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position int, {key} {kind}")
    others = [c for c in df.columns if c != key]
    return positions.join(df, key, "left").select("position", key, *others).orderBy("position")


def with_global(df: DataFrame, stats: Mapping[str, Column], of: DataFrame | None = None) -> DataFrame:
    """JOIN06: attach one-row statistics to every row, as a scalar subquery."""
    row = (df if of is None else of).agg(F.struct(*[c.alias(n) for n, c in stats.items()])).scalar()
    return df.select("*", *[row.getField(n).alias(n) for n in stats])


def union_all(*dfs: DataFrame) -> DataFrame:
    """SET01: bag union by column name; a column absent from one input is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
