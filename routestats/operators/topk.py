"""Ordering, top-k and sampling (SRT, TOP, LIM, SMP)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import HASH_DIGITS, key_hash


def order_by_value(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """SRT02: ascending by value; the keys break ties."""
    return df.orderBy(F.col(value).asc_nulls_last(), *keys)


def top_k(df: DataFrame, k: int, by: str, keys: Sequence[str]) -> DataFrame:
    """TOP01, TOP02: the k largest; the keys break ties. Each task keeps k rows only."""
    return df.orderBy(F.col(by).desc_nulls_last(), *keys).limit(k)


def top_k_then_sort(df: DataFrame, k: int, by: str, then: str, keys: Sequence[str]) -> DataFrame:
    """TOP03: the k largest by one measure, shown in the order of another."""
    return order_by_value(top_k(df, k, by, keys), then, keys)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """LIM01: the first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """SMP01: exactly ``min(n, rows)`` rows, uniform without replacement, fixed by key and seed.

    The rows with the n smallest key hashes are the sample, so it does not depend on how the data
    is partitioned. One counting pass finds the lowest power-of-two hash bound that still has n
    rows below it; only those rows are sorted, not n rows from every task.
    """
    top = 1 << (4 * HASH_DIGITS)
    hashed = df.withColumn("_hash", key_hash(keys, seed))
    bounds = [top >> shift for shift in range(4 * HASH_DIGITS)]
    counts = hashed.agg(*[F.count_if(F.col("_hash") < b) for b in bounds]).first()
    bound = min((b for b, c in zip(bounds, counts) if c >= n), default=top)
    return hashed.where(F.col("_hash") < bound).orderBy("_hash", *keys).limit(n).drop("_hash")
