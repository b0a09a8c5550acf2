"""Exact quantiles with linear interpolation (AGG08, AGG09), for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import number
from routestats.operators.scale import GROUP_ROWS, group_sizes, join_sized, with_running_total
from routestats.session import materialize

# Values that one task may hold in arrays: some tens of bytes each.
HELD_VALUES = 4_000_000
_GROUPS_HELD = 128  # groups an object aggregate holds before it falls back to sorting

# Brackets offered around each quantile, as shares of the group.
_MARGINS = (0.0002, 0.001, 0.004, 0.016, 0.064)
_ACCURACY = 10_000  # the sketch's rank error is 1/_ACCURACY
_AIM_ROWS = 50_000_000  # rows the sketch sees at least, and one in _AIM_SHARE of more
_AIM_SHARE = 10_000


def quantile_arrays(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    keys: Sequence[str] = (),
    limit: int = HELD_VALUES,
) -> DataFrame:
    """``(keys..., column, qv)``: per key and column, the exact quantiles in the order of ``qs``.

    Missing values are skipped, and so are rows with a missing key; a column without values gets
    NULL. While the values a task can come to hold are counted to be at most ``limit``, a group's
    values are sorted in one array (several times faster than the map ``percentile`` keeps); beyond
    that, :func:`_by_bracket`.
    """
    keys, cols, qs = list(keys), list(cols), [float(q) for q in qs]
    arrays = sorted_arrays(df, cols, keys, limit)
    if arrays is not None:
        return arrays.select(*keys, "column", interpolated(F.col("ordered"), qs).alias("qv"))
    named = _named(df, cols, keys)
    return _by_bracket(named, keys, cols, qs, group_sizes(named, keys)[1], limit)


def _named(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rows = df.dropna(subset=list(keys)) if keys else df
    return rows.select(*keys, *[number(c).alias(c) for c in cols])


def stacked(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    """``(keys..., column, name)``: columns of one type as rows; ``unpivot`` of arrays does not compile."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in cols]
    return df.select(*keys, F.inline(F.array(*cells)))


def sorted_arrays(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), limit: int = HELD_VALUES
) -> DataFrame | None:
    """``(keys..., column, ordered)``: per key and column all values in one ascending array, or None
    where a task could come to hold more than ``limit`` values."""
    named = _named(df, cols, keys)
    largest, total = group_sizes(named, keys)
    if min(total, _GROUPS_HELD * largest) * len(cols) > limit:
        return None
    arrays = named.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in cols])
    return stacked(arrays, keys, cols, "ordered")


def _between(low: Column, high: Column, part: Column) -> Column:
    return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)


def interpolated(ordered: Column, qs: Sequence[float]) -> Column:
    """The quantiles of an ascending array; NULL for an empty one."""
    found = []
    for q in qs:
        place = F.lit(float(q)) * (F.size(ordered) - 1)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        part = place - F.floor(place)
        found.append(_between(F.get(ordered, low), F.get(ordered, high), part))
    return F.when(F.size(ordered) > 0, F.array(*found))


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    qs: Sequence[float],
    keys: Sequence[str] = (),
    limit: int = HELD_VALUES,
) -> DataFrame:
    """``(keys..., column, q, value)``, one row per quantile."""
    arrays = quantile_arrays(df, cols, qs, keys, limit)
    pairs = F.array(
        *[F.struct(F.lit(float(q)).alias("q"), F.col("qv")[i].alias("value")) for i, q in enumerate(qs)]
    )
    return arrays.select(*keys, "column", F.inline(pairs))


def _by_bracket(
    named: DataFrame, keys: list[str], cols: list[str], qs: list[float], total: int, limit: int
) -> DataFrame:
    """Two scans and no shuffle of the data: a rough look narrows each quantile to a thin bracket
    of values, then every row is counted, value by value inside the brackets and in bulk outside.

    The rough look is a sketch of a random part of the rows. It only says where to look closely:
    the exact ranks decide, and a group whose bracket missed its rank is redone with the bracket
    open to the whole group.
    """
    ids = [*keys, "column"]
    long = named.unpivot(keys, cols, "column", "value").where(F.col("value").isNotNull())
    brackets = materialize(_brackets(named, keys, cols, qs, total), "brackets")
    first = materialize(_select_ranks(long, brackets, ids, qs, limit), "quantiles")
    open_probe = F.array(*[F.lit(v) for _ in qs for v in (-math.inf, math.inf)])
    missed = first.where(F.exists("qv", lambda v: v.isNull())).select(*ids)
    found = first
    if not missed.isEmpty():
        again = materialize(missed.withColumn("_probe", open_probe), "missed")
        second = _select_ranks(long.join(again, ids, "left_semi"), again, ids, qs, limit)
        found = first.where(~F.exists("qv", lambda v: v.isNull())).unionByName(second)
    # A column without values in a group keeps its row, without quantiles.
    groups = named.select(*keys).distinct() if keys else named.sparkSession.range(1)
    every = groups.select(*keys, F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return every.join(found, ids, "left")


def _brackets(named: DataFrame, keys: list[str], cols: list[str], qs: list[float], total: int) -> DataFrame:
    """``(keys..., column, _probe)``: lower and upper bracket value per quantile.

    The bracket is as wide as the sketch's error, plus four standard errors of the rank if only a
    part of the rows is looked at; open where that part has too few rows of a group.
    """
    aim = max(_AIM_ROWS, total // _AIM_SHARE)
    whole = total <= aim
    seen = named if whole else named.sample(aim / total, seed=1)
    probes = [min(1.0, max(0.0, q + side * m)) for q in qs for m in _MARGINS for side in (-1, 1)]
    cells = [
        F.struct(F.count(c).alias("m"), F.percentile_approx(c, probes, _ACCURACY).alias("at")).alias(c) for c in cols
    ]
    looks = stacked(seen.groupBy(*keys).agg(*cells), keys, cols, "_look")
    rows = F.col("_look.m").cast("double")

    def side(i: int, q: float, upper: int) -> Column:
        error = F.lit(2 / _ACCURACY)
        if not whole:
            error = error + 4 * F.sqrt(F.lit(q * (1 - q)) / rows) + 2 / rows
        out = F.lit(math.inf if upper else -math.inf)
        for level in reversed(range(len(_MARGINS))):
            value = F.col("_look.at")[2 * (i * len(_MARGINS) + level) + upper]
            out = F.when(error <= _MARGINS[level], value).otherwise(out)
        return out

    bounds = [side(i, q, upper) for i, q in enumerate(qs) for upper in (0, 1)]
    return looks.where(rows > 0).select(*keys, "column", F.array(*bounds).alias("_probe"))


def _select_ranks(
    long: DataFrame, brackets: DataFrame, ids: list[str], qs: list[float], limit: int
) -> DataFrame:
    value, probe = F.col("value"), F.col("_probe")
    inside = probe.isNull()  # a group the sample left out is counted whole
    for i in range(len(qs)):
        inside = inside | value.between(probe[2 * i], probe[2 * i + 1])
    # A row outside every bracket only has to be counted: it stands at the last probe below it.
    below = [F.when(probe[i] < value, probe[i]) for i in range(2 * len(qs))]
    near = join_sized(long, brackets, ids, "left", stored=True)
    cells = near.select(
        *ids,
        F.when(inside, value).otherwise(F.coalesce(F.greatest(*below), F.lit(-math.inf))).alias("_slot"),
        F.when(inside, F.lit(0)).otherwise(F.lit(1)).alias("_gap"),
    )
    cells = cells.groupBy(*ids, "_slot", "_gap").agg(F.count(F.lit(1)).alias("_cnt"))
    cells = materialize(cells, "cells")
    ranked = with_running_total(cells, ids, ["_slot", "_gap"], "_cnt", "_upto", min(limit, GROUP_ROWS))
    sizes = cells.groupBy(*ids).agg(F.sum("_cnt").alias("_n"))
    ranked = join_sized(ranked, sizes, ids, "inner")

    def at(rank: Column) -> Column:
        holds = (F.col("_upto") - F.col("_cnt") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(holds & (F.col("_gap") == 0), F.col("_slot")))

    parts = []
    for i, q in enumerate(qs):
        place = F.lit(q) * (F.col("_n") - 1)
        parts += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_t{i}"),
        ]
    found = ranked.groupBy(*ids).agg(*parts)
    lerp = [_between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_t{i}")) for i in range(len(qs))]
    return found.select(*ids, F.array(*lerp).alias("qv"))
