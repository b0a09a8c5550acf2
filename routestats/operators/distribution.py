"""Correlations and the tables behind charts: bins, boxes, densities, samples (ST)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routestats.functions.scalars import number
from routestats.operators.joins import with_global
from routestats.operators.quantiles import interpolated, quantile_arrays, sorted_arrays
from routestats.operators.scale import join_sized
from routestats.operators.topk import sample_n
from routestats.session import materialize


_MOMENTS = ["n", "mx", "my", "sxx", "syy", "sxy", "xlo", "xhi", "ylo", "yhi"]
_MERGE_GROUPS = 64  # tasks' tables are merged in so many groups first


def _no_moments() -> Column:
    """The moments of no rows."""
    none = {"xlo": math.inf, "ylo": math.inf, "xhi": -math.inf, "yhi": -math.inf}
    return F.struct(*[F.lit(none.get(name, 0.0)).alias(name) for name in _MOMENTS])


def _merged_moments(parts: Column) -> Column:
    """Centred moments of all parts together: means move by their shares, squares by the means' distance."""

    def add(one: Column, two: Column) -> Column:
        n = one["n"] + two["n"]
        share = F.when(n > 0, two["n"] / n).otherwise(F.lit(0.0))
        dx, dy, apart = two["mx"] - one["mx"], two["my"] - one["my"], one["n"] * share
        return F.struct(
            n.alias("n"), (one["mx"] + dx * share).alias("mx"), (one["my"] + dy * share).alias("my"),
            (one["sxx"] + two["sxx"] + dx * dx * apart).alias("sxx"), (one["syy"] + two["syy"] + dy * dy * apart).alias("syy"),
            (one["sxy"] + two["sxy"] + dx * dy * apart).alias("sxy"),
            *[F.least(one[c], two[c]).alias(c) if c.endswith("lo") else F.greatest(one[c], two[c]).alias(c) for c in _MOMENTS[6:]],
        )

    return F.aggregate(parts, _no_moments(), add)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ST01: Pearson correlation of every pair over its complete rows, as ``(x, y, corr)``.

    NULL where a column is constant over the pair's rows, where ``corr`` would fail on a division
    by zero, and where a value is infinite. Every Arrow batch gives each pair's count, means and
    centred sums of squares and products, over the rows where both are known; they merge within the
    task and then from task to task, and only these d(d+1)/2 rows per task are shuffled. As
    3 * d(d+1)/2 JVM aggregates the same was nine times slower at eight columns.
    """
    cols = list(cols)
    numbers = df.select(*[number(c).alias(c) for c in cols])

    def moments(batches):  # nested, so that it reaches the workers by value
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        d = len(cols)
        left, right = np.triu_indices(d)

        def of(x):
            """(moment, pair) of the rows of one batch."""
            known = ~np.isnan(x)
            whole = known.all(axis=0)
            out = np.zeros((len(_MOMENTS), len(left)))
            some = known.any(axis=0)
            mean = np.divide(np.where(known, x, 0.0).sum(axis=0), known.sum(axis=0), where=some, out=np.zeros(d))
            z = np.where(known, x - mean, 0.0)
            products = z.T @ z
            low = np.where(known, x, np.inf).min(axis=0, initial=np.inf)
            high = np.where(known, x, -np.inf).max(axis=0, initial=-np.inf)
            for at, (i, j) in enumerate(zip(left, right)):
                if i == j or (whole[i] and whole[j]):  # the pair's rows are the columns'
                    rest = z[:, i].sum() / max(known[:, i].sum(), 1), z[:, j].sum() / max(known[:, j].sum(), 1)
                    n = known[:, i].sum()
                    out[:6, at] = (
                        n, mean[i] + rest[0], mean[j] + rest[1], products[i, i] - n * rest[0] ** 2,
                        products[j, j] - n * rest[1] ** 2, products[i, j] - n * rest[0] * rest[1],
                    )
                    out[6:, at] = low[i], high[i], low[j], high[j]
                    continue
                both = known[:, i] & known[:, j]
                a, b = x[both, i], x[both, j]
                if not len(a):
                    out[6:, at] = np.inf, -np.inf, np.inf, -np.inf
                    continue
                ma, mb = a.mean(), b.mean()
                out[:6, at] = len(a), ma, mb, ((a - ma) ** 2).sum(), ((b - mb) ** 2).sum(), ((a - ma) * (b - mb)).sum()
                out[6:, at] = a.min(), a.max(), b.min(), b.max()
            return out

        def add(one, two):
            n = one[0] + two[0]
            share = np.divide(two[0], n, where=n > 0, out=np.zeros(len(n)))
            dx, dy, apart = two[1] - one[1], two[2] - one[2], one[0] * share
            lows, highs = np.minimum(one[6::2], two[6::2]), np.maximum(one[7::2], two[7::2])
            sums = one[3:6] + two[3:6] + np.stack([dx * dx, dy * dy, dx * dy]) * apart
            return np.stack([n, one[1] + dx * share, one[2] + dy * share, *sums, lows[0], highs[0], lows[1], highs[1]])

        total = None
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    part = of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                    total = part if total is None else add(total, part)
        if total is not None:
            task = np.full(len(left), TaskContext.get().partitionId())
            columns = [task, left, right, *total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["task", "i", "j", *_MOMENTS])

    schema = "task long, i long, j long, " + ", ".join(f"{name} double" for name in _MOMENTS)
    parts = numbers.mapInArrow(moments, schema).withColumn("group", F.col("task") % _MERGE_GROUPS)
    for keys, order in ((["i", "j", "group"], "task"), (["i", "j"], "group")):  # parts in one order: the same bits each time
        cells = F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*_MOMENTS).alias("of")))), lambda p: p["of"])
        parts = parts.groupBy(*keys).agg(_merged_moments(cells).alias("of")).select(*keys, "of.*")
    varies = (F.col("xlo") < F.col("xhi")) & (F.col("ylo") < F.col("yhi"))
    ratio = F.when(varies, F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")))
    table = parts.select("i", "j", F.when(~F.isnan(ratio), ratio).alias("ratio"))
    pairs = [(min(i, j), max(i, j), x, y) for i, x in enumerate(cols) for j, y in enumerate(cols)]
    cells = df.sparkSession.createDataFrame(pairs, "i long, j long, x string, y string")
    return cells.join(F.broadcast(table), ["i", "j"], "left").select(
        "x", "y", F.when(F.col("ratio").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "ratio"))).alias("corr")
    )


def lower_triangle(corr: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ST02: the cells on and below the diagonal."""
    order = F.array(*[F.lit(c) for c in cols])
    return corr.where(F.array_position(order, F.col("x")) >= F.array_position(order, F.col("y")))


def histogram(
    df: DataFrame,
    col: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """ST03: equal-width bins over [lo, hi], by default the value range (of each key).

    Bins are closed on the left, the last on both sides; empty bins are listed with 0. A single
    distinct value v is spread over [v - 0.5, v + 0.5]. Missing values are not counted. A range with
    an infinite end has no bins of equal width and fails the job.
    """
    keys = list(keys)
    rows = df.select(*keys, number(col).alias("_v")).dropna()
    low = F.min("_v" if lo is None else F.lit(float(lo)))
    high = F.max("_v" if hi is None else F.lit(float(hi)))
    edges = rows.groupBy(*keys).agg(F.coalesce(low, F.lit(0.0)).alias("_a"), F.coalesce(high, F.lit(1.0)).alias("_b"))
    endless = (F.abs("_a") == math.inf) | (F.abs("_b") == math.inf)
    message = f"histogram of {col}: the range of values is not finite"
    edges = edges.withColumn("_a", F.when(endless, F.raise_error(F.lit(message)).cast("double")).otherwise(F.col("_a")))
    edges = edges.select(
        *keys,
        F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    if keys:
        placed = join_sized(rows, edges, keys, "inner")
    else:
        row = edges.select(F.struct("_lo", "_hi")).scalar()
        placed = rows.select("_v", row.getField("_lo").alias("_lo"), row.getField("_hi").alias("_hi"))
    placed = placed.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * step)

    guess = F.least(F.floor((F.col("_v") - F.col("_lo")) / step), F.lit(bins - 1))
    # The division may land one bin off next to an edge; the edge itself decides.
    exact = (
        F.when(F.col("_v") < edge(guess), guess - 1)
        .when((guess < bins - 1) & (F.col("_v") >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = placed.groupBy(*keys, exact.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        edge(F.col("bin")).alias("edge_lo"),
        edge(F.col("bin") + 1).alias("edge_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, key: str | None, cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """ST04, ST05: quartiles and whiskers per key and column; outliers are left out.

    A whisker ends at the furthest value within ``whis`` interquartile ranges of the box. Where a
    task can hold a group's values, all is read from one sorted array; else the quartiles are joined
    to the rows, one wide row per key, and one more pass finds the whiskers of all columns.
    """
    keys, quartiles = [key] if key else [], [0.25, 0.5, 0.75]

    def fences(qv: Column) -> tuple[Column, Column]:
        reach = F.lit(whis) * (qv[2] - qv[0])
        return qv[0] - reach, qv[2] + reach

    def boxed(n: Column, qv: Column, low: Column, high: Column) -> list[Column]:
        return [
            "column", n.alias("n"), qv[0].alias("q1"), qv[1].alias("median"), qv[2].alias("q3"),
            F.least(low, qv[0]).alias("whisker_lo"), F.greatest(high, qv[2]).alias("whisker_hi"),
        ]

    arrays = sorted_arrays(df, cols, keys)
    if arrays is not None:
        ordered = F.col("ordered")
        arrays = arrays.where(F.size(ordered) > 0).withColumn("qv", interpolated(ordered, quartiles))
        low, high = fences(F.col("qv"))
        arrays = arrays.select(
            *keys, "column", "qv", F.size(ordered).cast("long").alias("n"),
            F.array_min(F.filter(ordered, lambda v: v >= low)).alias("low"),
            F.array_max(F.filter(ordered, lambda v: v <= high)).alias("high"),
        )
        return arrays.select(*keys, *boxed(F.col("n"), F.col("qv"), F.col("low"), F.col("high")))

    rows = df.select(*keys, *[number(c).alias(c) for c in cols])
    rows = rows.dropna(subset=keys) if keys else rows
    found = quantile_arrays(rows, cols, quartiles, keys).where(F.col("qv").isNotNull())
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("qv"))).alias(f"_q_{c}") for c in cols])
    if keys:
        joined = join_sized(rows, wide, keys, "inner")
    else:
        row = wide.select(F.struct(*wide.columns)).scalar()
        joined = rows.select("*", *[row.getField(c).alias(c) for c in wide.columns])
    cells = []
    for c in cols:
        value, (low, high) = F.col(c), fences(F.col(f"_q_{c}"))
        cells.append(F.struct(
            F.lit(c).alias("column"), F.max(f"_q_{c}").alias("qv"), F.count(c).alias("n"),
            F.min(F.when(value >= low, value)).alias("low"), F.max(F.when(value <= high, value)).alias("high"),
        ))
    out = joined.groupBy(*keys).agg(F.array(*cells).alias("_cells")).select(*keys, F.inline("_cells"))
    return out.where("n > 0").select(*keys, *boxed(F.col("n"), F.col("qv"), F.col("low"), F.col("high")))


def kde(
    df: DataFrame, key: str, col: str, grid: int = 100, cut: float = 0.0, common_norm: bool = False
) -> DataFrame:
    """ST06: Gaussian kernel density per key on an even grid, bandwidth ``std * n**(-1/5)``.

    The grid runs from min to max, widened by ``cut`` bandwidths. Each task sums the kernels of its
    own rows; only keys x grid sums are shuffled, not the rows. With ``common_norm`` the densities
    of all keys together integrate to 1. Keys with fewer than two distinct values have no density.
    """
    rows = df.select(key, number(col).alias("_v")).dropna()
    stats = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("_v").alias("_std"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    total = rows.agg(F.count(F.lit(1))).scalar() if common_norm else F.col("_n")
    width = F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    shapes = stats.where(F.col("_std") > 0).select(
        key,
        width.alias("_h"),
        (F.col("_min") - cut * width).alias("_from"),
        (F.col("_max") + cut * width).alias("_to"),
        total.cast("double").alias("_total"),
    )
    points = join_sized(rows, shapes, [key], "inner").withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    )
    at = F.col("_from") + F.col("point") * (F.col("_to") - F.col("_from")) / F.lit(grid - 1)
    offset = (at - F.col("_v")) / F.col("_h")
    scale = F.col("_total") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    kernel = F.exp(F.lit(-0.5) * offset * offset) / scale
    return points.groupBy(key, "point").agg(F.max(at).alias("x"), F.sum(kernel).alias("density"))


def auto_bins(sample: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Bin counts by numpy's "auto" rule: the narrower of the Sturges and Freedman-Diaconis widths,
    the latter no less than half the square-root width. Meant for bounded samples: one small row
    comes back to the driver."""
    row = sample.agg(
        *[
            F.struct(F.count(c), F.min(c), F.max(c), F.percentile(c, 0.25), F.percentile(c, 0.75)).alias(c)
            for c in cols
        ]
    ).first()
    out = {}
    for c in cols:
        n, lo, hi, q1, q3 = row[c]
        if not n or lo == hi:
            out[c] = 1
            continue
        sturges = (hi - lo) / (math.log2(n) + 1)
        diaconis = max(2 * (q3 - q1) / n ** (1 / 3), (hi - lo) / math.sqrt(n) / 2)
        out[c] = max(1, math.ceil((hi - lo) / min(sturges, diaconis)))
    return out


def pair_data(
    df: DataFrame, cols: Sequence[str], n: int, keys: Sequence[str], hue: str | None = None, seed: int = 42
) -> DataFrame:
    """ST07: the sampled rows of a pair plot."""
    return sample_n(df, n, keys, seed).select(*cols, *([hue] if hue else []))


def pair_marginals(sample: DataFrame, cols: Sequence[str], hue: str | None = None) -> DataFrame:
    """ST07: the diagonal of a pair plot: a histogram per column, or a density per class."""
    sample = materialize(sample, "sample")
    if hue:
        curves = [
            kde(sample, hue, c, grid=200, cut=3.0, common_norm=True).select(
                F.lit(c).alias("column"), hue, "point", "x", "density"
            )
            for c in cols
        ]
        return reduce(DataFrame.unionByName, curves)
    bins = auto_bins(sample, cols)
    parts = [
        histogram(sample, c, bins[c]).select(F.lit(c).alias("column"), "bin", "edge_lo", "edge_hi", "n")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def with_diagonal(points: DataFrame, x: str, y: str, start: float | None = None) -> DataFrame:
    """The ends of the diagonal on every row: the common range of both axes, or from ``start`` on."""
    low = F.least(F.min(x), F.min(y)).cast("double") if start is None else F.lit(float(start))
    return with_global(points, {"diag_lo": low, "diag_hi": F.greatest(F.max(x), F.max(y)).cast("double")})


def scatter_data(
    df: DataFrame, x: str, y: str, n: int, keys: Sequence[str], seed: int = 42, start: float | None = None
) -> DataFrame:
    """ST08: sampled points, with the ends of the diagonal."""
    return with_diagonal(materialize(sample_n(df, n, keys, seed).select(x, y), "sample"), x, y, start)


def series_data(df: DataFrame, ts: str, v: str, mean: str = "mean_line") -> DataFrame:
    """ST09: the series in time order without its gaps, and its mean on every row."""
    return with_global(df.dropna(subset=[v]).select(ts, v), {mean: F.avg(v)}, of=df).orderBy(ts)
