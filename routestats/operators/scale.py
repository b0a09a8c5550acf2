"""What the other operators use to stay correct and even when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from routestats.session import materialize

# Rows of one key that a single task may hold; beyond it the work is split within the key.
GROUP_ROWS = 1_000_000
# Rows of a narrow table that may be broadcast; beyond it the join shuffles, salted.
BROADCAST_ROWS = 100_000
SALTS = 32

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def group_sizes(df: DataFrame, keys: Sequence[str] = ()) -> tuple[int, int]:
    """Rows of the most frequent key and of all keys, from one map-side-combined count.

    Without keys both are the row count, which a plain Parquet scan answers from its metadata.
    """
    if not keys:
        n = df.count()
        return n, n
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def join_sized(
    df: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join per-key values onto rows: broadcast if counted small, else a salted shuffle join.

    ``small`` must have one row per key. It is written once, so that counting it costs no second
    run; ``stored`` says that it is already a written table.
    The salt is the input partition number: it splits a hot key, copies of one row included, and
    a retried task computes the same salt.
    """
    small = small if stored else materialize(small, "join-side")
    if small.count() <= limit:
        return df.join(F.broadcast(small), list(keys), how)
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Attach the 0-based position in the total order, without a one-task window.

    A range shuffle places the rows, each partition numbers its own, and the partition sizes give
    the offsets. The placed rows are written first: a recomputed range shuffle could cut elsewhere.
    ``order`` must be unique over rows for the result to be reproducible.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "ranged",
    )
    placed = placed.select(
        *df.columns,
        F.shiftright("_pos", _POSITION_BITS).alias("_part"),
        F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_at"),
    )
    # One row per partition, so this window is over the partition count, never over the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_at")).alias(name)
    )


def over_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    group_rows: int | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows, whatever the size of a key.

    Keys of up to ``limit`` rows use an ordinary keyed window. Beyond that, rows are cut into
    blocks by global position, each block also gets the last ``reach`` rows of the block before,
    the window runs per block, and the borrowed rows are dropped. ``group_rows`` is the size of the
    largest key if the caller has counted it; without it, it is counted first.
    """
    if group_rows is None:
        group_rows = group_sizes(df, keys)[0]
    if group_rows <= limit:
        columns = build(Window.partitionBy(*keys).orderBy(*order))
        return df.select("*", *[c.alias(name) for name, c in columns.items()])

    size = max(limit, reach, 1)
    numbered = with_row_number(df, [*keys, *order], "_rn")
    block = F.floor(F.col("_rn") / F.lit(size))
    lent = F.col("_rn") % F.lit(size) >= F.lit(size - reach)
    spread = numbered.withColumn(
        "_block", F.explode(F.when(lent, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    columns = build(Window.partitionBy("_block", *keys).orderBy("_rn"))
    done = spread.select("*", *[c.alias(name) for name, c in columns.items()])
    return done.where(F.col("_block") == block).drop("_rn", "_block")


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "running_total",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Sum of ``value`` up to and including each row, per key, in blocks of ``limit`` rows.

    Rows with a missing key have none.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    if group_sizes(df, keys)[0] <= limit:
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.when(known, F.sum(value).over(window)))

    numbered = with_row_number(df, [*keys, *order], "_rn")
    numbered = numbered.withColumn("_block", F.floor(F.col("_rn") / F.lit(limit)))
    inside = Window.partitionBy("_block", *keys).orderBy("_rn")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        numbered.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_block", F.sum("_sum").over(before).alias("_carried"))
        .where(F.col("_carried").isNotNull())  # only keys that cross a block border
    )
    local = numbered.withColumn("_local", F.sum(value).over(inside))
    return join_sized(local, carried, [*keys, "_block"]).select(
        *df.columns,
        F.when(known, F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0))).alias(name),
    )
