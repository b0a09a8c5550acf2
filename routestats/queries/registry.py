"""The list of registered queries: a Spark callable and, where possible, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def add(name: str, run: Run, sql: str | None = None, doubles: str = "", digits: int = 4, dates: str = "") -> None:
    """Register a query. Both sides round the columns in ``doubles`` and print those in ``dates``.

    Sums in another order differ in the last bits. Exact halves, common in means of amounts with
    two decimals, would round by those bits, so the rounding border is moved a little off them.
    Adding 0.0 drops the sign of zero.
    """
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    rounded, printed = doubles.split(), dates.split()
    shift = 0.0173205 * 10**-digits

    def finish(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        changes = {c: F.round(F.col(c).cast("double") + F.lit(shift), digits) + F.lit(0.0) for c in rounded}
        changes |= {c: F.date_format(c, "yyyy-MM-dd") for c in printed}
        return df.withColumns(changes) if changes else df

    replaced = [f"round({c}::DOUBLE + {shift}, {digits}) + 0.0 AS {c}" for c in rounded]
    replaced += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in printed]
    if sql and replaced:
        sql = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})"
    REGISTRY[name] = Query(finish, sql)
