"""Small helpers around ``mapInArrow``: rows in, rows out, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes after which a batch of results is handed on.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, converted a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def emit(schema: pa.Schema, rows: Iterable[tuple], weight: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples; ``weight`` estimates a row's bytes where rows can be large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_rows(
    df: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: pa.Schema, ddl: str,
    weight: Callable[[tuple], int] | None = None,
) -> DataFrame:
    """``function`` over the rows of each partition as one stream of tuples."""
    return df.mapInArrow(lambda batches: emit(schema, function(rows_of(batches)), weight), ddl)
