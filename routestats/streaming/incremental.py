"""SRC02 as a stream: clean a growing folder of CSV files a few files at a time.

The cleaning steps look at one row at a time, so the same function serves a batch and a stream. The stream only tells
which files are new; each micro-batch reads its files as a batch would, so both have the same rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats.functions.scalars import NA_TOKENS
from routestats.sources.tables import data_files, read_text_columns, typed_columns, write_table

# Columns of the source that lists files; their content is never read through it.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def clean_files(
    spark: SparkSession,
    files: Sequence[str],
    schema: T.StructType,
    clean: Callable[[DataFrame], DataFrame],
    out: str,
    batch: int,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> None:
    """Clean the files of one micro-batch into a folder of its own, named by the batch.

    A batch that is done again, after a failure between its end and the note of it, replaces what it wrote. A column
    that none of its files has is missing in it, as it is in a batch over more files.
    """
    raw = read_text_columns(spark, sorted(files))
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in schema.names if c not in raw.columns})
    write_table(clean(typed_columns(raw, schema, na_tokens)), f"{out}/batch={batch}")


def clean_incrementally(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    clean: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int = 100,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """Clean all files not yet done, add the survivors to ``out`` and return that table.

    Files are read as ``read_table`` does: columns by header name, short lines filled up, lines that are too long fail,
    columns that ``schema`` doesn't name kept as text. The checkpoint folder records the files already done: a restart
    continues, and no file counts twice. The driver sees the names of at most ``files_per_batch`` files at a time.
    """

    def batch(rows: DataFrame, number: int) -> None:
        files = [r.path for r in rows.select("path").distinct().collect()]
        if files:
            clean_files(spark, files, schema, clean, out, number, na_tokens)

    listed = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
        .load(source).select("path")
    )
    query = listed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not data_files(spark, out):
        text = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
        return clean(typed_columns(spark.createDataFrame([], text), schema, na_tokens))
    return spark.read.option("mergeSchema", "true").option("basePath", out).parquet(out).drop("batch")
