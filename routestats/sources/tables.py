"""Sources and sinks (SRC, SNK)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats.functions.scalars import NA_TOKENS, na_to_null, nan_to_null, text_to_double, text_to_integer

_CSV = {"header": "true", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}


def _typed(c: Column, kind: T.DataType, date_format: str | None) -> Column:
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.IntegralType):
        return text_to_integer(c, kind.simpleString())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return text_to_double(c).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        parsed = F.to_timestamp(c, date_format) if date_format else c
        return parsed.cast(kind)  # strict: an unreadable date fails the job
    return c.cast(kind)


def typed_columns(
    raw: DataFrame, schema: T.StructType, na_tokens: Sequence[str] = NA_TOKENS, date_format: str | None = None
) -> DataFrame:
    """Give text columns, matched by name, the types of ``schema``; missing spellings become NULL.

    Columns that ``schema`` doesn't name follow as text.
    """
    names = set(schema.names)
    listed = [
        _typed(na_to_null(F.col(f"`{f.name}`"), na_tokens), f.dataType, date_format).alias(f.name) for f in schema
    ]
    others = [na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns if c not in names]
    return raw.select(*listed, *others)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NULL instead of NaN in every float column; nothing else changes."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The file ``path``, or the data files below the folder; hidden ones (``_``, ``.``) don't count.

    A path with a wildcard stands for all that it matches.
    """
    fs, target = _hadoop(spark, path)
    found, pending = [], list(fs.globStatus(target) or [])
    while pending:
        status = pending.pop()
        if status.isFile():
            found.append(status.getPath().toString())
        else:
            pending += [s for s in fs.listStatus(status.getPath()) if not _hidden(s.getPath().getName())]
    return sorted(found)


def _header(spark: SparkSession, path: str) -> str:
    """The first line of a text file, unpacked if its name says that it is compressed."""
    fs, target = _hadoop(spark, path)
    jvm, stream = spark._jvm, fs.open(target)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(target)
        opened = codec.createInputStream(stream) if codec else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def read_text_columns(spark: SparkSession, paths: Sequence[str], multiline: bool = False) -> DataFrame:
    """All columns of headered CSV files as text, united by the names in the headers.

    Files with the same header line are read together; the column order of the others may differ,
    and a column that some files lack is missing there. A short line is filled up with missing
    values; a line with more fields than the header fails the job.
    """
    groups: dict[str, list[str]] = {}
    for path in paths:
        for file in data_files(spark, path):
            groups.setdefault(_header(spark, file), []).append(file)
    if not groups:
        raise FileNotFoundError(f"no files in {list(paths)}")
    parts = []
    for line, files in groups.items():
        if not line and len(groups) > 1:
            continue  # an empty file among others
        reader = spark.read.options(**_CSV, multiLine=str(multiline).lower())
        names = reader.csv(files[:1]).columns
        text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_line"]])
        rows = reader.schema(text).csv(files)
        wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
        fields = F.from_csv(F.col("_line"), wide.toDDL(), {"escape": '"'})
        too_long = F.col("_line").isNotNull() & fields[f"c{len(names)}"].isNotNull()
        message = F.concat(F.lit("more fields than the header has: "), F.col("_line"))
        first = F.when(too_long, F.raise_error(message).cast("string")).otherwise(F.col(f"`{names[0]}`"))
        parts.append(rows.select(first.alias(names[0]), *[F.col(f"`{c}`") for c in names[1:]]))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    na_tokens: Sequence[str] = NA_TOKENS,
    date_format: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """SRC01-03: headered CSV to typed columns.

    Columns are matched by header name, file by file; those that ``schema`` doesn't name are kept
    as text. All are read as text first so that every missing-value spelling becomes NULL (N12).
    A whole number is read exactly; a text that is no whole number is NULL in an integer column.
    The file splits bound the memory of a scan of any size, and an empty result keeps its schema.
    Only the header lines are read ahead; types are never inferred. ``multiline`` allows line
    breaks inside quotes, at the price of unsplittable files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return typed_columns(read_text_columns(spark, paths, multiline), schema, na_tokens, date_format)


def read_family(
    spark: SparkSession, template: str, keys: Sequence[str], schema: T.StructType, tag: str | None = None, **options
) -> DataFrame:
    """SRC04: one file per key, path given by a template with ``{key}``; ``tag`` adds the key.

    The files are united by column name, so their column order may differ.
    """
    parts = []
    for key in keys:
        part = read_table(spark, template.format(key=key), schema, **options)
        parts.append(part.withColumn(tag, F.lit(key)) if tag else part)
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def table_exists(spark: SparkSession, path: str) -> bool:
    """A file, or a folder that a Spark write has marked as complete, or one that holds data files.

    Other writers leave no mark, so data without one counts as a table. Data next to the working
    folder of a write that is under way or broke off is neither a table nor nothing: that fails.
    """
    _restore(spark, path)
    fs, target = _hadoop(spark, path)
    if not fs.exists(target):
        return False
    inside = spark._jvm.org.apache.hadoop.fs.Path
    if fs.getFileStatus(target).isFile() or fs.exists(inside(target, "_SUCCESS")):
        return True
    if not data_files(spark, path):
        return False
    if fs.exists(inside(target, "_temporary")):
        raise RuntimeError(f"{path} holds data of an unfinished write")
    return True


def read_optional(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame | None:
    """SRC05: the table, or None where there is none. NaN is NULL (N-rules)."""
    if not table_exists(spark, path):
        return None
    if fmt == "csv":
        return read_table(spark, path, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_as_null(reader.format(fmt).load(path))


def ensure_tables(
    spark: SparkSession, out: str, build: Callable[[str], DataFrame], names: Sequence[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """SRC06: the stored tables, building each one that is missing (each is checked, not the folder).

    Nothing that holds data is written over. NaN is NULL (N-rules).
    """
    tables = {}
    for name in names:
        path = f"{out}/{name}"
        if not table_exists(spark, path):
            write_table(build(name), path, fmt)
        tables[name] = nan_as_null(spark.read.format(fmt).load(path))
    return tables


def _aside(spark: SparkSession, path: str, kind: str):
    """A hidden neighbour of a path: nobody takes it for data."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{kind}")


def _restore(spark: SparkSession, path: str) -> None:
    """Bring back the table that a broken-off :func:`write_table` had already moved aside."""
    fs, target = _hadoop(spark, path)
    old = _aside(spark, path, "old")
    if target.getParent() and not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> DataFrame:
    """SNK01, SNK02, SNK04, SNK05: store a table, replacing what is there. Returns ``df``.

    NaN is stored as NULL, so that whoever reads the table finds one spelling of missing.

    The table is written beside its place and takes it when it is whole: a write that fails leaves the old table as it
    was, and a table can be replaced by what was read from it. The old one is moved aside for the moment between;
    should the program end right then, readers and writers here put it back. On file systems that rename by copying,
    the exchange takes as long as a copy.
    """
    spark = df.sparkSession
    fs, target = _hadoop(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    new, old = _aside(spark, path, f"new-{uuid.uuid4().hex}"), _aside(spark, path, "old")
    writer = nan_as_null(df).write.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    try:
        writer.format(fmt).save(new.toString())
        _restore(spark, path)
        fs.delete(old, True)
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(new, target):
            _restore(spark, path)
            raise OSError(f"{path} can't be written")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)
    return df


def matrix_wide(corr: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SNK03: a long ``(x, y, corr)`` matrix as one labelled row per ``x``, in the order of ``cols``."""
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("x"))
    cells = [F.max(F.when(F.col("y") == c, F.col("corr"))).alias(c) for c in cols]
    return corr.groupBy("x").agg(*cells).orderBy(order)


def write_matrix(corr: DataFrame, path: str, cols: Sequence[str], fmt: str = "csv") -> DataFrame:
    """SNK03: store a correlation matrix with its row labels; it has one row per column name."""
    return write_table(matrix_wide(corr, cols).coalesce(1), path, fmt)


def write_all(tables: Mapping[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    """SNK01 for several tables."""
    for name, df in tables.items():
        write_table(df, f"{out}/{name}", fmt)
