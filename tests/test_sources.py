"""Sources: headers, integers, short and long lines, missing values, and tables that are already there."""

import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats import session
from routestats.functions import scalars as sc
from routestats.operators import aggregate as agg
from routestats.operators import distribution as dist
from routestats.operators import filters, joins, profile
from routestats.operators import quantiles as qt
from routestats.plans import eda_fuel, fare_model
from routestats.sources import tables as src
from routestats.streaming.incremental import clean_files, clean_incrementally


def schema(text):
    return T.StructType.fromDDL(text)


def write(folder, **files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_columns_are_matched_by_name_file_by_file(spark, tmp_path):
    folder = write(tmp_path, a="a,b\n1,x\n", b="b,a,more\ny,2,m\n", c="a,b\n3,NA\n", _hidden="zzz\n", empty="")
    got = {r.a: (r.b, r.more) for r in src.read_table(spark, folder, schema("a int, b string")).collect()}
    assert got == {1: ("x", None), 2: ("y", "m"), 3: (None, None)}
    both = [f"{folder}/a", f"{folder}/b"]
    assert sorted(r.a for r in src.read_table(spark, both, schema("a int")).collect()) == [1, 2]
    assert src.read_table(spark, f"{folder}/[ac]", schema("a int")).count() == 2
    with pytest.raises(FileNotFoundError):
        src.read_table(spark, f"{folder}/nothing", schema("a int"))


def test_compressed_files_and_partition_folders(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows.write.option("header", "true").option("compression", "gzip").csv(str(tmp_path / "z"))
    assert sorted(map(tuple, src.read_table(spark, str(tmp_path / "z"), schema("v bigint, k bigint")).collect()))[3] == (6, 3)


def test_short_lines_are_filled_up_and_long_ones_fail(spark, tmp_path):
    folder = write(tmp_path, f='a,b,c\n1\n2,"x,y"\n3,z,w\n\n4,,\n')
    rows = src.read_table(spark, folder, schema("a int, b string, c string")).orderBy("a").collect()
    assert list(map(tuple, rows)) == [(1, None, None), (2, "x,y", None), (3, "z", "w"), (4, None, None)]
    (tmp_path / "g").write_text("a,b,c\n5,x,y,z\n")
    with pytest.raises(Exception, match="more fields than the header"):
        src.read_table(spark, folder, schema("a int, b string, c string")).collect()


def test_integers_are_exact(frame, values):
    texts = ["9007199254740993", "-9223372036854775808", "9223372036854775808", "5.0", "1e3", "1.7", " 7 ", "x", None, "inf", "1e30"]
    df = frame("t string", *[(t,) for t in texts])
    got = values(df.select(sc.text_to_integer("t").alias("n")), "n")
    assert got == [9007199254740993, -(2**63), None, 5, 1000, None, 7, None, None, None, None]
    assert values(df.select(sc.text_to_integer("t", "int").alias("n")), "n")[:4] == [None, None, None, 5]


@pytest.fixture
def with_nan(spark, tmp_path):
    path = str(tmp_path / "nan")
    rows = [("a", 1.0), ("a", math.nan), ("a", 3.0), ("b", None), ("b", math.nan)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(path)
    return path


def test_nan_in_parquet_is_missing(spark, with_nan):
    df = src.read_optional(spark, with_nan)
    assert sorted(map(tuple, agg.group_mean(df, ["k"], "v", "m").collect())) == [("a", 2.0), ("b", None)]
    assert sorted(map(tuple, agg.group_sum(df, ["k"], "v", "s").collect())) == [("a", 4.0), ("b", 0.0)]
    assert agg.value_range(df, ["v"]).first().asDict() == {"lo": 1.0, "hi": 3.0}
    assert df.select(F.sum(sc.flag_ge("v", 2.0)).alias("n")).first().n == 1
    (again,) = src.ensure_tables(spark, with_nan.rsplit("/", 1)[0], lambda name: None, ["nan"]).values()
    assert again.where(F.isnan("v")).count() == 0


def test_profiles_count_nan_as_missing(spark, with_nan):
    raw = spark.read.parquet(with_nan)
    assert {r["column"]: r.missing for r in profile.missing_counts(raw).collect()} == {"k": 0, "v": 3}
    for approx in (False, True):
        assert {r["column"]: r.n for r in agg.distinct_counts(raw, ["k", "v"], approx).collect()} == {"k": 2, "v": 2}


def test_nan_is_not_stored(spark, with_nan, tmp_path):
    src.write_table(spark.read.parquet(with_nan), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("v is null").count() == 3


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    src.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        src.write_table(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise("x").alias("id")), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    src.write_table(spark.read.parquet(path).where("id > 2"), path)  # by what was read from it
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    (tmp_path / "t").rename(tmp_path / ".t.old")  # the program ended between the two renames
    assert src.table_exists(spark, path) and src.read_optional(spark, path).count() == 2
    (tmp_path / "t").rename(tmp_path / ".t.old")
    src.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_stream_has_the_rules_of_a_batch(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b string")
    clean = lambda raw: raw.where("a is null or a < 100")
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()

    def step():
        return clean_incrementally(spark, folder, schema, clean, out, progress, files_per_batch=1)

    assert step().columns == ["a", "b"] and step().count() == 0
    (tmp_path / "in/1.csv").write_text("a,b\n1,x\n2\n300,y\nN/A,null\n")
    (tmp_path / "in/2.csv").write_text("b,extra,a\nz,more,7\n")
    (tmp_path / "in/_hidden.csv").write_text("a,b\n9,q\n")
    os.utime(tmp_path / "in/1.csv", (1_000_000, 1_000_000))  # the older file comes first
    for _ in range(2):  # nothing is done twice
        rows = {(r.a, r.b, r.extra) for r in step().collect()}
        assert rows == {(1, "x", None), (2, None, None), (None, None, None), (7, "z", "more")} and step().count() == 4
    batch = src.read_table(spark, folder, schema)
    assert rows == {(r.a, r.b, r.extra) for r in clean(batch).collect()}
    clean_files(spark, [f"{folder}/2.csv"], schema, clean, out, 1)  # a batch done again
    assert spark.read.option("mergeSchema", "true").parquet(out).count() == 4
    (tmp_path / "in/3.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        step()


def test_data_without_a_mark_is_not_written_over(spark, tmp_path):
    out = str(tmp_path)
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/t")
    (tmp_path / "hollow").mkdir()
    built = src.ensure_tables(spark, out, lambda name: spark.range(1), ["t", "hollow2"])
    assert built["t"].count() == 3 and built["hollow2"].count() == 1
    assert not src.table_exists(spark, f"{out}/hollow")
    (tmp_path / "t" / "_temporary").mkdir()
    with pytest.raises(RuntimeError, match="unfinished"):
        src.table_exists(spark, f"{out}/t")


def test_endless_ranges_have_no_bins(frame):
    df = frame("k string, v double", ("a", 1.0), ("a", math.inf))
    with pytest.raises(Exception, match="not finite"):
        dist.histogram(df, "v", 2).collect()
    with pytest.raises(Exception, match="not finite"):
        dist.histogram(df, "v", 2, keys=["k"]).collect()
    assert [r.n for r in dist.histogram(df, "v", 2, 0.0, 2.0).orderBy("bin").collect()] == [0, 1]


def test_lookup_never_multiplies_rows(frame, values):
    df, dim = frame("k int", (1,), (2,), (None,)), frame("k int, l string", (1, "a"), (1, "b"), (1, None), (None, "z"))
    assert sorted(values(joins.lookup(df, "k", dim, "label", "-"), "label")) == ["-", "-", "b"]


def test_boxes_agree_on_both_paths(spark, monkeypatch):
    df = spark.range(3000).select(
        F.when(F.col("id") % 7 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 1009).cast("double")).alias("a"),
        F.lit(None).cast("double").alias("none"), F.exp(F.col("id") % 13).alias("b"),
    )

    def boxes(key):
        rows = dist.box_stats(df, key, ["a", "none", "b"]).collect()
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)

    held = [boxes("k"), boxes(None)]
    for function in (qt.sorted_arrays, qt.quantile_arrays):
        names = function.__code__.co_varnames[: function.__code__.co_argcount]
        defaults = list(function.__defaults__)
        defaults[names.index("limit") - (len(names) - len(defaults))] = 50
        monkeypatch.setattr(function, "__defaults__", tuple(defaults))
    assert [boxes("k"), boxes(None)] == held
    assert len(held[0]) == 12 and len(held[1]) == 2


def test_active_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("SEATS"), F.lit(1.0).alias("lf")).write.parquet(path)
    plan = filters.active_or_all(spark.read.parquet(path), F.col("SEATS") > 0, {"lf": 0.0})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(SEATS,0)" in text.split("PushedFilters")[1]


def test_many_rows_a_day_stay_in_blocks(spark, monkeypatch):
    from routestats.operators import scale

    defaults = list(scale.over_ordered.__defaults__)
    monkeypatch.setattr(scale.over_ordered, "__defaults__", (defaults[0], 500))
    df = spark.range(4000).select(F.expr("date '2025-01-01' + cast(id % 2 as int)").alias("observation_date"), F.col("id").cast("double").alias("price"))
    changed = eda_fuel.with_change(df)
    lines = changed._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [below for line, below in zip(lines, lines[1:]) if "Exchange SinglePartition" in line]
    assert all("HashAggregate(keys=[_part" in below for below in single)  # only a row per partition
    assert changed.count() == 4000


def test_route_windows_use_counted_sizes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fare_model, "group_sizes", lambda df, keys: seen.append(keys) or (10**9, 10**9))
    rows = [(2025, q, "A", "B", 0.1 * q) for q in (1, 2, 3)]
    df = spark.createDataFrame(rows, "YEAR int, QUARTER int, ORIGIN string, DEST string, load_factor double")
    got = fare_model.with_route_features(df).orderBy("QUARTER").collect()
    assert seen == [["route"]] and [round(r.lag_load_factor, 9) for r in got] == [0.1, 0.1, 0.2]


def test_key_hashes_tell_keys_apart(frame, values):
    df = frame("a string, b string", ("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("x", None), ("x", ""))
    assert len(set(values(df.select(sc.key_hash(["a", "b"], 1).alias("h")), "h"))) == 6


def test_scratch_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    stored = session.materialize(spark.range(3), "gone")
    assert stored.count() == 3 and list(tmp_path.rglob("*.parquet"))
    session.clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))
