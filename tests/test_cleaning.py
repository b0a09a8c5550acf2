"""Sources, filters, cleaning steps and scalar functions on small hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from routestats.functions import scalars as sc
from routestats.operators import aggregate as agg
from routestats.operators import clean, filters, joins
from routestats.plans import cleaning
from routestats.plans import schemas as S
from routestats.session import scratch_path
from routestats.sources import tables as src


def test_numbers_are_coerced_or_missing(frame, values):
    texts = ["x", " 12 ", "1d", "1e3", "1,000", "NaN", "", "NA", "0x10", "-.5", "+7.", "inf", None]
    df = clean.coerce_numeric(frame("i int, v string", *enumerate(texts)), ["v"])
    want = [None, 12.0, None, 1000.0, None, None, None, None, None, -0.5, 7.0, float("inf"), None]
    assert values(df, "v", "i") == want


def test_nan_never_gets_past_coercion(frame, values):
    df = clean.coerce_numeric(frame("v double", (float("nan"),), (0.9,)), ["v"])
    assert sorted(values(df.select(sc.flag_ge("v", 0.8).alias("f")), "f")) == [0, 1]


def test_zfill(frame, values):
    df = frame("i int, v string", *enumerate(["5", "905", "12345", "5.0", None, "nan"]))
    assert values(df.select("i", sc.zfill(sc.na_to_null("v"), 4).alias("z")), "z", "i") == [
        "0005", "0905", "12345", "0005", None, None,
    ]
    assert values(frame("v int", (2400,)).select(sc.hhmm_hour("v").alias("h")), "h") == [24]


def test_strict_casts_fail(frame):
    with pytest.raises(Exception, match="missing v"):
        clean.cast_int_strict(frame("v string", ("1",), (None,)), "v").collect()
    with pytest.raises(Exception):
        clean.parse_timestamp(frame("v string", ("no date",)), "v").collect()


def test_period_bounds(frame, values):
    days = ["2024-12-31 00:00:00", "2025-01-01 00:00:00", "2025-03-31 00:00:00", "2025-03-31 10:00:00"]
    df = clean.parse_timestamp(frame("v string", *[(d,) for d in days]), "v")
    kept = values(filters.filter_between(df, "v", "2025-01-01", "2025-03-31"), "v", "v")
    assert kept == [datetime.datetime(2025, 1, 1), datetime.datetime(2025, 3, 31)]


def test_either_end_in_set(frame, values):
    rows = [("LAX", "JFK"), ("JFK", "LAX"), ("JFK", "ORD"), (None, "LAX"), (None, "JFK")]
    df = filters.filter_any_in(frame("o string, d string", *rows), ["o", "d"], ["LAX"])
    assert sorted(df.collect(), key=str) == sorted([("LAX", "JFK"), ("JFK", "LAX"), (None, "LAX")], key=str)


def test_fallback_to_all_rows(frame, values):
    df = frame("s double, lf double", (0.0, None), (None, 2.0))
    assert values(filters.active_or_all(df, F.col("s") > 0, {"lf": 0.0}), "lf") == [0.0, 0.0]
    df = frame("s double, lf double", (0.0, None), (3.0, 2.0))
    assert values(filters.active_or_all(df, F.col("s") > 0, {"lf": 0.0}), "lf") == [2.0]


def test_quantile_clip_is_strict(spark, values):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert max(values(filters.clip_below_quantile(df, "v", 0.99), "v")) == 98.0


def test_membership_in_a_large_table_is_salted(spark, monkeypatch):
    from routestats.operators import scale

    monkeypatch.setattr(scale.join_sized, "__defaults__", ("left", 2, False))
    df = spark.range(100).repartition(5).withColumn("k", F.col("id") % 7)
    wanted = spark.range(5).select(F.col("id").alias("x"))
    assert filters.filter_in(df, "k", wanted).count() == df.where("k < 5").count()


def test_median_imputation(frame, values):
    df = frame("i int, a double, b double", (1, 1.0, None), (2, None, None), (3, 4.0, None), (4, 10.0, None))
    out = clean.impute_median(df, ["a", "b", "c"])
    assert values(out, "a", "i") == [1.0, 4.0, 4.0, 10.0] and values(out, "b", "i") == [0.0] * 4
    train = frame("a double, b double", (100.0, 5.0))
    assert values(clean.impute_median(df, ["a", "b"], fit_on=train), "a", "i") == [1.0, 100.0, 4.0, 10.0]


def test_safe_division_and_flags(frame):
    rows = [(8.0, 10.0), (8.0, 0.0), (8.0, None), (None, 10.0), (7.9, 10.0)]
    df = frame("p double, s double", *rows).withColumn("lf", sc.safe_divide("p", "s"))
    got = df.select("lf", sc.flag_ge("lf", 0.8)).collect()
    assert [tuple(r) for r in got] == [(0.8, 1), (None, 0), (None, 0), (None, 0), (0.79, 0)]


def test_missing_keys_and_sums(frame):
    df = frame("k string, v double", ("a", None), ("a", None), ("b", 2.0), (None, 5.0))
    assert sorted(map(tuple, agg.group_sum(df, ["k"], "v", "s").collect())) == [("a", 0.0), ("b", 2.0)]
    assert sorted(map(tuple, agg.group_mean(df, ["k"], "v", "m").collect()), key=str) == [("a", None), ("b", 2.0)]
    assert agg.value_counts(df, "k").count() == 2
    routes = df.select(sc.route_key("k", F.lit("x")).alias("r")).collect()
    assert sorted((r.r for r in routes), key=str) == [None, "a-x", "a-x", "b-x"]


def test_distinct_counts_ignore_missing_and_zero_sign(frame):
    df = frame("a double, b string", (0.0, "x"), (-0.0, None), (1.0, "x"), (None, "y"))
    assert {r["column"]: r.n for r in agg.distinct_counts(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}


def test_weekday_domain_and_iso_weeks(frame, values):
    df = frame("day string, n int", ("Monday", 1), ("Sunday", 7))
    out = joins.conform(df, "day", S.DAY_ORDER).collect()
    assert [r.day for r in out] == S.DAY_ORDER and [r.n for r in out] == [1, None, None, None, None, None, 7]
    df = frame("d string", ("2024-12-30",), ("2025-01-02",)).withColumn("d", F.col("d").cast("date"))
    assert values(df.select(sc.iso_week("d").alias("w")), "w") == [1, 1]
    assert values(df.select(sc.iso_year("d").alias("w")), "w") == [2025, 2025]


def test_missing_fuel_quarter_keeps_the_row(frame):
    left = frame("YEAR int, QUARTER int, v int", (2025, 1, 1), (2025, 2, 2))
    daily = frame("d string, p double", ("2025-01-02", 2.0), ("2025-03-31", 2.5), ("2025-02-03", None))
    daily = daily.withColumn("d", F.col("d").cast("date"))
    got = sorted(map(tuple, joins.join_calendar(left, daily, "d", {"p": F.avg("p")}).collect()))
    assert got == [(2025, 1, 1, 2.25), (2025, 2, 2, None)]


def test_required_columns(frame):
    df = frame("a int", (1,))
    assert clean.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="'b', 'c'"):
        clean.require_columns(df, ["a", "b", "c"])


def test_csv_columns_are_matched_by_name(spark):
    path = scratch_path(spark, "csv")
    rows = spark.createDataFrame([("NA", "7", "a,\"b\""), ("3.5", "n/a", "null")], "x string, y string, z string")
    rows.write.option("header", "true").option("escape", '"').csv(path)
    schema = src.T.StructType.fromDDL("z string, x double, y int")
    got = src.read_table(spark, path, schema).collect()
    assert sorted(map(tuple, got), key=str) == sorted([('a,"b"', None, 7), (None, 3.5, None)], key=str)


def test_empty_scan_keeps_its_schema(spark, frame):
    raw = frame("Date string, Origin string, Dest string, Carrier string, `Airline Name` string, Dep_Time string,"
                "Actual_Dep string, Delay string, Cancelled string")  # fmt: skip
    out = cleaning.clean_flights(raw)
    assert out.count() == 0 and out.columns == S.FLIGHTS.names
    assert dict(out.dtypes)["Delay"] == "double" and dict(out.dtypes)["Cancelled"] == "int"


def test_only_missing_tables_are_built(spark, frame):
    out, built = scratch_path(spark, "layer"), []

    def build(name):
        built.append(name)
        return frame("v string", (name,))

    src.ensure_tables(spark, out, build, ["a"])
    tables = src.ensure_tables(spark, out, build, ["a", "b"])
    assert built == ["a", "b"] and tables["b"].first().v == "b"
    assert src.read_optional(spark, f"{out}/c") is None


def test_clean_period():
    assert cleaning.Period(2025, 1).first_day == "2025-01-01" and cleaning.Period(2025, 1).last_day == "2025-03-31"
    assert cleaning.Period(2024, 2).months == [4, 5, 6] and cleaning.Period(2024, 2).last_day == "2024-06-30"
