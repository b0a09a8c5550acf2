"""The paths for large groups give the same results as the plain ones, under any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routestats.operators import quantiles as qt
from routestats.operators import scale, topk, windows
from routestats.operators.models import hash_threshold, with_split


@pytest.fixture(scope="module")
def skewed(spark):
    """Key "hot" holds a third of the rows and one of its values a third of those; "one" is single."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else ("one" if i == 1 else f"k{rnd.randrange(40)}")
        value = 5.0 if key == "hot" and i % 9 == 0 else round(rnd.lognormvariate(2, 2), 3)
        rows.append((i, key if i % 50 else None, None if i % 17 == 0 else value))
    return spark.createDataFrame(rows, "i int, k string, v double").cache()


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_row_number(skewed, parts):
    out = scale.with_row_number(skewed.repartition(parts).select("i"), ["i"])
    assert out.where("i != row_number").count() == 0 and out.count() == 3000


def test_running_total(skewed):
    rows = skewed.select("i", "k", F.coalesce("v", F.lit(0.0)).alias("v"))
    out = scale.with_running_total(rows, ["k"], ["i"], "v", limit=90)
    window = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("w", F.sum("v").over(window))
    both = out.join(want.select("i", "w"), "i")
    assert both.where("k is not null and not abs(running_total - w) < 1e-6").count() == 0
    assert both.where("k is null and running_total is not null").count() == 0
    assert out.count() == 3000


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("limit, reach", [(3, 1), (3, 6), (100, 20)])
def test_blocks_equal_plain_windows(skewed, parts, limit, reach):
    rows = skewed.repartition(parts)

    def build(w):
        return {"a": F.avg("v").over(w.rowsBetween(-reach, 0)), "b": F.lag("v", reach).over(w)}

    got = scale.over_ordered(rows, ["k"], ["i"], reach, build, limit=limit)
    want = scale.over_ordered(rows, ["k"], ["i"], reach, build, group_rows=1)
    both = got.join(want.select("i", F.col("a").alias("wa"), F.col("b").alias("wb")), "i")
    assert both.count() == 3000
    same = F.col("b").eqNullSafe(F.col("wb")) & (
        (F.col("a").isNull() & F.col("wa").isNull()) | (F.abs(F.col("a") - F.col("wa")) < 1e-9)
    )
    assert both.where(~F.coalesce(same, F.lit(False))).count() == 0


def test_series_operators_agree_in_blocks(skewed, monkeypatch):
    plain = {
        "lag": windows.lag_by(skewed, ["k"], ["i"], "v", "x", fill="v"),
        "roll": windows.rolling_mean(skewed, ["k"], ["i"], "v", "x", 2, 1, fill="v"),
        "diff": windows.diff(skewed, ["i"], "v", "x", ["k"]),
        "mean": windows.partition_mean(skewed, ["k"], "v", "x", group_rows=3000),
    }
    defaults = list(scale.over_ordered.__defaults__)
    monkeypatch.setattr(scale.over_ordered, "__defaults__", (defaults[0], 64))
    split = {
        "lag": windows.lag_by(skewed, ["k"], ["i"], "v", "x", fill="v"),
        "roll": windows.rolling_mean(skewed, ["k"], ["i"], "v", "x", 2, 1, fill="v"),
        "diff": windows.diff(skewed, ["i"], "v", "x", ["k"]),
        "mean": windows.partition_mean(skewed, ["k"], "v", "x"),
    }
    for name in plain:
        def rounded(df):
            return sorted(map(str, df.select("i", F.round("x", 9)).collect()))

        assert rounded(plain[name]) == rounded(split[name]), name


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("limit", [5, 200])
def test_large_quantiles_equal_percentile(skewed, keys, limit):
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = qt.quantiles(skewed, ["v", "i"], qs, keys, limit=limit)
    want = qt.quantiles(skewed, ["v", "i"], qs, keys)

    def table(df):
        return {tuple(str(r[c]) for c in (*keys, "column", "q")): r.value for r in df.collect()}

    got, want = table(got), table(want)
    assert got.keys() == want.keys()
    for cell, value in want.items():
        assert got[cell] == pytest.approx(value, abs=1e-9), cell


def rows_with_probe(df, pairs):
    probe = F.array(*[F.lit(v) for pair in pairs for v in pair])
    return df.where("k is not null and k != 'k3'").select("k", F.lit("v").alias("column"), probe.alias("_probe")).distinct()


@pytest.mark.parametrize("aim", [30, 600])
def test_brackets_from_a_sample(skewed, monkeypatch, aim):
    """Small samples leave groups out or say little about them; the result is the same."""
    monkeypatch.setattr(qt, "_AIM_ROWS", aim)
    for keys in ([], ["k"]):
        got = qt.quantiles(skewed, ["v", "i"], [0.25, 0.5], keys, limit=5)
        want = qt.quantiles(skewed, ["v", "i"], [0.25, 0.5], keys)
        by = [*keys, "column", "q"]
        a = [(*[r[c] for c in by], round(r.value, 9)) for r in got.orderBy(*by).collect()]
        assert a == [(*[r[c] for c in by], round(r.value, 9)) for r in want.orderBy(*by).collect()]


def test_wrong_brackets_are_redone(skewed, monkeypatch):
    """A rough look that points to the wrong values costs a second pass, not the result."""
    wrong = rows_with_probe(skewed, [[-2.0, -1.0], [1e9, 2e9]])
    monkeypatch.setattr(qt, "_brackets", lambda *args: wrong)
    rows = skewed.where("v is not null")
    got = qt.quantiles(rows, ["v"], [0.25, 0.5], ["k"], limit=5)
    want = qt.quantiles(rows, ["v"], [0.25, 0.5], ["k"])
    by = ["k", "q"]
    a = [(r.k, r.q, round(r.value, 9)) for r in got.orderBy(*by).collect()]
    assert a == [(r.k, r.q, round(r.value, 9)) for r in want.orderBy(*by).collect()]


def test_column_without_values(spark):
    df = spark.range(50).select("id", F.lit(None).cast("double").alias("empty"))
    for limit in (5, 1000):
        got = {r["column"]: r.value for r in qt.quantiles(df, ["id", "empty"], [0.5], limit=limit).collect()}
        assert got == {"id": 24.5, "empty": None}


def test_salted_join_equals_broadcast(skewed):
    stats = skewed.groupBy("k").agg(F.count("*").alias("n"))
    small = scale.join_sized(skewed, stats, ["k"])
    salted = scale.join_sized(skewed.repartition(9), stats, ["k"], limit=1)
    assert "_salt" not in salted.columns
    assert sorted(map(str, small.select("i", "n").collect())) == sorted(map(str, salted.select("i", "n").collect()))


def test_sample_is_exact_and_stable(skewed):
    want = sorted(r.i for r in topk.sample_n(skewed, 100, ["i"], 42).collect())
    assert len(set(want)) == 100
    for parts in (1, 2, 7):
        assert sorted(r.i for r in topk.sample_n(skewed.repartition(parts), 100, ["i"], 42).collect()) == want
    assert sorted(r.i for r in topk.sample_n(skewed, 100, ["i"], 43).collect()) != want
    assert topk.sample_n(skewed, 10**6, ["i"], 42).count() == 3000
    # Copies of one key share a hash; the sample is still of the asked size.
    assert topk.sample_n(skewed.withColumn("c", F.lit(1)), 100, ["c"], 42).count() == 100


def test_split_is_exact_and_stable(skewed):
    for n, share in ((3000, 0.2), (2999, 0.2), (7, 0.5), (1, 0.2)):
        rows = skewed.where(F.col("i") < n)
        tests = with_split(rows, ["i"], share).where("is_test")
        assert tests.count() == int(np.ceil(share * n))
    want = sorted(r.i for r in with_split(skewed, ["i"]).where("is_test").collect())
    again = with_split(skewed.repartition(7), ["i"]).where("is_test")
    assert sorted(r.i for r in again.collect()) == want
    assert hash_threshold(skewed, ["i"], 3000, 42) < 2**60


def test_ties_follow_the_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "k string, n int")
    assert [r.k for r in topk.top_k(df, 2, "n", ["k"]).collect()] == ["c", "a"]
