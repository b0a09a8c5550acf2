"""Correlations, bins, boxes, densities and samples against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from routestats.operators import distribution as dist
from routestats.operators.profile import describe_exact
from routestats.operators.scale import join_sized
from routestats.operators import quantiles as qt


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 1500
    df = pd.DataFrame({"i": np.arange(n), "a": rng.normal(1e6, 2, n), "b": rng.lognormal(1, 1, n)})
    df["c"] = df.a * 3 - 1
    df["const"] = 0.1
    df["gappy"] = df.b.where(df.i % 3 != 0)
    df["rare"] = df.b.where(df.i % 500 == 1)
    df["only_one"] = df.b.where(df.i == 7)
    df["empty"] = np.nan
    # Constant wherever "rare" has a value, but not elsewhere.
    df["step"] = (df.i % 500 != 1).astype(float)
    df["k"] = np.where(df.i % 3 == 0, "hot", np.where(df.i == 1, "single", "k" + (df.i % 5).astype(str)))
    return df


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    return spark.createDataFrame(pdf).select(
        "i", "k", *[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns if c not in ("i", "k")]
    ).repartition(5).cache()


def test_correlation_of_every_pair(pdf, sdf):
    cols = ["a", "b", "c", "const", "gappy", "rare", "only_one", "empty", "step"]
    want = pdf[cols].corr()
    got = {(r.x, r.y): r["corr"] for r in dist.corr_matrix(sdf, cols).collect()}
    assert len(got) == 81
    for (x, y), r in got.items():
        # pandas has rounding noise where numpy's definition has a constant; those are missing here.
        both = pdf[[x]].join(pdf[[y]], rsuffix="_").dropna()
        if both.nunique().min() <= 1 or both.empty:
            assert r is None, (x, y)
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-9), (x, y)


def test_correlation_far_from_zero_in_any_order(spark):
    random = np.random.default_rng(4)
    x = 1e9 + random.standard_normal(60_000)
    pdf = pd.DataFrame({"x": x, "y": x + random.standard_normal(60_000), "late": x})
    pdf.loc[:20_000, "late"] = np.nan
    pdf.loc[::7, "y"] = np.nan
    want = pdf.sub(1e9).corr()
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])
    for parts in (1, 3, 200):
        for row in dist.corr_matrix(df.repartition(parts), list(pdf.columns)).collect():
            assert row["corr"] == pytest.approx(want.loc[row.x, row.y], abs=1e-6), (parts, row)
    infinite = dist.corr_matrix(df.withColumn("y", F.lit(float("inf")) * F.col("x")), ["x", "y"])
    assert {(r.x, r.y) for r in infinite.where("corr is not null").collect()} == {("x", "x")}


def test_correlation_without_rows(sdf):
    got = dist.corr_matrix(sdf.where("i < 0"), ["a", "b"]).collect()
    assert len(got) == 4 and all(r["corr"] is None for r in got)


def test_lower_triangle(sdf):
    got = {(r.x, r.y) for r in dist.lower_triangle(dist.corr_matrix(sdf, ["b", "a"]), ["b", "a"]).collect()}
    assert got == {("b", "b"), ("a", "b"), ("a", "a")}


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_histogram_equals_numpy(pdf, sdf, bins):
    for col in ("a", "b", "gappy", "i"):
        counts, edges = np.histogram(pdf[col].dropna(), bins=bins)
        rows = dist.histogram(sdf, col, bins).orderBy("bin").collect()
        assert [r.n for r in rows] == counts.tolist()
        assert [r.edge_lo for r in rows] + [rows[-1].edge_hi] == pytest.approx(edges.tolist(), rel=1e-12)


def test_histogram_edges(frame):
    def counts(*v, **kw):
        return [r.n for r in dist.histogram(frame("v double", *[(x,) for x in v]), "v", 4, **kw).orderBy("bin").collect()]

    assert counts(0.0, 1.0, 2.0, 3.0, 4.0) == [1, 1, 1, 2]
    assert counts(5.0, 5.0) == np.histogram([5.0, 5.0], 4)[0].tolist()
    assert counts(0.0, 8.0, 8.0, None) == [1, 0, 0, 2]
    assert counts(-1.0, 0.5, 9.0, 10.0, lo=0, hi=10) == [1, 0, 0, 2]
    assert counts(None) == [0, 0, 0, 0]


def test_histogram_per_key(pdf, sdf):
    rows = dist.histogram(sdf, "b", 6, keys=["k"]).collect()
    for key, part in pdf.groupby("k"):
        got = [r.n for r in sorted(rows, key=lambda r: r.bin) if r.k == key]
        assert got == np.histogram(part.b, 6)[0].tolist(), key


def whiskers(x):
    q1, m, q3 = np.percentile(x, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return [len(x), q1, m, q3, min(x[x >= lo].min(), q1), max(x[x <= hi].max(), q3)]


@pytest.mark.parametrize("limit", [10**6, 20])
def test_box_stats(pdf, sdf, monkeypatch, limit):
    monkeypatch.setattr(qt.quantile_arrays, "__defaults__", ((), limit))
    rows = {(r.k, r["column"]): list(r)[2:] for r in dist.box_stats(sdf, "k", ["b", "gappy"]).collect()}
    for key, part in pdf.groupby("k"):
        for col in ("b", "gappy"):
            if part[col].notna().any():
                assert rows[key, col] == pytest.approx(whiskers(part[col].dropna().to_numpy()))
    whole = {r["column"]: list(r)[1:] for r in dist.box_stats(sdf, None, ["b", "a"]).collect()}
    assert whole["b"] == pytest.approx(whiskers(pdf.b.to_numpy()))


def test_density(pdf, sdf):
    rows = dist.kde(sdf, "k", "b", grid=100).toPandas()
    assert "single" not in set(rows.k)
    for key, part in rows.groupby("k"):
        x = pdf.b[pdf.k == key].to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        part = part.sort_values("point")
        grid = np.linspace(x.min(), x.max(), 100)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert part.x.to_numpy() == pytest.approx(grid) and part.density.to_numpy() == pytest.approx(want)


def test_density_of_all_classes_integrates_to_one(sdf):
    rows = dist.kde(sdf, "k", "a", grid=200, cut=3.0, common_norm=True).toPandas().sort_values("point")
    area = sum(np.trapezoid(p.density, p.x) for _, p in rows.groupby("k"))
    assert 0.98 < area <= 1.0  # one row, the single key, has no density


def test_automatic_bins(pdf, sdf):
    want = {c: len(np.histogram_bin_edges(pdf[c], bins="auto")) - 1 for c in ("a", "b", "const")}
    assert dist.auto_bins(sdf, ["a", "b", "const"]) == want


def test_pair_marginals(pdf, sdf):
    sample = dist.pair_data(sdf, ["a", "b"], 400, ["i"])
    assert sample.count() == 400
    rows = dist.pair_marginals(sample, ["a", "b"]).toPandas()
    assert rows.groupby("column").n.sum().to_dict() == {"a": 400, "b": 400}


def test_scatter(sdf):
    rows = dist.scatter_data(sdf, "a", "b", 200, ["i"]).toPandas()
    assert len(rows) == 200 and rows.diag_lo.nunique() == 1
    assert rows.diag_lo[0] == rows[["a", "b"]].min().min() and rows.diag_hi[0] == rows[["a", "b"]].max().max()


def test_describe(pdf, sdf):
    rows = {r["column"]: r for r in describe_exact(sdf, ["b", "gappy", "empty", "only_one"]).collect()}
    for c in ("b", "gappy"):
        want = pdf[c].describe().tolist()
        r = rows[c]
        assert [r["count"], r["mean"], r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]] == pytest.approx(want)
    assert rows["empty"]["count"] == 0 and rows["empty"]["mean"] is None and rows["only_one"]["std"] is None


def test_join_sides_of_any_size_keep_unmatched_rows(sdf):
    some = sdf.groupBy("k").agg(F.count("*").alias("n")).where("k != 'hot'")
    for limit in (1, 1000):
        assert join_sized(sdf, some, ["k"], limit=limit).where("n is null").count() == 500
