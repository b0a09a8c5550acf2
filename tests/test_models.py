"""Model frame, split, fits and scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routestats.operators import evaluate as ev
from routestats.operators import models as ml
from routestats.plans import fare_model as fm
from routestats.plans.schemas import ROUTE_KEYS
from routestats.session import scratch_path
from routestats.sources.tables import matrix_wide


def predicted(model, df, name):
    return np.array([r[0] for r in model.transform(df).orderBy("i").select(name).collect()])


@pytest.fixture(scope="module")
def surface(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 3)) * [1, 50, 0.01] + [0, 1000, 0]
    y = 3 + 2 * x[:, 0] - 0.1 * x[:, 1] + 40 * x[:, 2] + rng.normal(size=800)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double")
    df = df.withColumns({"a2": F.col("a"), "a3": F.col("a"), "flat": F.lit(2.2)})
    return df.cache(), x, y


@pytest.mark.parametrize("extra", [[], ["a2", "a3", "flat"]], ids=["full rank", "singular"])
def test_least_squares_predictions(surface, extra):
    df, x, y = surface
    model = ml.fit_ols(df, ["a", "b", "c", *extra], "y", "p")
    design = np.column_stack([np.ones(len(x)), x])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert predicted(model, df, "p") == pytest.approx(want, abs=1e-5)


def test_pca_regression(surface):
    df, x, y = surface
    features = ["a", "b", "c", "a2", "a3", "flat"]
    model = ml.fit_pca_regression(df, features, "y", "p")
    # Three copies, two others, one constant: shares 3/5, 1/5, 1/5, so all three count for 95 %.
    assert model.stages[3].getIndices() == [0, 1, 2]
    ols = ml.fit_ols(df, ["a", "b", "c"], "y", "q")
    assert predicted(model, df, "p") == pytest.approx(predicted(ols, df, "q"), abs=1e-5)
    two = ml.fit_pca_regression(df, features, "y", "p", variance=0.5)
    assert two.stages[3].getIndices() == [0]


def test_boosting_beats_a_line_on_a_curve(spark):
    df = spark.range(600).select(
        F.col("id").cast("int").alias("i"), ((F.col("id") % 100) / 10).alias("a"), (F.col("id") / 600).alias("b")
    )
    df = df.withColumn("y", F.sin("a") * 10 + F.col("b")).cache()
    models = {"linear": ml.fit_ols(df, ["a", "b"], "y", "pred_linear")}
    models["boosted"] = ml.fit_gbt(df, ["a", "b"], "y", "pred_boosted", trees=20, rate=0.3)
    wide = ml.prediction_table(models, df, ["i"], ["a", "b"], "y")
    scores = ev.evaluate(wide, "actual_y", {m: f"pred_{m}" for m in models}).collect()
    assert [s.model for s in scores] == ["boosted", "linear"] and scores[0].RMSE < scores[1].RMSE / 3


def test_boosting_deals_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("a"))
    df = df.withColumn("y", F.col("a") * F.col("a") + (F.col("i") % 2))
    whole = ml.fit_gbt(df, ["a"], "y", "p", trees=3, depth=2)
    held = []
    fit = ml.GBTRegressor.fit
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, rows: (held.append(rows), fit(self, rows))[1])
    monkeypatch.setattr(ml, "_TASK_ROWS", 500, raising=False)
    parts = ml.fit_gbt(df, ["a"], "y", "p", trees=3, depth=2)
    sizes = [r["count"] for r in held[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 600
    assert predicted(parts, df, "p") == pytest.approx(predicted(whole, df, "p"), abs=1e-9)
    assert ml._in_small_parts(df.limit(0)).count() == 0


def test_scores(frame):
    df = frame("y double, p double", (1.0, 2.0), (2.0, 2.0), (4.0, 1.0))
    r = ev.metrics(df, "y", "p").first()
    assert r.RMSE == pytest.approx(np.sqrt(10 / 3)) and r.MAPE == pytest.approx((1 + 0 + 0.75) / 3)
    assert r.R2 == pytest.approx(1 - 10 / (14 / 3))
    constant = frame("y double, p double, q double", (2.0, 2.0, 1.0), (2.0, 2.0, 2.0))
    assert ev.metrics(constant, "y", "p").first().R2 == 1.0 and ev.metrics(constant, "y", "q").first().R2 == 0.0
    assert ev.metrics(frame("y double, p double", (0.0, 1.0)), "y", "p").first().MAPE > 1e15


ANALYSIS = (
    "YEAR int, QUARTER int, ORIGIN string, DEST string, avg_fare double, passengers_db1b double,"
    "market_distance double, avg_fuel_price double, load_factor double, is_saturated int"
)


def test_model_frame(frame):
    rows = [
        (2024, 4, "A", "B", 100.0, 10.0, 300.0, 2.0, 0.5, 0),
        (2025, 1, "A", "B", 110.0, 12.0, 300.0, None, 0.7, 0),
        (2025, 3, "A", "B", 120.0, 14.0, None, 2.4, 0.9, 1),  # a gap: rows count, not quarters
        (2025, 1, "A", "C", 90.0, 3.0, 500.0, 2.2, None, 0),  # a route with one quarter, nothing known
        (2025, 2, "C", "B", None, 3.0, 500.0, 2.2, 0.4, None),  # no target: left out at the end
    ]
    out = {(r.YEAR, r.QUARTER, r.route): r for r in fm.build_model_frame(frame(ANALYSIS, *rows)).collect()}
    assert set(out) == {(2024, 4, "A-B"), (2025, 1, "A-B"), (2025, 3, "A-B"), (2025, 1, "A-C")}
    first, second, third = (out[k] for k in [(2024, 4, "A-B"), (2025, 1, "A-B"), (2025, 3, "A-B")])
    assert [r.lag_load_factor for r in (first, second, third)] == [0.5, 0.5, 0.7]
    assert [r.rolling_load_factor_2 for r in (first, second, third)] == pytest.approx([0.5, 0.6, 0.8])
    assert [r.route_avg_load_factor for r in (first, second, third)] == pytest.approx([0.7] * 3)
    # Medians over all rows, the one without a target included.
    assert second.avg_fuel_price == pytest.approx(2.2) and third.market_distance == 400.0
    gap = out[2025, 1, "A-C"]
    assert gap.load_factor == pytest.approx(0.6) and gap.route_avg_load_factor == pytest.approx(0.7)
    with pytest.raises(ValueError, match="avg_fuel_price"):
        fm.build_model_frame(frame(ANALYSIS, *rows).drop("avg_fuel_price"))


def analysis_rows(quarters):
    rng = np.random.default_rng(11)
    for a in range(20):
        for b in range(20):
            for q in range(quarters):
                lf, dist = float(rng.uniform(0.4, 1)), float(100 + 37 * a + 11 * b)
                fare = 80 + 0.2 * dist + 60 * lf + float(rng.normal())
                yield 2025, q + 1, f"A{a:02d}", f"B{b:02d}", fare, float(rng.integers(1, 900)), dist, 2.2, lf, int(lf >= 0.8)


def by_hand(train, test, features, components):
    """Least squares on the leading components that explain over 95 %, in numpy."""
    x, y = train[features].to_numpy(float), train.avg_fare.to_numpy()
    std = x.std(axis=0)
    shift, scale = x.mean(axis=0), np.where(std > 1e-12, std, np.inf)
    z, zt = (x - shift) / scale, (test[features].to_numpy(float) - shift) / scale
    values, vectors = np.linalg.eigh(np.cov(z.T))
    share = np.cumsum(values[::-1] / values.sum())
    kept = vectors[:, ::-1][:, : int(np.argmax(share > 0.95)) + 1] if components else vectors
    fit = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z @ kept]), y, rcond=1e-10)[0]
    return np.column_stack([np.ones(len(zt)), zt @ kept]) @ fit


def test_one_quarter_run(spark):
    """With a single quarter the lag, rolling and mean columns all equal the load factor, and the
    fuel price is constant."""
    results = fm.run_modeling(
        spark.createDataFrame(list(analysis_rows(1)), ANALYSIS),
        models={k: ml.MODELS[k] for k in ("linear_regression", "pca_regression")},
        save_to=(out := scratch_path(spark, "run")),
    )
    assert results.test.count() == 80 and results.train.count() == 320
    assert results.train.join(results.test, ROUTE_KEYS).count() == 0
    scores = fm.evaluate_results(results, f"{out}/evaluation").collect()
    assert scores[0].RMSE <= scores[1].RMSE and scores[1].R2 > 0.95
    train, test = results.train.toPandas(), results.predictions.orderBy(*ROUTE_KEYS).toPandas()
    for name in ("linear_regression", "pca_regression"):
        want = by_hand(train, test, results.features, components=name == "pca_regression")
        assert test[f"pred_{name}"].to_numpy() == pytest.approx(want, abs=1e-4), name
    wide = {r.x: r for r in matrix_wide(results.correlation, [*results.features, "avg_fare"]).collect()}
    assert list(wide) == [*results.features, "avg_fare"]
    assert wide["avg_fuel_price"].avg_fuel_price is None and wide["load_factor"].avg_fuel_price is None
    assert wide["load_factor"].lag_load_factor == pytest.approx(1.0)
    # A stored model predicts the same, without a fit.
    again = fm.predict_fares(results.test.select(*ROUTE_KEYS, *results.features), model_path=f"{out}/models")
    both = again.join(results.predictions, [*ROUTE_KEYS, *results.features])
    assert both.count() == 80
    assert both.where(F.abs(F.col("predicted_avg_fare") - F.col("pred_linear_regression")) > 1e-9).count() == 0


def test_medians_from_training_rows_only(spark):
    df = spark.createDataFrame(list(analysis_rows(1)), ANALYSIS).withColumn(
        "market_distance", F.when(F.col("DEST") != "B00", F.col("market_distance"))
    )
    train = fm.with_route_features(df.where("ORIGIN < 'A05'"))
    out = fm.build_model_frame(df, fit_on=train).where("DEST = 'B00'").select("market_distance").distinct().collect()
    want = np.median([100 + 37 * a + 11 * b for a in range(5) for b in range(1, 20)])
    assert [r[0] for r in out] == [want]


def test_report_tables(spark):
    assert fm.report_tables(spark, scratch_path(spark, "none")) is None


def test_triangles_keep_the_digits_of_nearly_equal_features(spark):
    random = np.random.default_rng(2)
    x = random.standard_normal((4000, 3)) * 50 + 300
    x = np.column_stack([x, x[:, 0] + 1e-4 * random.standard_normal(4000), x[:, 1], np.full(4000, 7.0)])
    y = x[:, :4] @ [1.0, -2.0, 0.5, 3.0] + random.standard_normal(4000)
    names = [f"f{i}" for i in range(6)]
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["i", *names, "y"])
    full = np.column_stack([np.ones(4000), x[:, :4]])
    want = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    for parts in (1, 9, 100):
        model = ml.fit_ols(df.repartition(parts), names, "y", "p")
        got = [r.p for r in model.transform(df).orderBy("i").collect()]
        assert np.abs(np.array(got) - want).max() < 1e-8
        assert model.stages[-1].coefficients[4] == model.stages[-1].coefficients[5] == 0
    factor = ml.triangular_factor(df, [*names, "y"])
    table = np.column_stack([x, y])
    assert np.allclose(factor.T @ factor, table.T @ table, rtol=1e-12) and np.allclose(factor, np.triu(factor))


def test_least_squares_without_rows(spark):
    df = spark.createDataFrame([], "a double, y double")
    assert ml.fit_ols(df, ["a"], "y", "p").stages[-1].coefficients.tolist() == [0.0]
