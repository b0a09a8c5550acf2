"""Golden values of the fuel series (Q04, Q47-Q51, AGG03)."""

import datetime

import pytest
from fuel_prices import PRICES
from pyspark.sql import functions as F

from routestats.operators.aggregate import rollup_calendar
from routestats.operators.profile import describe_exact, missing_counts
from routestats.operators.scale import over_ordered
from routestats.plans import cleaning, eda_fuel
from routestats.plans.schemas import FUEL, RAW_FILES
from routestats.session import scratch_path


@pytest.fixture(scope="module")
def raw(spark):
    """The price file as published: text, a blank where there is no price, written out of order."""
    rows = [(d, "" if p is None else str(p)) for d, p in PRICES.items()]
    before_and_after = [("2024-12-31", "2.1"), ("2025-04-01", "2.2")]
    root = scratch_path(spark, "fuel")
    df = spark.createDataFrame(rows + before_and_after, FUEL).repartition(3)
    df.write.option("header", "true").csv(f"{root}/{RAW_FILES['fuel']}")
    return cleaning.read_raw(spark, root, "fuel")


@pytest.fixture(scope="module")
def prices(raw):
    return eda_fuel.price_frame(cleaning.clean_fuel(raw)).cache()


def test_cleaned_rows(prices):
    got = {str(r.observation_date): r.price for r in prices.collect()}
    assert got == PRICES
    assert {r["column"]: r.missing for r in missing_counts(prices).collect()} == {"observation_date": 0, "price": 3}


def test_describe(prices):
    r = describe_exact(prices, ["price"]).first()
    want = [60, 2.2231333333333323, 0.13232157371364844, 1.997, 2.0905, 2.2705, 2.31875, 2.463]
    got = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
    assert got == pytest.approx(want, abs=1e-12)


def test_quarter_mean(prices):
    r = rollup_calendar(prices, "observation_date", {"avg_fuel_price": F.avg("price")}).collect()
    assert [(x.YEAR, x.QUARTER) for x in r] == [(2025, 1)]
    assert r[0].avg_fuel_price == pytest.approx(2.2231333333333323, abs=1e-12)


@pytest.mark.parametrize("group_rows", [None, 10**9], ids=["one window", "blocks"])
def test_changes(prices, group_rows):
    changed = eda_fuel.with_change(prices)
    if group_rows:
        changed = over_ordered(
            prices, [], ["observation_date"], 1,
            lambda w: {"price_change": F.col("price") - F.lag("price", 1).over(w)}, limit=5,
        )
    r = describe_exact(changed, ["price_change"]).first()
    got = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
    want = [56, -0.004089285714285724, 0.037767844324703856, -0.092, -0.027, -0.0035, 0.01725, 0.098]
    assert got == pytest.approx(want, abs=1e-12)


def test_change_counts_and_bars(prices):
    assert eda_fuel.change_counts(prices).first().asDict() == {"up": 26, "down": 30, "unchanged": 0}
    bars = eda_fuel.change_bars(prices).collect()
    assert len(bars) == 63 and bars[0].price_change == 0.0 and bars[0].sign == "up"
    assert sum(b.sign == "down" for b in bars) == 30


def test_rolling(prices):
    rows = [r for r in eda_fuel.rolling(prices).collect() if r.rolling_7d is not None]
    assert len(rows) == 37
    got = [(str(r.observation_date), r.rolling_7d) for r in (rows[0], rows[1], rows[-1])]
    want = [("2025-01-29", 2.353857142857143), ("2025-01-30", 2.335857142857143), ("2025-03-31", 2.1081428571428575)]
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-12)


def test_weekly(prices):
    rows = eda_fuel.weekly_mean(prices).collect()
    want = [2.269, 2.317, 2.4124, 2.3815, 2.3076, 2.305, 2.2946, 2.304, 2.1604, 2.0774, 2.0162, 2.0594, 2.108, 2.135]
    assert [r.week for r in rows] == list(range(1, 15))
    assert [r.mean_price for r in rows] == pytest.approx(want, abs=1e-12)


def test_histogram(prices):
    rows = eda_fuel.price_histogram(prices).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 4, 2, 6, 3, 4, 1, 2, 0, 1, 0, 7, 7, 5, 2, 6, 2, 2, 2, 1]
    assert rows[0].edge_lo == 1.997 and rows[-1].edge_hi == 2.463


def test_series(prices):
    rows = eda_fuel.price_series(prices).collect()
    assert len(rows) == 60 and rows[0].observation_date == datetime.date(2025, 1, 2)
    assert rows[7].mean_line == pytest.approx(2.2231333333333323, abs=1e-12)
