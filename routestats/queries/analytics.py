"""Queries for the named analyses Q10-Q52."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.plans import eda_capacity as ec
from routestats.plans import eda_delays as ed
from routestats.plans import eda_fares as ef
from routestats.plans import eda_flights as el
from routestats.plans import eda_fuel as eu
from routestats.plans import profiles
from routestats.plans.schemas import AIRPORT_STATE, DAY_ORDER
from routestats.queries.registry import add
from routestats.queries.relational import hash_order
from routestats.queries.statistics import (
    BOX_DOUBLES,
    DESCRIBE_DOUBLES,
    auto_hist_sql,
    box_sql,
    corr_sql,
    describe_sql,
    hist_sql,
    kde_sql,
)
from routestats.queries.tables import LINE_KEY, capacity, delays, fares, flights, fuel, sql

_KEY_SQL = ", ".join(LINE_KEY)
_SAMPLE = f"ORDER BY {hash_order(LINE_KEY)}, {_KEY_SQL}"
_EDGES = "edge_lo edge_hi"


def on(source, plan, *args):
    """A query that runs ``plan`` on one derived table."""
    return lambda s, d: plan(source(s, d), *args)


# --- delay causes -------------------------------------------------------------------------------------

_LABELS = ", ".join(f"'{v}'" for v in ed.CAUSES.values())
_SUMS = ", ".join(f"coalesce(sum({c}), 0)" for c in ed.CAUSES)
add(
    "q10_cause_totals",
    on(delays, ed.cause_totals),
    sql(
        f"""SELECT cause, total_minutes, total_minutes / sum(total_minutes) OVER () * 100 AS share_pct FROM
          (SELECT unnest([{_LABELS}]) AS cause, unnest([{_SUMS}]) AS total_minutes FROM delays)"""
    ),
    "total_minutes share_pct",
    digits=2,
)
_RATE = """sum(arr_flights) AS total_flights, sum(arr_del15) AS total_delayed,
    sum(arr_del15) / sum(arr_flights) * 100 AS delay_rate"""
add(
    "q11_rate_by_carrier",
    on(delays, ed.rate_by_carrier),
    sql(f"SELECT carrier_name, {_RATE} FROM delays GROUP BY 1 HAVING sum(arr_flights) > 0"),
    "total_flights total_delayed delay_rate",
)
for name, plan, key, col, k in (
    ("q12_airports_by_delay", ed.airports_by_delay, "airport_name", "arr_delay", 15),
    ("q13_carriers_by_cancellations", ed.carriers_by_cancellations, "carrier_name", "arr_cancelled", 15),
    ("q18_airports_by_diversions", ed.airports_by_diversions, "airport_name", "arr_diverted", 10),
):
    add(
        name,
        on(delays, plan),
        sql(
            f"""SELECT {key}, total AS {col} FROM (SELECT {key}, coalesce(sum({col}), 0) AS total FROM delays GROUP BY 1)
            ORDER BY total DESC, {key} LIMIT {k}"""
        ),
        col,
        digits=2,
    )
add(
    "q14_rate_by_month",
    on(delays, ed.rate_by_month),
    sql(f"SELECT month, {_RATE}, 'Month ' || month AS month_label FROM delays GROUP BY month HAVING sum(arr_flights) > 0"),
    "total_flights total_delayed delay_rate",
)
add("q15_delay_correlations", on(delays, ed.correlations), sql(corr_sql("delays", ed.CORRELATED)), "corr")
add(
    "q15_delay_correlations_lower",
    on(delays, ed.correlations_lower),
    sql(corr_sql("delays", ed.CORRELATED, lower=True)),
    "corr",
)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ed.PAIRED)
add(
    "q16_delay_pair_sample",
    on(delays, ed.pair_sample, LINE_KEY),
    sql(f"SELECT {', '.join(ed.PAIRED)} FROM delays WHERE {_COMPLETE} {_SAMPLE} LIMIT 3000"),
    " ".join(ed.PAIRED),
)
_DELAY_SAMPLE = f"(SELECT {', '.join(ed.PAIRED)} FROM delays WHERE {_COMPLETE} {_SAMPLE} LIMIT 3000)"
add(
    "q16_delay_pair_histograms",
    on(delays, ed.pair_histograms, LINE_KEY),
    sql(auto_hist_sql(_DELAY_SAMPLE, ed.PAIRED)),
    _EDGES,
)
_TOP6 = """(SELECT * FROM delays WHERE carrier_name IN
    (SELECT carrier_name FROM delays GROUP BY 1 ORDER BY sum(arr_flights) DESC, carrier_name LIMIT 6))"""
add("q17_boxes_by_carrier", on(delays, ed.boxes_by_carrier), sql(box_sql(_TOP6, "carrier_name", ed.BOXED)), BOX_DOUBLES)

# --- flights ------------------------------------------------------------------------------------------

_FLOWN = "(SELECT * FROM flights WHERE Cancelled = 0)"


def top_codes(k: int) -> str:
    return f"SELECT Carrier FROM flights GROUP BY 1 ORDER BY count(*) DESC, Carrier LIMIT {k}"


def counts_sql(source: str, key: str, k: int) -> str:
    return f"SELECT {key}, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {key} LIMIT {k}"


add(
    "q19_delay_histogram",
    on(flights, el.delay_histogram),
    sql(hist_sql("(SELECT * FROM flights WHERE Cancelled = 0 AND Delay BETWEEN -60 AND 300)", "Delay", 80)),
    _EDGES,
)
add("q19_delay_mean", on(flights, el.delay_mean), sql(f"SELECT avg(Delay) AS mean_delay FROM {_FLOWN}"), "mean_delay")
add("q19_delay_describe", on(flights, el.delay_describe), sql(describe_sql(_FLOWN, ["Delay"])), DESCRIBE_DOUBLES)
add("q20_top_airlines", on(flights, el.top_airlines), sql(counts_sql("flights", '"Airline Name"', 15)))
add(
    "q21_mean_delay_by_airline",
    on(flights, el.mean_delay_by_airline),
    sql(f'SELECT "Airline Name", avg(Delay) AS mean_delay FROM flights WHERE Carrier IN ({top_codes(15)}) GROUP BY 1'),
    "mean_delay",
)
add(
    "q22_cancellation_by_airline",
    on(flights, el.cancellation_rate_by_airline),
    sql(
        f"""SELECT "Airline Name", avg(Cancelled) * 100 AS cancel_rate FROM flights
        WHERE Carrier IN ({top_codes(15)}) GROUP BY 1"""
    ),
    "cancel_rate",
)
add(
    "q23_daily_volume",
    on(flights, el.daily_volume),
    sql('SELECT "Date", n, avg(n) OVER () AS mean_n FROM (SELECT "Date", count(*) AS n FROM flights GROUP BY 1)'),
    "mean_n",
    dates="Date",
)
add(
    "q24_top_routes",
    on(flights, el.top_routes),
    sql(counts_sql("(SELECT Origin || ' to ' || Dest AS Route FROM flights)", "Route", 15)),
)


def weekdays_sql(inner: str) -> str:
    return f"""SELECT (position - 1)::INT AS position, * EXCLUDE (position) FROM
      (SELECT unnest({DAY_ORDER}) AS DayOfWeek, unnest(range(1, 8)) AS position) LEFT JOIN ({inner}) USING (DayOfWeek)"""


_BY_DAY = """(SELECT *, dayname("Date") AS DayOfWeek FROM flights WHERE Cancelled = 0)"""
add(
    "q25_delay_by_weekday",
    on(flights, el.mean_delay_by_weekday),
    sql(weekdays_sql('SELECT dayname("Date") AS DayOfWeek, avg(Delay) AS mean_delay FROM flights GROUP BY 1')),
    "mean_delay",
)
add(
    "q26_delay_by_hour",
    on(flights, el.mean_delay_by_hour),
    sql(
        """SELECT (Dep_Time::INT // 100)::INT AS DepHour, avg(Delay) AS mean_delay FROM flights
           WHERE Dep_Time IS NOT NULL GROUP BY 1"""
    ),
    "mean_delay",
)
add(
    "q27_boxes_by_airline",
    on(flights, el.boxes_by_airline),
    sql(box_sql(f"(SELECT * FROM flights WHERE Cancelled = 0 AND Carrier IN ({top_codes(8)}))", '"Airline Name"', ["Delay"])),
    BOX_DOUBLES,
)
add(
    "q28_boxes_by_weekday",
    on(flights, el.boxes_by_weekday),
    sql(weekdays_sql(box_sql(_BY_DAY, "DayOfWeek", ["Delay"]))),
    BOX_DOUBLES,
)
add(
    "q28_density_by_weekday",
    on(flights, el.density_by_weekday),
    sql(kde_sql(_BY_DAY, "DayOfWeek", "Delay")),
    "x density",
    digits=6,
)
add("q29_top_origins", on(flights, el.top_origins), sql(counts_sql("flights", "Origin", 15)))

# --- capacity -----------------------------------------------------------------------------------------

add(
    "q30_load_factor",
    lambda s, d: ec.active_segments(capacity(s, d)).select("ORIGIN", "DEST", "YEAR", "QUARTER", "SEATS", "LOAD_FACTOR"),
    sql("SELECT ORIGIN, DEST, YEAR, QUARTER, SEATS, LOAD_FACTOR FROM active"),
    "SEATS LOAD_FACTOR",
)
add(
    "q30_seat_counts",
    on(capacity, ec.seat_counts),
    sql(
        """SELECT count(*) FILTER (WHERE SEATS > 0) AS active, count(*) FILTER (WHERE SEATS = 0) AS zero_seats,
             count(*) AS segments FROM capacity"""
    ),
)
add("q30_load_factor_histogram", on(capacity, ec.load_factor_histogram), sql(hist_sql("active", "LOAD_FACTOR", 50)), _EDGES)
add(
    "q30_load_factor_describe",
    on(capacity, ec.load_factor_describe),
    sql(describe_sql("active", ["LOAD_FACTOR"])),
    DESCRIBE_DOUBLES,
)
for col in ("PASSENGERS", "SEATS"):
    clipped = f"(SELECT * FROM active WHERE {col} < (SELECT quantile_cont({col}, 0.99) FROM active))"
    add(
        f"q31_{col.lower()}_histogram",
        on(capacity, ec.clipped_histogram, col),
        sql(hist_sql(clipped, col, 50)),
        _EDGES,
    )
add(
    "q32_top_routes",
    on(capacity, ec.top_routes),
    sql("SELECT Route, sum(PASSENGERS) AS total_pax FROM active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "total_pax",
)
add(
    "q33_busiest_route_load",
    on(capacity, ec.busiest_route_load),
    sql(
        """SELECT Route, avg(LOAD_FACTOR) AS avg_lf, sum(PASSENGERS) AS total_pax, 0.8::DOUBLE AS threshold
           FROM active GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15"""
    ),
    "avg_lf total_pax threshold",
)
add(
    "q34_top_origins",
    on(capacity, ec.top_origins),
    sql("SELECT ORIGIN, sum(DEPARTURES_PERFORMED) AS departures FROM active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "departures",
)
add(
    "q35_seats_scatter",
    on(capacity, ec.seats_scatter, LINE_KEY),
    sql(
        f"""SELECT SEATS, PASSENGERS, 0.0::DOUBLE AS diag_lo,
          greatest(max(SEATS) OVER (), max(PASSENGERS) OVER ()) AS diag_hi FROM
          (SELECT SEATS, PASSENGERS FROM active {_SAMPLE} LIMIT 5000)"""
    ),
    "SEATS PASSENGERS diag_lo diag_hi",
)
add("q36_capacity_correlations", on(capacity, ec.correlations), sql(corr_sql("active", ec.MEASURES)), "corr")
add(
    "q36_capacity_correlations_lower",
    on(capacity, ec.correlations_lower),
    sql(corr_sql("active", ec.MEASURES, lower=True)),
    "corr",
)
add(
    "q37_capacity_pair_sample",
    on(capacity, ec.pair_sample, LINE_KEY),
    sql(f"SELECT {', '.join(ec.MEASURES)} FROM active {_SAMPLE} LIMIT 3000"),
    " ".join(ec.MEASURES),
)
_CAPACITY_SAMPLE = f"(SELECT {', '.join(ec.MEASURES)} FROM active {_SAMPLE} LIMIT 3000)"
add(
    "q37_capacity_pair_histograms",
    on(capacity, ec.pair_histograms, LINE_KEY),
    sql(auto_hist_sql(_CAPACITY_SAMPLE, ec.MEASURES)),
    _EDGES,
)
add("q37_capacity_boxes", on(capacity, ec.boxes), sql(box_sql("active", None, ec.MEASURES)), BOX_DOUBLES)

# --- fares --------------------------------------------------------------------------------------------

add("q38_fare_histogram", on(fares, ef.fare_histogram), sql(hist_sql("fares", "MARKET_FARE", 60)), _EDGES)
add(
    "q38_fare_center",
    on(fares, ef.fare_center),
    sql("SELECT avg(MARKET_FARE) AS mean_fare, median(MARKET_FARE) AS median_fare FROM fares"),
    "mean_fare median_fare",
)
add("q39_distance_histogram", on(fares, ef.distance_histogram), sql(hist_sql("fares", "MARKET_DISTANCE", 50)), _EDGES)
add(
    "q39_distance_mean",
    on(fares, ef.distance_mean),
    sql("SELECT avg(MARKET_DISTANCE) AS mean_distance FROM fares"),
    "mean_distance",
)
add(
    "q40_fare_scatter",
    on(fares, ef.fare_scatter, LINE_KEY),
    sql(f"SELECT MARKET_DISTANCE, MARKET_FARE FROM fares {_SAMPLE} LIMIT 5000"),
    "MARKET_DISTANCE MARKET_FARE",
)
add("q41_top_destinations", on(fares, ef.top_airports, "DEST"), sql(counts_sql("fares", "DEST", 15)))
add("q41_top_origins", on(fares, ef.top_airports, "ORIGIN"), sql(counts_sql("fares", "ORIGIN", 15)))
add(
    "q42_fare_at_top_destinations",
    on(fares, ef.fare_at_top_destinations),
    sql(
        """SELECT DEST, avg(MARKET_FARE) AS mean_fare FROM fares WHERE DEST IN
           (SELECT DEST FROM fares GROUP BY 1 ORDER BY count(*) DESC, DEST LIMIT 15) GROUP BY 1"""
    ),
    "mean_fare",
)
_PER_MILE = "(SELECT *, MARKET_FARE / nullif(MARKET_DISTANCE, 0) AS FARE_PER_MILE FROM fares)"
_PER_MILE_CLIPPED = f"""(SELECT * FROM {_PER_MILE} WHERE FARE_PER_MILE <
    (SELECT quantile_cont(FARE_PER_MILE, 0.99) FROM {_PER_MILE}))"""
add(
    "q43_fare_per_mile_histogram",
    on(fares, ef.fare_per_mile_histogram),
    sql(hist_sql(_PER_MILE_CLIPPED, "FARE_PER_MILE", 60)),
    _EDGES,
)
add(
    "q43_fare_per_mile_mean",
    on(fares, ef.fare_per_mile_mean),
    sql(f"SELECT avg(FARE_PER_MILE) AS mean_fare_per_mile FROM {_PER_MILE_CLIPPED}"),
    "mean_fare_per_mile",
)
add("q44_fare_correlations", on(fares, ef.correlations), sql(corr_sql("fares", ef.MEASURES)), "corr")
add(
    "q44_fare_correlations_lower",
    on(fares, ef.correlations_lower),
    sql(corr_sql("fares", ef.MEASURES, lower=True)),
    "corr",
)


def _state_sql(source: str) -> str:
    cases = " ".join(
        f"WHEN DEST IN ({', '.join(repr(a) for a, s in AIRPORT_STATE.items() if s == state)}) THEN '{state}'"
        for state in ("TX", "GA", "CA")
    )
    return f"(SELECT *, CASE {cases} ELSE 'Other' END AS DEST_STATE FROM {source})"


add(
    "q45_dest_state",
    lambda s, d: ef.with_dest_state(fares(s, d)).select(*LINE_KEY, "DEST", "DEST_STATE"),
    sql(f"SELECT {_KEY_SQL}, DEST, DEST_STATE FROM {_state_sql('fares')}"),
)
add(
    "q45_fare_pair_sample",
    on(fares, ef.pair_sample, LINE_KEY),
    sql(f"SELECT {', '.join(ef.MEASURES)}, DEST_STATE FROM {_state_sql('fares')} {_SAMPLE} LIMIT 3000"),
    " ".join(ef.MEASURES),
)
_STATE_SAMPLE = f"(SELECT * FROM {_state_sql('fares')} {_SAMPLE} LIMIT 3000)"
add(
    "q45_fare_pair_densities",
    on(fares, ef.pair_densities, LINE_KEY),
    sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", * FROM ({kde_sql(_STATE_SAMPLE, 'DEST_STATE', c, 200, 3.0, True)})"""
            for c in ef.MEASURES
        )
    ),
    "x density",
    digits=6,
)
add(
    "q46_boxes_by_state",
    on(fares, ef.boxes_by_state),
    sql(box_sql(f"(SELECT * FROM {_state_sql(_PER_MILE)} WHERE DEST_STATE <> 'Other')", "DEST_STATE", ef.BOXED)),
    BOX_DOUBLES,
)

# --- fuel ---------------------------------------------------------------------------------------------


def prices(spark: SparkSession, d: str) -> DataFrame:
    return eu.price_frame(fuel(spark, d))


_CHANGES = """(SELECT observation_date, price, price - lag(price) OVER (ORDER BY observation_date) AS price_change
    FROM fuel)"""
add(
    "q47_price_series",
    on(prices, eu.price_series),
    sql(
        """SELECT observation_date, price, (SELECT avg(price) FROM fuel) AS mean_line FROM fuel
           WHERE price IS NOT NULL"""
    ),
    "price mean_line",
    dates="observation_date",
)
add("q48_price_histogram", on(prices, eu.price_histogram), sql(hist_sql("fuel", "price", 20)), _EDGES)
add(
    "q49_change_bars",
    on(prices, eu.change_bars),
    sql(
        f"""SELECT observation_date, coalesce(price_change, 0) AS price_change,
          CASE WHEN coalesce(price_change, 0) >= 0 THEN 'up' ELSE 'down' END AS sign FROM {_CHANGES}"""
    ),
    "price_change",
    dates="observation_date",
)
add(
    "q49_change_counts",
    on(prices, eu.change_counts),
    sql(
        f"""SELECT count(*) FILTER (WHERE price_change > 0) AS up, count(*) FILTER (WHERE price_change < 0) AS down,
          count(*) FILTER (WHERE price_change = 0) AS unchanged FROM {_CHANGES}"""
    ),
)
add(
    "q49_change_describe",
    on(prices, eu.change_describe),
    sql(describe_sql(_CHANGES, ["price_change"])),
    DESCRIBE_DOUBLES,
)
add(
    "q50_rolling_price",
    on(prices, eu.rolling),
    sql(
        """SELECT observation_date, price, CASE WHEN count(price) OVER w = 7 THEN avg(price) OVER w END AS rolling_7d
           FROM fuel WINDOW w AS (ORDER BY observation_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
    ),
    "price rolling_7d",
    dates="observation_date",
)
add(
    "q51_weekly_price",
    on(prices, eu.weekly_mean),
    sql("SELECT weekofyear(observation_date)::INT AS week, avg(price) AS mean_price FROM fuel GROUP BY 1"),
    "mean_price",
)
add(
    "q51_weekly_price_by_year",
    on(prices, eu.weekly_mean, True),
    sql(
        """SELECT isoyear(observation_date)::INT AS iso_year, weekofyear(observation_date)::INT AS week,
             avg(price) AS mean_price FROM fuel GROUP BY ALL"""
    ),
    "mean_price",
)

# --- profiles -----------------------------------------------------------------------------------------

_PROFILED = {
    "delays": (delays, "delays"),
    "competition": (flights, "flights"),
    "t100": (capacity, "capacity"),
    "db1b": (fares, "fares"),
}
for name, (source, cte) in _PROFILED.items():
    add(
        f"q52_distinct_{name}",
        lambda s, d, source=source, name=name: profiles.profile(source(s, d), name, "distinct")["distinct"],
        sql(
            " UNION ALL ".join(
                f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM {cte}""" for c in profiles.DISTINCT[name]
            )
        ),
    )
_NUMERIC = {
    "delays": ["year", "month", "arr_flights", "arr_del15", "carrier_ct", "weather_ct", "nas_ct", "security_ct",
               "late_aircraft_ct", "arr_cancelled", "arr_diverted", "arr_delay", "carrier_delay", "weather_delay",
               "nas_delay", "security_delay", "late_aircraft_delay", *LINE_KEY],
    "competition": ["Delay", "Cancelled"],
    "t100": ["YEAR", "QUARTER", "DEPARTURES_PERFORMED", "SEATS", "PASSENGERS", *LINE_KEY],
    "db1b": ["YEAR", "QUARTER", "PASSENGERS", "MARKET_FARE", "MARKET_DISTANCE", *LINE_KEY],
}
for name, (source, cte) in _PROFILED.items():
    add(
        f"q52_describe_{name}",
        lambda s, d, source=source, name=name: profiles.profile(source(s, d), name, "describe")["describe"],
        sql(describe_sql(cte, _NUMERIC[name])),
        DESCRIBE_DOUBLES,
    )
add(
    "q52_describe_fuel",
    lambda s, d: profiles.profile(prices(s, d), "fuel", "describe")["describe"],
    sql(describe_sql("fuel", ["price"])),
    DESCRIBE_DOUBLES,
)


def _missing(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        profiles.profile(source(spark, d), name, "missing")["missing"].withColumn("dataset", F.lit(name))
        for name, (source, _) in [*_PROFILED.items(), ("fuel", (prices, "fuel"))]
    ]
    return reduce(DataFrame.unionByName, parts).where("missing > 0")


add(
    "q52_missing",
    _missing,
    sql(
        """SELECT 'security_delay' AS "column", count(*) - count(security_delay) AS missing, 'delays' AS dataset FROM delays
        UNION ALL SELECT 'late_aircraft_delay', count(*) - count(late_aircraft_delay), 'delays' FROM delays
        UNION ALL SELECT 'Dep_Time', count(*) - count(Dep_Time), 'competition' FROM flights
        UNION ALL SELECT 'Delay', count(*) - count(Delay), 'competition' FROM flights
        UNION ALL SELECT 'MARKET_FARE', count(*) - count(MARKET_FARE), 'db1b' FROM fares
        UNION ALL SELECT 'price', count(*) - count(price), 'fuel' FROM fuel"""
    ),
)
add(
    "q52_date_range",
    lambda s, d: profiles.profile(flights(s, d), "competition", "range")["range"],
    sql('SELECT min("Date") AS lo, max("Date") AS hi FROM flights'),
    dates="lo hi",
)
add(
    "q52_fare_range",
    lambda s, d: profiles.profile(fares(s, d), "db1b", "range")["range"],
    sql("SELECT min(MARKET_FARE) AS lo, max(MARKET_FARE) AS hi FROM fares"),
    "lo hi",
)
add("q52_months", on(delays, ed.months_covered), sql("SELECT DISTINCT month FROM delays"))
add(
    "q52_cancellation_rate",
    on(flights, el.cancellation_rate),
    sql("SELECT round_even(avg(Cancelled) * 100, 2) AS cancellation_rate FROM flights"),
    "cancellation_rate",
)
add(
    "q52_volatility",
    on(prices, profiles.volatility),
    sql("SELECT round_even(stddev_samp(price), 4) AS std FROM fuel"),
    "std",
)
