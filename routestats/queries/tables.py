"""The airfare source tables, derived row by row from the star schema, in Spark and in SQL.

Every row of ``lineitem``, ``events`` or ``orders`` becomes a row (or, for the daily price, part of
a row), so the work of each query grows with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.functions.scalars import zfill
from routestats.operators.clean import cast_int_strict, coerce_numeric
from routestats.plans.schemas import TARGET_AIRPORTS

AIRPORTS = [*TARGET_AIRPORTS, "JFK", "ORD", "SEA", "DEN", "LBB", "SNA"]
N_AIRPORTS = len(AIRPORTS)
# Identifies a lineitem row; order and line number alone do not.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _airport(number: str) -> Column:
    codes = ", ".join(f"'{a}'" for a in AIRPORTS)
    return F.expr(f"element_at(array({codes}), cast(({number}) % {N_AIRPORTS} + 1 AS int))")


def _origin() -> Column:
    return _airport("l_suppkey")


def _dest() -> Column:
    return _airport("l_partkey * 5 + 1")


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row per event, with missing and unreadable values, as a source file would have."""
    ts = F.col("ts") + F.expr("INTERVAL 430 DAYS")
    later = ts + F.expr("INTERVAL 15 MINUTES")
    number = F.col("user_id") % 20

    def clock(t: Column) -> Column:
        return (F.hour(t) * 100 + F.minute(t)).cast("string")

    return table(spark, sf_dir, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("Date"),
        _airport("user_id").alias("Origin"),
        _airport("event_id * 7 + 3").alias("Dest"),
        F.concat(F.lit("C"), number.cast("string")).alias("Carrier"),
        F.concat(F.lit("Airline "), (number % 18).cast("string")).alias("Airline Name"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(clock(ts)).alias("Dep_Time"),
        clock(later).alias("Actual_Dep"),
        F.when(F.col("event_id") % 50 == 0, F.lit("x")).otherwise((F.col("value") - 60).cast("string")).alias("Delay"),
        F.when(F.col("event_type") == "error", F.lit("1")).otherwise(F.lit("0")).alias("Cancelled"),
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with their types, none left out."""
    df = flights_raw(spark, sf_dir).withColumn("Date", F.col("Date").cast("timestamp_ntz"))
    df = df.withColumns({c: zfill(c, 4) for c in ("Dep_Time", "Actual_Dep")})
    return cast_int_strict(coerce_numeric(df, ["Delay"]), "Cancelled")


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket market row per line; no fare on line 7, no distance where there is no discount."""
    return table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") + 26).alias("YEAR"),
        F.quarter("l_shipdate").alias("QUARTER"),
        _origin().alias("ORIGIN"),
        _dest().alias("DEST"),
        F.col("l_quantity").alias("PASSENGERS"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("MARKET_FARE"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
        .alias("MARKET_DISTANCE"),
        F.col("l_returnflag").alias("flag"),
        *LINE_KEY,
    )


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment row per line, a quarter later than its ticket; no seats without a discount."""
    day = F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")
    return table(spark, sf_dir, "lineitem").select(
        (F.year(day) + 26).alias("YEAR"),
        F.quarter(day).alias("QUARTER"),
        _origin().alias("ORIGIN"),
        _dest().alias("DEST"),
        F.col("l_linenumber").cast("double").alias("DEPARTURES_PERFORMED"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity") + F.col("l_partkey") % 20)
        .alias("SEATS"),
        F.col("l_quantity").alias("PASSENGERS"),
        *LINE_KEY,
    )


def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delay-cause row per line, with missing security and late-aircraft minutes."""
    qty, line, part = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")
    supp, price = F.col("l_suppkey"), F.col("l_extendedprice")
    carrier = (part % 12).cast("string")
    measures = {
        "arr_flights": qty,
        "arr_del15": F.floor(qty * line / 8),
        "carrier_ct": line,
        "weather_ct": line % 3,
        "nas_ct": part % 5,
        "security_ct": supp % 2,
        "late_aircraft_ct": part % 7,
        "arr_cancelled": supp % 4,
        "arr_diverted": part % 3,
        "arr_delay": price,
        "carrier_delay": price * F.col("l_discount"),
        "weather_delay": qty * line,
        "nas_delay": qty * (supp % 9),
        "security_delay": F.when(F.col("l_tax") != 0, qty),
        "late_aircraft_delay": F.when(qty <= 45, price / 4),
    }
    return table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") + 26).alias("year"),
        F.month("l_shipdate").alias("month"),
        F.concat(F.lit("C"), carrier).alias("carrier"),
        F.concat(F.lit("Carrier "), carrier).alias("carrier_name"),
        _origin().alias("airport"),
        F.concat(F.lit("Airport "), _origin()).alias("airport_name"),
        *[c.cast("double").alias(name) for name, c in measures.items()],
        *LINE_KEY,
    )


def fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per order date: the mean order value; none on the 13th of a month."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("observation_date"))
    daily = daily.agg(F.avg("o_totalprice").alias("_price"))
    price = F.when(F.dayofmonth("observation_date") != 13, F.col("_price"))
    return daily.select("observation_date", price.alias("DJFUELUSGULF"))


_CODES = "[" + ", ".join(f"'{a}'" for a in AIRPORTS) + "]"


def _airport_sql(number: str) -> str:
    return f"list_extract({_CODES}, 1 + ({number}) % {N_AIRPORTS})"


_ORIGIN_SQL, _DEST_SQL = _airport_sql("l_suppkey"), _airport_sql("l_partkey * 5 + 1")
_LINE_KEY_SQL = ", ".join(LINE_KEY)

# SQL for the same tables; a query text names the ones it needs.
CTES = {
    "flights": f"""
        SELECT date_trunc('day', ts + INTERVAL 430 DAY)::TIMESTAMP AS "Date",
          {_airport_sql('user_id')} AS Origin, {_airport_sql('event_id * 7 + 3')} AS Dest,
          'C' || (user_id % 20) AS Carrier, 'Airline ' || (user_id % 20 % 18) AS "Airline Name",
          CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%H%M') END AS Dep_Time,
          strftime(ts + INTERVAL 15 MINUTE, '%H%M') AS Actual_Dep,
          CASE WHEN event_id % 50 <> 0 THEN value - 60 END AS Delay,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Cancelled
        FROM events""",
    "fares": f"""
        SELECT (year(l_shipdate) + 26)::INT AS YEAR, quarter(l_shipdate)::INT AS QUARTER,
          {_ORIGIN_SQL} AS ORIGIN, {_DEST_SQL} AS DEST, l_quantity AS PASSENGERS,
          CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS MARKET_FARE,
          CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / l_quantity END AS MARKET_DISTANCE,
          l_returnflag AS flag, {_LINE_KEY_SQL}
        FROM lineitem""",
    "capacity": f"""
        SELECT (year(l_shipdate + INTERVAL 90 DAY) + 26)::INT AS YEAR,
          quarter(l_shipdate + INTERVAL 90 DAY)::INT AS QUARTER,
          {_ORIGIN_SQL} AS ORIGIN, {_DEST_SQL} AS DEST, l_linenumber::DOUBLE AS DEPARTURES_PERFORMED,
          CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_quantity + l_partkey % 20 END AS SEATS,
          l_quantity AS PASSENGERS, {_LINE_KEY_SQL}
        FROM lineitem""",
    "active": """
        SELECT *, PASSENGERS / SEATS AS LOAD_FACTOR, ORIGIN || ' to ' || DEST AS Route
        FROM capacity WHERE SEATS > 0""",
    "delays": f"""
        SELECT (year(l_shipdate) + 26)::INT AS year, month(l_shipdate)::INT AS month,
          'C' || (l_partkey % 12) AS carrier, 'Carrier ' || (l_partkey % 12) AS carrier_name,
          {_ORIGIN_SQL} AS airport, 'Airport ' || {_ORIGIN_SQL} AS airport_name,
          l_quantity AS arr_flights, floor(l_quantity * l_linenumber / 8) AS arr_del15,
          l_linenumber::DOUBLE AS carrier_ct, (l_linenumber % 3)::DOUBLE AS weather_ct,
          (l_partkey % 5)::DOUBLE AS nas_ct, (l_suppkey % 2)::DOUBLE AS security_ct,
          (l_partkey % 7)::DOUBLE AS late_aircraft_ct, (l_suppkey % 4)::DOUBLE AS arr_cancelled,
          (l_partkey % 3)::DOUBLE AS arr_diverted, l_extendedprice AS arr_delay,
          l_extendedprice * l_discount AS carrier_delay, l_quantity * l_linenumber AS weather_delay,
          l_quantity * (l_suppkey % 9) AS nas_delay,
          CASE WHEN l_tax <> 0 THEN l_quantity END AS security_delay,
          CASE WHEN l_quantity <= 45 THEN l_extendedprice / 4 END AS late_aircraft_delay, {_LINE_KEY_SQL}
        FROM lineitem""",
    "fuel": """
        SELECT o_orderdate::DATE AS observation_date,
          CASE WHEN day(o_orderdate) <> 13 THEN avg(o_totalprice) END AS price
        FROM orders GROUP BY o_orderdate""",
    "analysis": """
        SELECT f.*, c.* EXCLUDE (YEAR, QUARTER, ORIGIN, DEST), p.avg_fuel_price,
          passengers_t100 / nullif(seats, 0) AS load_factor, ORIGIN || '-' || DEST AS route,
          coalesce((passengers_t100 / nullif(seats, 0) >= 0.8)::INT, 0) AS is_saturated
        FROM (SELECT YEAR, QUARTER, ORIGIN, DEST, avg(MARKET_FARE) AS avg_fare,
                coalesce(sum(PASSENGERS), 0) AS passengers_db1b, avg(MARKET_DISTANCE) AS market_distance
              FROM fares GROUP BY ALL) f
        JOIN (SELECT YEAR, QUARTER, ORIGIN, DEST, coalesce(sum(PASSENGERS), 0) AS passengers_t100,
                coalesce(sum(SEATS), 0) AS seats, coalesce(sum(DEPARTURES_PERFORMED), 0) AS departures_performed
              FROM capacity GROUP BY ALL) c USING (YEAR, QUARTER, ORIGIN, DEST)
        LEFT JOIN (SELECT (year(observation_date) + 26)::INT AS YEAR, quarter(observation_date)::INT AS QUARTER,
                avg(price) AS avg_fuel_price FROM fuel GROUP BY ALL) p USING (YEAR, QUARTER)""",
    "route_frame": """
        SELECT *, avg(load_factor) OVER (PARTITION BY route) AS route_avg_load_factor,
          coalesce(lag(load_factor) OVER (PARTITION BY route ORDER BY YEAR, QUARTER), load_factor) AS lag_load_factor,
          coalesce(avg(load_factor) OVER (PARTITION BY route ORDER BY YEAR, QUARTER
            ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), load_factor) AS rolling_load_factor_2
        FROM analysis""",
    "model_frame": "SELECT YEAR, QUARTER, ORIGIN, DEST, "
    + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM route_frame), 0.0) AS {c}"
        for c in (
            "load_factor",
            "route_avg_load_factor",
            "lag_load_factor",
            "rolling_load_factor_2",
            "market_distance",
            "avg_fuel_price",
            "passengers_db1b",
        )
    )
    + ", is_saturated, avg_fare FROM route_frame WHERE avg_fare IS NOT NULL",
}

# The same frames over one quarter only, as the full run from raw files makes them.
CTES["route_quarter"] = CTES["route_frame"].replace(
    "FROM analysis", "FROM (SELECT * FROM analysis WHERE YEAR = 2025 AND QUARTER = 1)"
)
CTES["model_quarter"] = CTES["model_frame"].replace("route_frame", "route_quarter")


def sql(body: str) -> str:
    """``body`` with the derived tables it names put in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = ", ".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {parts} {body}"


def shifted_fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price series moved to the years of the derived fares."""
    moved = F.make_date(
        F.year("observation_date") + 26, F.month("observation_date"), F.lit(1)
    )
    return fuel(spark, sf_dir).withColumn("observation_date", moved)


