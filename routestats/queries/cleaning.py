"""Queries for sources, sinks, filters, projections, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routestats.functions import scalars as sc
from routestats.operators import clean, filters
from routestats.operators.aggregate import group_agg, with_year_quarter
from routestats.operators.evaluate import with_residual
from routestats.plans import cleaning as plan
from routestats.plans import eda_fuel, fare_model
from routestats.plans import schemas as S
from routestats.queries.registry import add
from routestats.queries.tables import capacity, delays, fares, flights, flights_raw, fuel, shifted_fuel, sql, table
from routestats.session import scratch_path
from routestats.sources import tables as src
from routestats.streaming.incremental import clean_incrementally

PERIOD = plan.Period(2025, 1)


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


TARGETS = _in(S.TARGET_AIRPORTS)

# --- sources and sinks: each writes a table derived from the given ones, then reads it back ---------


def _orders_csv(spark: SparkSession, d: str) -> str:
    """Orders as text, with several spellings of a missing value."""
    path = scratch_path(spark, "orders-csv")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("N/A")).otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 11 == 0, F.lit("null")).otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        status.alias("o_orderstatus"), price.alias("o_totalprice"),
    )
    src.write_table(rows, path, "csv")
    return path


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


add(
    "src01_read_table",
    lambda s, d: src.read_table(
        s, _orders_csv(s, d), _schema("o_orderkey bigint, o_orderstatus string, o_totalprice double")
    ),
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice FROM orders""",
    "o_totalprice",
)


def _two_orders(spark: SparkSession, d: str) -> str:
    """Files of one folder whose columns come in different orders, and one column only in some."""
    path = scratch_path(spark, "orders-two-orders")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    src.write_table(rows.where("o_orderkey % 2 = 0"), f"{path}/a", "csv")
    src.write_table(rows.where("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey"), f"{path}/b", "csv")
    return path


add(
    "src01_mixed_headers",
    lambda s, d: src.read_table(s, _two_orders(s, d), _schema("o_orderkey bigint, o_totalprice double")),
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus
       FROM orders""",
    "o_totalprice",
)


def _big_integers(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "big-integers")
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    spelled = F.when(key % 4 == 0, F.concat(text, F.lit(".0"))).when(key % 4 == 1, F.concat(text, F.lit(".7"))).otherwise(text)
    rows = table(spark, d, "orders").select(
        key.alias("key"), (F.lit(9007199254740993) + key).cast("string").alias("big"), spelled.alias("spelled")
    )
    src.write_table(rows, path, "csv")
    return src.read_table(spark, path, _schema("key bigint, big bigint, spelled int"))


add(
    "src01_big_integers",
    _big_integers,
    """SELECT o_orderkey AS key, 9007199254740993 + o_orderkey AS big,
         CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey::INT END AS spelled FROM orders""",
)


def _short_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end early, as some writers leave out trailing missing values."""
    path = scratch_path(spark, "short-rows")
    key = F.col("o_orderkey").cast("string")
    whole = F.concat_ws(",", key, "o_orderstatus", F.lit("x"))
    line = F.when(F.col("o_orderkey") % 3 == 0, key).otherwise(whole).alias("key,status,note")
    # One wide field, under a separator that no value holds, is written without quotes.
    table(spark, d, "orders").select(line).write.option("header", "true").option("sep", "\u0001").csv(path)
    return src.read_table(spark, path, _schema("key bigint, status string, note string"))


add(
    "src01_short_rows",
    _short_rows,
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS note FROM orders""",
)


def _chunked_clean(spark: SparkSession, d: str) -> DataFrame:
    source = scratch_path(spark, "flights-csv")
    src.write_table(flights_raw(spark, d).repartition(6), source, "csv")
    return clean_incrementally(
        spark, source, S.FLIGHTS, lambda raw: plan.clean_flights(raw, PERIOD),
        scratch_path(spark, "flights-clean"), scratch_path(spark, "flights-progress"), files_per_batch=2,
    )


CLEAN_FLIGHTS_SQL = sql(
    f"""SELECT * FROM flights WHERE "Date" BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-03-31'
    AND (Origin IN {TARGETS} OR Dest IN {TARGETS})"""
)


def _growing_folder(spark: SparkSession, d: str) -> DataFrame:
    """Files with two headers, lines that end early and a column the schema doesn't name, in two instalments."""
    source, out, progress = (scratch_path(spark, f"growing-{n}") for n in ("csv", "clean", "progress"))
    schema = _schema("o_orderkey bigint, o_totalprice double, o_orderstatus string")
    rows = table(spark, d, "orders").select(*[F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")])
    plain = rows.where("o_orderkey % 3 <> 0")
    short = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(",", "o_orderstatus", "o_orderkey"))
    lines = rows.where("o_orderkey % 3 = 0").select(
        F.coalesce(short, F.concat_ws(",", "o_orderstatus", "o_orderkey", "o_orderpriority")).alias("o_orderstatus,o_orderkey,o_orderpriority")
    )
    for number, write in enumerate((
        lambda path: src.write_table(plain.select("o_orderkey", "o_totalprice", "o_orderstatus").repartition(3), path, "csv"),
        lambda path: lines.repartition(2).write.option("header", "true").option("sep", "\u0001").csv(path),
    )):
        write(f"{source}/{number}")
        stored = clean_incrementally(spark, source, schema, lambda raw: raw.where("o_orderkey > 10"), out, progress, files_per_batch=2)
    return stored


add(
    "src02_growing_folder",
    _growing_folder,
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, o_orderstatus,
         CASE WHEN o_orderkey % 6 = 3 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey > 10""",
    "o_totalprice",
)
add("src02_chunked_scan", _chunked_clean, CLEAN_FLIGHTS_SQL, "Delay", dates="Date")
add(
    "src03_read_dates",
    lambda s, d: src.read_table(
        s, _orders_csv(s, d), _schema("o_orderkey bigint, o_orderdate date"), date_format="yyyy-MM-dd"
    ).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders",
    dates="o_orderdate",
)


def _fare_files(spark: SparkSession, d: str) -> str:
    """Fares as one CSV per state, as the ticket files come."""
    root = scratch_path(spark, "fares-csv")
    all_fares = fares(spark, d)
    for flag, state in zip("ANR", S.STATES):
        part = all_fares.where(F.col("flag") == flag).select(*S.FARES.names)
        src.write_table(part, f"{root}/{state}.csv", "csv")
    return root


add(
    "src04_read_family",
    lambda s, d: clean.coerce_numeric(
        src.read_family(s, _fare_files(s, d) + "/{key}.csv", S.STATES, S.FARES, tag="state"),
        ["PASSENGERS", "MARKET_FARE", "MARKET_DISTANCE"],
    ),
    sql(
        """SELECT YEAR, QUARTER, ORIGIN, DEST, PASSENGERS, MARKET_FARE, MARKET_DISTANCE,
          CASE flag WHEN 'A' THEN 'CA' WHEN 'N' THEN 'GA' ELSE 'TX' END AS state FROM fares"""
    ),
    "PASSENGERS MARKET_FARE MARKET_DISTANCE",
)


def _optional(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "maybe")
    if src.read_optional(spark, path) is not None:
        raise AssertionError("nothing has been written yet")
    src.write_table(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    return src.read_optional(spark, path)


add("src05_read_optional", _optional, "SELECT c_custkey, c_mktsegment FROM customer")


def _nan_parquet(spark: SparkSession, d: str) -> DataFrame:
    """A Parquet table with NaN from another writer, and the operators that must not see it."""
    path = scratch_path(spark, "nan")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    table(spark, d, "orders").select("o_orderstatus", price.alias("price")).write.parquet(path)
    rows = src.read_optional(spark, path)
    return group_agg(rows, ["o_orderstatus"], {
        "mean": F.avg("price"), "total": F.sum("price"), "most": F.max("price"), "known": F.count("price"),
    })


add(
    "src05_nan_parquet",
    _nan_parquet,
    """SELECT o_orderstatus, avg(p) AS mean, sum(p) AS total, max(p) AS most, count(p) AS known
       FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS p FROM orders) GROUP BY 1""",
    "mean total most",
)


def _unmarked(spark: SparkSession, d: str) -> DataFrame:
    """A folder of data without the mark of a finished write is used as it is, not built again."""
    out = scratch_path(spark, "unmarked")
    marks = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    rows = table(spark, d, "customer").select("c_custkey")
    rows.withColumn("origin", F.lit("stored")).write.option(marks, "false").parquet(f"{out}/customer")
    built = src.ensure_tables(spark, out, lambda name: rows.withColumn("origin", F.lit("built")), ["customer"])
    return built["customer"]


add("src06_unmarked_folder", _unmarked, "SELECT c_custkey, 'stored' AS origin FROM customer")


def _ensure(spark: SparkSession, d: str) -> DataFrame:
    """One table is there, the other is not; both come back."""
    out = scratch_path(spark, "layer")
    src.write_table(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), f"{out}/orders")
    built = src.ensure_tables(
        spark, out, lambda name: table(spark, d, name).select(F.col("c_custkey").alias("key")), ["orders", "customer"]
    )
    parts = [df.agg(F.lit(n).alias("name"), F.count("key").alias("n"), F.sum("key").alias("keys")) for n, df in built.items()]
    return parts[0].unionByName(parts[1])


add(
    "src06_ensure_tables",
    _ensure,
    """SELECT 'orders' AS name, count(o_orderkey) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders
       UNION ALL SELECT 'customer', count(c_custkey), sum(c_custkey)::BIGINT FROM customer""",
)


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "capacity")
    names = S.CAPACITY.names
    src.write_table(capacity(spark, d).select(*names), path, partition_by=["YEAR", "QUARTER"])
    return spark.read.parquet(path).select(*names)


add(
    "snk01_write_table",
    _round_trip,
    sql("SELECT YEAR, QUARTER, ORIGIN, DEST, DEPARTURES_PERFORMED, SEATS, PASSENGERS FROM capacity"),
    "DEPARTURES_PERFORMED SEATS PASSENGERS",
)


def analysis(spark: SparkSession, d: str, save_to: str | None = None, ordered: bool = True) -> DataFrame:
    return fare_model.build_analysis_table(
        fares(spark, d), capacity(spark, d), shifted_fuel(spark, d), save_to, ordered
    )


ANALYSIS_DOUBLES = (
    "avg_fare passengers_db1b market_distance passengers_t100 seats departures_performed avg_fuel_price load_factor"
)
ANALYSIS_SQL = sql("SELECT * FROM analysis")


def _stored_analysis(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "analysis")
    analysis(spark, d, save_to=path)
    return spark.read.parquet(path)


add("snk02_write_analysis", _stored_analysis, ANALYSIS_SQL, ANALYSIS_DOUBLES)

# --- filters ------------------------------------------------------------------------------------------

add(
    "flt01_between",
    lambda s, d: filters.filter_between(
        table(s, d, "events"), "ts", "2024-01-08", "2024-01-20"
    ).select("event_id", "user_id", "event_type"),
    """SELECT event_id, user_id, event_type FROM events
       WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20'""",
)
add(
    "flt02_equal",
    lambda s, d: filters.filter_eq(fares(s, d), {"YEAR": 2025, "QUARTER": 1}).select("ORIGIN", "DEST", "PASSENGERS"),
    sql("SELECT ORIGIN, DEST, PASSENGERS FROM fares WHERE YEAR = 2025 AND QUARTER = 1"),
)
add(
    "flt03_equal_and_in",
    lambda s, d: filters.filter_in(filters.filter_eq(delays(s, d), {"year": 2025}), "month", [1, 2, 3]).select(
        "month", "carrier", "airport", "arr_flights"
    ),
    sql("SELECT month, carrier, airport, arr_flights FROM delays WHERE year = 2025 AND month IN (1, 2, 3)"),
)
add(
    "flt04_in_set",
    lambda s, d: filters.filter_in(delays(s, d), "airport", S.TARGET_AIRPORTS).select("airport", "carrier", "arr_flights"),
    sql(f"SELECT airport, carrier, arr_flights FROM delays WHERE airport IN {TARGETS}"),
)
add(
    "flt04_in_table",
    lambda s, d: filters.filter_in(
        table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"),
        "l_suppkey",
        table(s, d, "supplier").where(F.col("s_acctbal") > 0).select("s_suppkey"),
    ),
    """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
add(
    "flt05_any_in_set",
    lambda s, d: filters.filter_any_in(flights(s, d), ["Origin", "Dest"], S.CA_AIRPORTS).select("Origin", "Dest", "Carrier"),
    sql(f"SELECT Origin, Dest, Carrier FROM flights WHERE Origin IN {_in(S.CA_AIRPORTS)} OR Dest IN {_in(S.CA_AIRPORTS)}"),
)
add(
    "flt06_flag",
    lambda s, d: flights(s, d).where(F.col("Cancelled") == 0).select("Carrier", "Delay"),
    sql("SELECT Carrier, Delay FROM flights WHERE Cancelled = 0"),
    "Delay",
)
add(
    "flt07_positive",
    lambda s, d: capacity(s, d).where(F.col("SEATS") > 0).select("ORIGIN", "DEST", "SEATS"),
    sql("SELECT ORIGIN, DEST, SEATS FROM capacity WHERE SEATS > 0"),
    "SEATS",
)


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """Nothing matches the second condition, so all rows come back with the fill value."""
    rows = capacity(spark, d).select("ORIGIN", "SEATS", F.lit(1.0).alias("LOAD_FACTOR"))
    some = filters.active_or_all(rows, F.col("SEATS") > 0, {"LOAD_FACTOR": 0.0})
    none = filters.active_or_all(rows, F.col("SEATS") < 0, {"LOAD_FACTOR": 0.0})
    some, none = some.withColumn("case", F.lit("some")), none.withColumn("case", F.lit("none"))
    return group_agg(some.unionByName(none), ["case", "ORIGIN", "LOAD_FACTOR"], {"n": F.count("SEATS")})


add(
    "flt08_active_or_all",
    _fallback,
    sql(
        """SELECT 'some' AS "case", ORIGIN, 1.0::DOUBLE AS LOAD_FACTOR, count(SEATS) AS n FROM capacity
           WHERE SEATS > 0 GROUP BY ORIGIN
           UNION ALL SELECT 'none', ORIGIN, 0.0::DOUBLE, count(SEATS) FROM capacity GROUP BY ORIGIN"""
    ),
)
add(
    "flt09_fixed_range",
    lambda s, d: filters.filter_between(flights(s, d), "Delay", -60, 300).select("Carrier", "Delay"),
    sql("SELECT Carrier, Delay FROM flights WHERE Delay BETWEEN -60 AND 300"),
    "Delay",
)
add(
    "flt10_below_quantile",
    lambda s, d: filters.clip_below_quantile(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.99
    ),
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)""",
    "l_extendedprice",
)
add(
    "flt11_dropna",
    lambda s, d: delays(s, d).dropna(subset=["security_delay", "late_aircraft_delay"]).select(
        "airport", "security_delay", "late_aircraft_delay"
    ),
    sql(
        """SELECT airport, security_delay, late_aircraft_delay FROM delays
           WHERE security_delay IS NOT NULL AND late_aircraft_delay IS NOT NULL"""
    ),
    "security_delay late_aircraft_delay",
)
add(
    "flt12_having",
    lambda s, d: group_agg(capacity(s, d), ["ORIGIN", "DEST", "YEAR"], {"seats": sc.sum0("SEATS")}).where("seats > 0"),
    sql("SELECT ORIGIN, DEST, YEAR, sum(SEATS) AS seats FROM capacity GROUP BY ALL HAVING sum(SEATS) > 0"),
    "seats",
)
add(
    "flt13_not_equal",
    lambda s, d: table(s, d, "orders").where(F.col("o_orderstatus") != "O").select("o_orderkey", "o_orderstatus"),
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'",
)

# --- projections --------------------------------------------------------------------------------------

add(
    "prj01_select",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
add(
    "prj02_rename",
    lambda s, d: eda_fuel.price_frame(fuel(s, d)),
    sql("SELECT observation_date, price FROM fuel"),
    "price",
    dates="observation_date",
)
add(
    "prj04_require_columns",
    lambda s, d: clean.require_columns(table(s, d, "part"), ["p_partkey", "p_size"]).select("p_partkey", "p_size"),
    "SELECT p_partkey, p_size FROM part",
)
add(
    "prj05_ensure_column",
    lambda s, d: clean.ensure_column(
        clean.ensure_column(flights(s, d), "route", sc.route_key("Origin", "Dest")), "Carrier", F.lit("unused")
    ).select("route", "Carrier"),
    sql("SELECT Origin || '-' || Dest AS route, Carrier FROM flights"),
)

# --- cleaning -----------------------------------------------------------------------------------------


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Order values as text, written in the ways a source file might."""
    value = F.col("o_totalprice").cast("long").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), value, F.lit(" ")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(value, F.lit("d")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(value, F.lit("e1")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("1,"), value))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("NaN"))
        .otherwise(F.concat(F.lit("0x"), value))
    )
    return table(spark, d, "orders").select("o_orderkey", text.alias("value"))


add(
    "cln01_coerce_numeric",
    lambda s, d: clean.coerce_numeric(_dirty(s, d), ["value"]),
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN trunc(o_totalprice)
         WHEN o_orderpriority = '2-HIGH' THEN trunc(o_totalprice) * 10 END AS value FROM orders""",
    "value",
)
add(
    "cln02_parse_timestamp",
    lambda s, d: clean.parse_timestamp(
        table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")),
        "day", "dd/MM/yyyy",
    ),
    "SELECT o_orderkey, o_orderdate AS day FROM orders",
    dates="day",
)
add(
    "cln03_cast_int",
    lambda s, d: clean.cast_int_strict(
        table(s, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("string").alias("qty")), "qty"
    ),
    "SELECT l_orderkey, l_quantity::INT AS qty FROM lineitem",
)
add(
    "cln04_zfill",
    lambda s, d: table(s, d, "lineitem").select(
        sc.zfill(F.col("l_partkey"), 4).alias("part"), sc.zfill(F.col("l_quantity"), 4).alias("qty")
    ),
    """SELECT CASE WHEN l_partkey > 9999 THEN l_partkey::VARCHAR ELSE lpad(l_partkey::VARCHAR, 4, '0') END AS part,
         lpad(l_quantity::BIGINT::VARCHAR, 4, '0') AS qty FROM lineitem""",
)
add(
    "cln05_fill_from",
    lambda s, d: clean.fill_from(delays(s, d), "security_delay", "weather_delay").select("airport", "security_delay"),
    sql("SELECT airport, coalesce(security_delay, weather_delay) AS security_delay FROM delays"),
    "security_delay",
)
add(
    "cln06_impute_median",
    lambda s, d: clean.impute_median(
        delays(s, d).withColumn("empty", F.lit(None).cast("double")),
        ["security_delay", "late_aircraft_delay", "empty", "absent"],
    ).select("airport", "security_delay", "late_aircraft_delay", "empty"),
    sql(
        """SELECT airport, coalesce(security_delay, (SELECT median(security_delay) FROM delays)) AS security_delay,
          coalesce(late_aircraft_delay, (SELECT median(late_aircraft_delay) FROM delays)) AS late_aircraft_delay,
          0.0::DOUBLE AS empty FROM delays"""
    ),
    "security_delay late_aircraft_delay empty",
)
add(
    "cln07_fill_flag",
    lambda s, d: clean.fill_const(
        delays(s, d).select("airport", (F.col("security_delay") > 20).cast("int").alias("flag")), {"flag": 0}, "int"
    ),
    sql("SELECT airport, coalesce((security_delay > 20)::INT, 0) AS flag FROM delays"),
)
add(
    "cln09_fill_change",
    lambda s, d: clean.fill_const(eda_fuel.price_frame(fuel(s, d)), {"price": 0.0}),
    sql("SELECT observation_date, coalesce(price, 0) AS price FROM fuel"),
    "price",
    dates="observation_date",
)

# --- scalar functions ---------------------------------------------------------------------------------

add(
    "sca01_safe_divide",
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", sc.safe_divide("l_tax", "l_discount").alias("ratio")
    ),
    "SELECT l_orderkey, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem",
    "ratio",
)
add(
    "sca02_pct",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", sc.pct("l_tax", "l_discount").alias("pct")),
    "SELECT l_orderkey, l_tax / nullif(l_discount, 0) * 100 AS pct FROM lineitem",
    "pct",
)
add(
    "sca03_flag_ge",
    lambda s, d: capacity(s, d).select(
        "ORIGIN", "DEST", sc.flag_ge(sc.safe_divide("PASSENGERS", "SEATS"), 0.8).alias("is_saturated")
    ),
    sql("SELECT ORIGIN, DEST, coalesce((PASSENGERS / nullif(SEATS, 0) >= 0.8)::INT, 0) AS is_saturated FROM capacity"),
)
add(
    "sca04_route_key",
    lambda s, d: flights(s, d).select(
        sc.route_key("Origin", "Dest").alias("a"),
        sc.route_key("Origin", "Dest", " to ").alias("b"),
        sc.route_key("Origin", "Dep_Time").alias("c"),
    ),
    sql("SELECT Origin || '-' || Dest AS a, Origin || ' to ' || Dest AS b, Origin || '-' || Dep_Time AS c FROM flights"),
)
add(
    "sca05_year_quarter",
    lambda s, d: with_year_quarter(table(s, d, "orders"), "o_orderdate").select("o_orderkey", "YEAR", "QUARTER"),
    "SELECT o_orderkey, year(o_orderdate)::INT AS YEAR, quarter(o_orderdate)::INT AS QUARTER FROM orders",
)
add(
    "sca06_day_name",
    lambda s, d: table(s, d, "events").select("event_id", sc.day_name("ts").alias("day")),
    "SELECT event_id, dayname(ts) AS day FROM events",
)
add(
    "sca07_iso_week",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", sc.iso_week("o_orderdate").alias("week"), sc.iso_year("o_orderdate").alias("iso_year")
    ),
    "SELECT o_orderkey, weekofyear(o_orderdate)::INT AS week, isoyear(o_orderdate)::INT AS iso_year FROM orders",
)
add(
    "sca08_hhmm_hour",
    lambda s, d: flights(s, d).select("Dep_Time", sc.hhmm_hour("Dep_Time").alias("hour")),
    sql("SELECT Dep_Time, (Dep_Time::INT // 100)::INT AS hour FROM flights"),
)
add(
    "sca09_round",
    lambda s, d: table(s, d, "part").select(
        "p_partkey", sc.report_round((F.col("p_size") + F.col("p_partkey")) / F.lit(4.0), 1).alias("size")
    ),
    "SELECT p_partkey, round_even((p_size + p_partkey) / 4.0::DOUBLE, 1) AS size FROM part",
    "size",
)
add(
    "sca10_sign_class",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", sc.sign_class(F.when(F.col("c_nationkey") != 3, F.col("c_acctbal"))).alias("sign")
    ),
    """SELECT c_custkey, CASE WHEN c_nationkey = 3 OR c_acctbal >= 0 THEN 'up' ELSE 'down' END AS sign FROM customer""",
)
add(
    "sca11_residual",
    lambda s, d: with_residual(table(s, d, "part"), "p_retailprice", "p_size").select("p_partkey", "residual"),
    "SELECT p_partkey, p_retailprice - p_size AS residual FROM part",
    "residual",
)
add(
    "sca12_label",
    lambda s, d: delays(s, d).select(sc.label("Month", F.col("month").cast("double")).alias("month_label")),
    sql("SELECT 'Month ' || month AS month_label FROM delays"),
)

# --- Q01-Q06 ------------------------------------------------------------------------------------------

add("q01_clean_flights", lambda s, d: plan.clean_flights(flights_raw(s, d), PERIOD), CLEAN_FLIGHTS_SQL, "Delay", dates="Date")
add(
    "q02_clean_fares",
    lambda s, d: plan.clean_fares(fares(s, d).select(*S.FARES.names), PERIOD),
    sql(f"SELECT {', '.join(S.FARES.names)} FROM fares WHERE YEAR = 2025 AND QUARTER = 1"),
    "PASSENGERS MARKET_FARE MARKET_DISTANCE",
)
add(
    "q03_clean_delays",
    lambda s, d: plan.clean_delays(delays(s, d).select(*S.DELAYS.names), PERIOD),
    sql(f"SELECT {', '.join(S.DELAYS.names)} FROM delays WHERE year = 2025 AND month <= 3 AND airport IN {TARGETS}"),
    " ".join(S.DELAY_MEASURES),
)
FUEL_PERIOD = plan.Period(1999, 1)
add(
    "q04_clean_fuel",
    lambda s, d: plan.clean_fuel(fuel(s, d), FUEL_PERIOD),
    sql(
        """SELECT observation_date, price AS DJFUELUSGULF FROM fuel
           WHERE observation_date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'"""
    ),
    "DJFUELUSGULF",
    dates="observation_date",
)
add(
    "q05_clean_capacity",
    lambda s, d: plan.clean_capacity(capacity(s, d).select(*S.CAPACITY.names), PERIOD),
    sql(f"SELECT {', '.join(S.CAPACITY.names)} FROM capacity WHERE YEAR = 2025 AND QUARTER = 1"),
    "DEPARTURES_PERFORMED SEATS PASSENGERS",
)


def write_raw_files(spark: SparkSession, d: str) -> str:
    """The five sources as CSV files in the layout of the raw data folder."""
    root = scratch_path(spark, "raw")
    moved = fuel(spark, d).withColumn(
        "observation_date", F.make_date(F.year("observation_date") + 26, F.month("observation_date"), F.lit(28))
    )
    whole = {
        "competition": flights_raw(spark, d),
        "delays": delays(spark, d).select(*S.DELAYS.names),
        "fuel": moved.select(F.date_format("observation_date", "yyyy-MM-dd").alias("observation_date"), "DJFUELUSGULF"),
    }
    for name, df in whole.items():
        src.write_table(df, f"{root}/{S.RAW_FILES[name]}", "csv")
    # The capacity rows have no flag of their own; the origin decides the file they come in.
    origin_state = F.pmod(F.hash("ORIGIN"), F.lit(len(S.STATES)))
    for i, state in enumerate(S.STATES):
        for name, df in (("db1b", fares(spark, d)), ("t100", capacity(spark, d))):
            names = S.FARES.names if name == "db1b" else S.CAPACITY.names
            part = df.where(origin_state == i).select(*names)
            src.write_table(part, f"{root}/{S.RAW_FILES[name].format(key=state)}", "csv")
    return root


def _preprocess(spark: SparkSession, d: str) -> DataFrame:
    stored = plan.preprocess(spark, write_raw_files(spark, d), scratch_path(spark, "cleaned"), PERIOD)
    sums = {"competition": "Delay", "db1b": "MARKET_FARE", "delays": "arr_delay", "fuel": "DJFUELUSGULF", "t100": "SEATS"}
    parts = [
        df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(sums[n]).alias("total"))
        for n, df in stored.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


add(
    "q06_preprocess_all",
    _preprocess,
    sql(
        f"""SELECT 'competition' AS name, count(*) AS rows, sum(Delay) AS total FROM flights
          WHERE "Date" BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-03-31'
            AND (Origin IN {TARGETS} OR Dest IN {TARGETS})
        UNION ALL SELECT 'db1b', count(*), sum(MARKET_FARE) FROM fares WHERE YEAR = 2025 AND QUARTER = 1
        UNION ALL SELECT 'delays', count(*), sum(arr_delay) FROM delays
          WHERE year = 2025 AND month <= 3 AND airport IN {TARGETS}
        UNION ALL SELECT 'fuel', count(*), sum(price) FROM fuel
          WHERE year(observation_date) = 1999 AND quarter(observation_date) = 1
        UNION ALL SELECT 't100', count(*), sum(SEATS) FROM capacity WHERE YEAR = 2025 AND QUARTER = 1"""
    ),
    "total",
    digits=2,
)
