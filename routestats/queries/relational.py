"""Queries for joins, aggregation, windows, ordering, sampling and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routestats.functions import scalars as sc
from routestats.operators import aggregate as agg
from routestats.operators import joins, topk, windows
from routestats.operators.quantiles import quantiles
from routestats.operators.scale import over_ordered, with_row_number, with_running_total
from routestats.plans.schemas import DAY_ORDER, ROUTE_KEYS
from routestats.queries.registry import add
from routestats.queries.tables import LINE_KEY, capacity, delays, fares, flights, fuel, shifted_fuel, sql, table

# Small enough to send these queries down the paths meant for large groups at every table size.
SPLIT_ROWS = 200

HASH_SQL = "substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 15)"
HASH_PART_SQL = "coalesce(length({key}::VARCHAR) || ':' || {key}::VARCHAR, '-')"


def hash_order(keys: list[str], seed: int = 42) -> str:
    return HASH_SQL.format(keys=", ".join(HASH_PART_SQL.format(key=key) for key in keys), seed=seed)


# --- joins --------------------------------------------------------------------------------------------

FARE_AGG_SQL = """SELECT YEAR, QUARTER, ORIGIN, DEST, avg(MARKET_FARE) AS avg_fare,
    coalesce(sum(PASSENGERS), 0) AS passengers_db1b, avg(MARKET_DISTANCE) AS market_distance
    FROM fares GROUP BY ALL"""
CAPACITY_AGG_SQL = """SELECT YEAR, QUARTER, ORIGIN, DEST, coalesce(sum(PASSENGERS), 0) AS passengers_t100,
    coalesce(sum(SEATS), 0) AS seats, coalesce(sum(DEPARTURES_PERFORMED), 0) AS departures_performed
    FROM capacity GROUP BY ALL"""


def fare_routes(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate_fares(fares(spark, d), ROUTE_KEYS, "MARKET_FARE", "PASSENGERS", "MARKET_DISTANCE")


def capacity_routes(spark: SparkSession, d: str) -> DataFrame:
    return agg.aggregate_capacity(capacity(spark, d), ROUTE_KEYS, "PASSENGERS", "SEATS", "DEPARTURES_PERFORMED")


add(
    "join01_inner",
    lambda s, d: joins.join_on(fare_routes(s, d), capacity_routes(s, d), ROUTE_KEYS),
    sql(f"SELECT * FROM ({FARE_AGG_SQL}) JOIN ({CAPACITY_AGG_SQL}) USING (YEAR, QUARTER, ORIGIN, DEST)"),
    "avg_fare passengers_db1b market_distance passengers_t100 seats departures_performed",
)
add(
    "join02_left_calendar",
    lambda s, d: joins.join_calendar(
        capacity(s, d).select(*ROUTE_KEYS, "SEATS"),
        shifted_fuel(s, d),
        "observation_date",
        {"avg_fuel_price": F.avg("DJFUELUSGULF")},
    ),
    sql(
        """SELECT YEAR, QUARTER, ORIGIN, DEST, SEATS, avg_fuel_price FROM capacity LEFT JOIN
          (SELECT (year(observation_date) + 26)::INT AS YEAR, quarter(observation_date)::INT AS QUARTER,
             avg(price) AS avg_fuel_price FROM fuel GROUP BY ALL) USING (YEAR, QUARTER)"""
    ),
    "SEATS avg_fuel_price",
)
add(
    "join03_semi_top_k",
    lambda s, d: joins.semi_top_k(
        table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity"), "l_suppkey", 10
    ),
    """SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem WHERE l_suppkey IN
       (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 10)""",
)
add(
    "join04_lookup",
    lambda s, d: joins.lookup(
        table(s, d, "customer").select("c_custkey", "c_nationkey"),
        "c_nationkey",
        table(s, d, "nation").where(F.col("n_regionkey") != 2).select("n_nationkey", "n_name"),
        "nation",
        "Other",
    ),
    """SELECT c_custkey, c_nationkey, coalesce(n_name, 'Other') AS nation FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
add(
    "join04_lookup_repeated_keys",
    lambda s, d: joins.lookup(
        table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey",
        table(s, d, "customer").select("c_nationkey", "c_mktsegment"), "segment", "none",
    ),
    """SELECT s_suppkey, s_nationkey, coalesce(segment, 'none') AS segment FROM supplier LEFT JOIN
       (SELECT c_nationkey, max(c_mktsegment) AS segment FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""",
)
add(
    "join04_lookup_literal",
    lambda s, d: joins.lookup(
        table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "filled"}, "status", "Other"
    ),
    """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled'
       ELSE 'Other' END AS status FROM orders""",
)
add(
    "join05_conform",
    lambda s, d: joins.conform(
        agg.group_mean(
            table(s, d, "events").withColumn("day", sc.day_name("ts")).where(F.col("day") != "Sunday"), ["day"], "value", "mean_value"
        ),
        "day",
        DAY_ORDER,
    ),
    f"""SELECT (position - 1)::INT AS position, day, mean_value FROM
          (SELECT unnest({DAY_ORDER}) AS day, unnest(range(1, 8)) AS position)
        LEFT JOIN (SELECT dayname(ts) AS day, avg(value) AS mean_value FROM events
          WHERE dayname(ts) <> 'Sunday' GROUP BY 1) USING (day)""",
    "mean_value",
)
add(
    "join06_with_global",
    lambda s, d: joins.with_global(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"),
        {"mean_price": F.avg("o_totalprice"), "max_price": F.max("o_totalprice")},
    ),
    """SELECT o_orderkey, o_totalprice, (SELECT avg(o_totalprice) FROM orders) AS mean_price,
         (SELECT max(o_totalprice) FROM orders) AS max_price FROM orders""",
    "o_totalprice mean_price max_price",
)

# --- aggregation --------------------------------------------------------------------------------------

add("agg01_fares", fare_routes, sql(FARE_AGG_SQL), "avg_fare passengers_db1b market_distance")
add("agg02_capacity", capacity_routes, sql(CAPACITY_AGG_SQL), "passengers_t100 seats departures_performed")
add(
    "agg03_rollup_calendar",
    lambda s, d: agg.rollup_calendar(fuel(s, d), "observation_date", {"avg_price": F.avg("DJFUELUSGULF")}),
    sql(
        """SELECT year(observation_date)::INT AS YEAR, quarter(observation_date)::INT AS QUARTER,
             avg(price) AS avg_price FROM fuel GROUP BY ALL"""
    ),
    "avg_price",
)
add(
    "agg04_group_rate",
    lambda s, d: topk.order_by_value(
        agg.group_rate(table(s, d, "lineitem"), ["l_suppkey"], "l_tax", "l_discount", "tax", "discount", "rate"),
        "rate", ["l_suppkey"],
    ),
    """SELECT l_suppkey, sum(l_discount) AS discount, sum(l_tax) AS tax, sum(l_tax) / sum(l_discount) * 100 AS rate
       FROM lineitem GROUP BY 1 HAVING sum(l_discount) > 0""",
    "discount tax rate",
)
add(
    "agg05_group_mean",
    lambda s, d: agg.group_mean(flights(s, d), ["Carrier"], "Delay", "mean_delay"),
    sql("SELECT Carrier, avg(Delay) AS mean_delay FROM flights GROUP BY 1"),
    "mean_delay",
)
add(
    "agg06_flag_rate",
    lambda s, d: agg.group_mean(flights(s, d), ["Origin"], "Cancelled", "cancel_rate", 100.0),
    sql("SELECT Origin, avg(Cancelled) * 100 AS cancel_rate FROM flights GROUP BY 1"),
    "cancel_rate",
)
add(
    "agg07_group_sum",
    lambda s, d: agg.group_sum(
        delays(s, d).withColumn("gap", F.when(F.col("carrier") != "C3", F.col("security_delay"))), ["carrier"], "gap", "total"
    ),
    sql("SELECT carrier, coalesce(sum(CASE WHEN carrier <> 'C3' THEN security_delay END), 0) AS total FROM delays GROUP BY 1"),
    "total",
)
add(
    "agg08_median",
    lambda s, d: quantiles(table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], [0.5], ["l_returnflag"]),
    """SELECT l_returnflag, 'l_extendedprice' AS "column", 0.5::DOUBLE AS q, median(l_extendedprice) AS value
       FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_returnflag, 'l_quantity', 0.5::DOUBLE, median(l_quantity) FROM lineitem GROUP BY ALL""",
    "value",
)
add(
    "agg08_median_large_groups",
    lambda s, d: quantiles(
        table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], [0.5], ["l_returnflag"], limit=SPLIT_ROWS
    ),
    """SELECT l_returnflag, 'l_extendedprice' AS "column", 0.5::DOUBLE AS q, median(l_extendedprice) AS value
       FROM lineitem GROUP BY ALL
       UNION ALL SELECT l_returnflag, 'l_quantity', 0.5::DOUBLE, median(l_quantity) FROM lineitem GROUP BY ALL""",
    "value",
)
add(
    "agg09_quantile",
    lambda s, d: quantiles(table(s, d, "orders"), ["o_totalprice"], [0.25, 0.99]),
    """SELECT 'o_totalprice' AS "column", unnest([0.25, 0.99])::DOUBLE AS q,
         unnest(quantile_cont(o_totalprice, [0.25, 0.99])) AS value FROM orders""",
    "value",
)
add(
    "agg09_quantile_large",
    lambda s, d: quantiles(table(s, d, "orders"), ["o_totalprice"], [0.25, 0.99], limit=SPLIT_ROWS),
    """SELECT 'o_totalprice' AS "column", unnest([0.25, 0.99])::DOUBLE AS q,
         unnest(quantile_cont(o_totalprice, [0.25, 0.99])) AS value FROM orders""",
    "value",
)
add(
    "agg10_value_counts",
    lambda s, d: agg.value_counts(flights(s, d), "Dep_Time").orderBy(F.desc("n"), "Dep_Time"),
    sql("SELECT Dep_Time, count(*) AS n FROM flights WHERE Dep_Time IS NOT NULL GROUP BY 1"),
)
add(
    "agg11_group_size",
    lambda s, d: agg.group_size(flights(s, d), ["Date"]),
    sql('SELECT "Date", count(*) AS n FROM flights GROUP BY 1'),
    dates="Date",
)
add(
    "agg12_mean_of_counts",
    lambda s, d: agg.mean_of_group_counts(flights(s, d), ["Date"]),
    sql('SELECT avg(n) AS mean_n FROM (SELECT count(*) AS n FROM flights GROUP BY "Date")'),
    "mean_n",
)
add(
    "agg13_distinct_counts",
    lambda s, d: agg.distinct_counts(table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_discount"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    ),
)
add(
    "agg14_distinct_sorted",
    lambda s, d: agg.distinct_sorted(delays(s, d), "month"),
    sql("SELECT DISTINCT month FROM delays"),
)
add(
    "agg15_value_range",
    lambda s, d: agg.value_range(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]),
    """SELECT least(min(l_quantity), min(l_extendedprice)) AS lo,
         greatest(max(l_quantity), max(l_extendedprice)) AS hi FROM lineitem""",
    "lo hi",
)
add(
    "agg16_count_where",
    lambda s, d: agg.count_where(
        capacity(s, d), {"active": F.col("SEATS") > 0, "zero": F.col("SEATS") == 0, "rows": F.lit(True)}
    ),
    sql(
        """SELECT count(*) FILTER (WHERE SEATS > 0) AS active, count(*) FILTER (WHERE SEATS = 0) AS zero,
             count(*) AS rows FROM capacity"""
    ),
)
add(
    "agg17_unpivot_totals",
    lambda s, d: agg.unpivot_totals(
        table(s, d, "lineitem"), {"l_quantity": "Quantity", "l_extendedprice": "Price", "l_tax": "Tax"}
    ),
    """SELECT unnest(['Quantity', 'Price', 'Tax']) AS label,
         unnest([sum(l_quantity), sum(l_extendedprice), sum(l_tax)]) AS total FROM lineitem""",
    "total",
    digits=2,
)
add(
    "prj03_relabel",
    lambda s, d: agg.unpivot_totals(table(s, d, "orders"), {"o_totalprice": "Order value"}, "measure", "total"),
    "SELECT 'Order value' AS measure, sum(o_totalprice) AS total FROM orders",
    "total",
    digits=2,
)
add(
    "agg18_share",
    lambda s, d: agg.with_share(agg.group_sum(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "qty"), "qty"),
    """SELECT l_suppkey, sum(l_quantity) AS qty, sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100
         AS share_pct FROM lineitem GROUP BY 1""",
    "qty share_pct",
)
add(
    "agg19_stddev",
    lambda s, d: agg.group_agg(table(s, d, "orders"), ["o_custkey"], {"std": F.stddev_samp("o_totalprice")}),
    "SELECT o_custkey, stddev_samp(o_totalprice) AS std FROM orders GROUP BY 1",
    "std",
    digits=3,
)
add(
    "agg20_mean_ratio_and_sum",
    lambda s, d: agg.group_agg(
        capacity(s, d).withColumn("lf", sc.safe_divide("PASSENGERS", "SEATS")),
        ["ORIGIN", "DEST"],
        {"avg_lf": F.avg("lf"), "total_pax": sc.sum0("PASSENGERS")},
    ),
    sql(
        """SELECT ORIGIN, DEST, avg(PASSENGERS / nullif(SEATS, 0)) AS avg_lf, sum(PASSENGERS) AS total_pax
           FROM capacity GROUP BY ALL"""
    ),
    "avg_lf total_pax",
)
add(
    "agg21_scalar_stats",
    lambda s, d: agg.scalar_stats(
        table(s, d, "lineitem"), {"mean_qty": F.avg("l_quantity"), "mean_price": F.avg("l_extendedprice")}
    ),
    "SELECT avg(l_quantity) AS mean_qty, avg(l_extendedprice) AS mean_price FROM lineitem",
    "mean_qty mean_price",
)

# --- windows ------------------------------------------------------------------------------------------

_EVENTS = ["user_id", "ts", "event_id", "value"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(*_EVENTS)


add(
    "win01_partition_mean",
    lambda s, d: windows.partition_mean(_events(s, d), ["user_id"], "value", "mean_value").drop("ts"),
    "SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id) AS mean_value FROM events",
    "value mean_value",
)
LAG_SQL = """SELECT user_id, event_id, value, coalesce(lag(value)
    OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS previous FROM events"""
add(
    "win02_lag",
    lambda s, d: windows.lag_by(_events(s, d), ["user_id"], ["ts", "event_id"], "value", "previous", fill="value").drop("ts"),
    LAG_SQL,
    "value previous",
)
add(
    "win03_rolling_mean",
    lambda s, d: windows.rolling_mean(
        _events(s, d), ["user_id"], ["ts", "event_id"], "value", "rolling_2", 2, 1, fill="value"
    ).drop("ts"),
    """SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS rolling_2 FROM events""",
    "value rolling_2",
)
add(
    "win04_diff",
    lambda s, d: windows.diff(fuel(s, d), ["observation_date"], "DJFUELUSGULF", "change"),
    sql(
        """SELECT observation_date, price AS DJFUELUSGULF, price - lag(price) OVER (ORDER BY observation_date) AS change
           FROM fuel"""
    ),
    "DJFUELUSGULF change",
    dates="observation_date",
)
add(
    "win05_rolling_full",
    lambda s, d: windows.rolling_mean(fuel(s, d), [], ["observation_date"], "DJFUELUSGULF", "rolling_7", 7),
    sql(
        """SELECT observation_date, price AS DJFUELUSGULF, CASE WHEN count(price) OVER w = 7
             THEN avg(price) OVER w END AS rolling_7 FROM fuel
           WINDOW w AS (ORDER BY observation_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
    ),
    "DJFUELUSGULF rolling_7",
    dates="observation_date",
)


def _all_orders_rolling(spark: SparkSession, d: str) -> DataFrame:
    """One series over every order: no key to partition on, so it always runs in blocks."""
    rows = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")

    def build(w):
        return {
            "rolling_7": F.avg("o_totalprice").over(w.rowsBetween(-6, 0)),
            "change": F.col("o_totalprice") - F.lag("o_totalprice", 1).over(w),
        }

    size = max(SPLIT_ROWS, rows.count() // 16)
    return over_ordered(rows, [], ["o_orderdate", "o_orderkey"], 6, build, limit=size).drop("o_orderdate")


add(
    "win05_one_long_series",
    _all_orders_rolling,
    """SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7,
         o_totalprice - lag(o_totalprice) OVER w AS change
       FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""",
    "o_totalprice rolling_7 change",
)

# --- order, top-k, sampling ---------------------------------------------------------------------------

add(
    "srt01_multi_key_sort",
    lambda s, d: table(s, d, "part").select("p_brand", "p_size", "p_partkey").orderBy("p_brand", "p_size", "p_partkey"),
    "SELECT p_brand, p_size, p_partkey FROM part ORDER BY ALL",
)
add(
    "srt02_by_value",
    lambda s, d: topk.order_by_value(
        agg.group_mean(table(s, d, "orders"), ["o_custkey"], "o_totalprice", "mean_price"), "mean_price", ["o_custkey"]
    ),
    "SELECT o_custkey, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1",
    "mean_price",
)
add(
    "srt01_global_row_number",
    lambda s, d: with_row_number(
        table(s, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]
    ).drop("o_orderdate"),
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_number FROM orders",
)
add(
    "srt01_running_total",
    lambda s, d: with_running_total(
        table(s, d, "lineitem").select("l_returnflag", *LINE_KEY, "l_quantity"),
        ["l_returnflag"], LINE_KEY, "l_quantity", limit=SPLIT_ROWS * 40,
    ).drop("l_quantity"),
    f"""SELECT l_returnflag, {', '.join(LINE_KEY)}, sum(l_quantity) OVER (PARTITION BY l_returnflag
          ORDER BY {', '.join(LINE_KEY)} ROWS UNBOUNDED PRECEDING) AS running_total FROM lineitem""",
    "running_total",
)
add(
    "top01_by_count",
    lambda s, d: topk.top_k(agg.value_counts(table(s, d, "lineitem"), "l_partkey"), 15, "n", ["l_partkey"]),
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15",
)
add(
    "top02_by_sum",
    lambda s, d: topk.top_k(agg.group_sum(table(s, d, "lineitem"), ["l_partkey"], "l_quantity", "qty"), 15, "qty", ["l_partkey"]),
    "SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 15",
    "qty",
)
add(
    "top03_top_then_sort",
    lambda s, d: topk.top_k_then_sort(
        agg.group_agg(
            table(s, d, "lineitem"), ["l_partkey"], {"qty": F.sum("l_quantity"), "price": F.avg("l_extendedprice")}
        ),
        15, "qty", "price", ["l_partkey"],
    ),
    """SELECT l_partkey, sum(l_quantity) AS qty, avg(l_extendedprice) AS price FROM lineitem
       GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 15""",
    "qty price",
)
add(
    "lim01_head",
    lambda s, d: topk.head(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_totalprice", "o_orderkey"]),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50",
    "o_totalprice",
)
add(
    "smp01_sample_n",
    lambda s, d: topk.sample_n(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 3000, ["o_orderkey"], 42),
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_order(['o_orderkey'])}, o_orderkey LIMIT 3000",
    "o_totalprice",
)

# --- unions -------------------------------------------------------------------------------------------


def _union(spark: SparkSession, d: str) -> DataFrame:
    """The parts have their columns in different orders, and one lacks a column."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [orders.where(F.col("o_orderstatus") == v) for v in ("F", "O", "P")]
    parts[1] = parts[1].select("o_totalprice", "o_orderkey", "o_orderstatus")
    return joins.union_all(parts[0], parts[1], parts[2].drop("o_totalprice"))


add(
    "set01_union",
    _union,
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders""",
    "o_totalprice",
)
