"""The physical plans are the ones intended."""

import re

import pytest
from pyspark.sql import functions as F

from routestats.operators import aggregate as agg
from routestats.operators import joins, scale, topk
from routestats.plans import fare_model
from routestats.queries import REGISTRY
from routestats.queries import tables as T
from routestats.queries.relational import capacity_routes, fare_routes
from routestats.plans.schemas import ROUTE_KEYS
from routestats.session import materialize

PYTHON_NODES = r"ArrowEvalPython|BatchEvalPython|MapInArrow|PythonMapInArrow|MapInPandas|FlatMapGroupsInPandas"

# Only the correlations use Arrow batches.
JVM_ONLY = [
    "flt01_between", "flt05_any_in_set", "flt08_active_or_all", "join01_inner", "join02_left_calendar",
    "join03_semi_top_k", "join05_conform", "join06_with_global", "agg01_fares", "agg04_group_rate",
    "agg13_distinct_counts", "agg18_share", "win05_rolling_full", "top03_top_then_sort", "smp01_sample_n",
    "st03_histogram", "st04_box_stats", "st06_kde", "q17_boxes_by_carrier", "q21_mean_delay_by_airline",
    "q33_busiest_route_load", "q45_dest_state", "ml01_analysis_table", "ml02_model_frame",
    "evl04_metrics_table", "evl05_residual_histogram",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_cross_product(spark, sf, name):
    text = plan(REGISTRY[name].run(spark, sf))
    assert not re.search(PYTHON_NODES, text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(REGISTRY["flt01_between"].run(spark, sf))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,2024-01-08", text)
    assert "value" not in re.search(r"ReadSchema: \S+", text).group()
    text = plan(T.fares(spark, sf).groupBy("YEAR").agg(F.sum("PASSENGERS")))
    assert re.search(r"ReadSchema: (\S+)", text).group(1) == "struct<l_quantity:double,l_shipdate:timestamp_ntz>"


def test_route_join_adds_no_exchange(spark, sf, no_broadcast):
    text = plan(joins.join_on(fare_routes(spark, sf), capacity_routes(spark, sf), ROUTE_KEYS))
    assert "SortMergeJoin" in text and text.count("Exchange ") == 2
    assert len(re.findall("partial_avg|partial_sum", text)) >= 2  # combined before the shuffle


def test_route_features_share_one_exchange(spark, sf):
    table = materialize(REGISTRY["ml01_analysis_table"].run(spark, sf))
    text = plan(fare_model.with_route_features(table))
    assert text.count("Exchange ") == 1 and text.count("Window ") >= 2


def test_top_k_keeps_k_rows_per_task(spark, sf):
    df = agg.value_counts(T.table(spark, sf, "lineitem"), "l_partkey")
    assert "TakeOrderedAndProject" in plan(topk.top_k(df, 15, "n", ["l_partkey"]))
    assert "BroadcastHashJoin" in plan(joins.semi_top_k(T.table(spark, sf, "lineitem"), "l_suppkey", 5))


def test_join_side_is_broadcast_only_when_small(spark, sf, no_broadcast):
    rows = T.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    side = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in plan(scale.join_sized(rows, side, ["l_suppkey"]))
    text = plan(scale.join_sized(rows, side, ["l_suppkey"], limit=3))
    assert "BroadcastHashJoin" not in text and re.search(r"hashpartitioning\(l_suppkey#\d+L, _salt", text)


def test_blocks_bound_the_rows_of_a_window(spark):
    """No exchange to a single partition, and no block beyond its size plus what it borrows."""
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("v"))
    seen = {}

    def build(w):
        seen["n"] = F.count("*").over(w.rowsBetween(-(10**9), 10**9))
        return {"n": seen["n"]}

    out = scale.over_ordered(df, [], ["id"], 4, build, limit=500)
    text = plan(out)
    windows = re.findall(r"Window \[.*", text)
    assert any("_block" in w for w in windows)
    assert out.agg(F.max("n")).first()[0] == 504
