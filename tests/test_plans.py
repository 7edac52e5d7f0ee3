"""The plans are the ones we want: pruned scans, partial aggregates, top-k, no nested loops."""

import pytest

from panelmill import queries
from panelmill.operators import ordering
from panelmill.operators.counts import top_values
from panelmill.operators.quantiles import quantile_columns
from panelmill.plans.charts import chart_points
from panelmill.sources import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark, data):
    return spark.read.parquet(f"{data}/lineitem.parquet")


def test_bar_reads_one_column_and_keeps_top_k(lineitem):
    text = plan(chart_points(lineitem, {"source_columns": ["l_returnflag"]}))
    assert "ReadSchema: struct<l_returnflag:string>" in text
    assert "TakeOrderedAndProject(limit=15" in text and "partial_count" in text
    assert "PushedFilters: [IsNotNull(l_returnflag)]" in text


def test_group_sum_reads_two_columns(lineitem):
    text = plan(chart_points(lineitem, {"source_columns": ["l_returnflag", "l_quantity"], "aggregation": "sum"}))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text and "partial_sum" in text


def test_daily_series_pushes_null_checks(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    text = plan(chart_points(events, {"chart_type": "line", "source_columns": ["ts", "value"]}))
    assert "IsNotNull(ts)" in text and "IsNotNull(value)" in text and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_top_values_limit_before_the_shuffle(lineitem):
    text = plan(top_values(lineitem, ["l_returnflag", "l_linestatus"]))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "ReadSchema: struct<l_linestatus:string,l_returnflag:string>" in text or "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in text


def test_latest_version_limits_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(catalog.latest(spark.read.parquet(f"{data}/events.parquet"), "user_id", "event_id"))


def test_page_is_a_top_k_and_cursor_is_pushed(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey")
    text = plan(ordering.page(orders, ["o_custkey", "o_orderkey"], 10, after={"o_custkey": 5, "o_orderkey": 7}))
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(o_custkey,5)" in text


def test_point_read_pushes_the_id(spark, data, tmp_path):
    catalog.append(queries.event_versions(spark, data), f"{tmp_path}/c")
    text = plan(catalog.find(catalog.read(spark, f"{tmp_path}/c"), "17", 17))
    assert "EqualTo(dashboard_id,17)" in text


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_nested_loops_and_no_python(spark, data, name):
    text = plan(queries.QUERIES[name](spark, data))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "Python" not in text and "MapInPandas" not in text


def test_quantiles_force_no_broadcast(spark, data, lineitem):
    big = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = plan(chart_points(lineitem, {"source_columns": ["l_returnflag", "l_extendedprice"], "aggregation": "median"}))
        many = plan(quantile_columns(lineitem, ["l_suppkey"], "l_extendedprice", {"m": 0.5}))
        assert "Broadcast" not in few + many and "percentile(" not in few + many and "Coalesce" not in few + many
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", big)
