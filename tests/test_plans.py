"""What the plans look like: pushed filters, pruned columns, shared shuffles, no pairwise joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from risewatch.operators import alerts, quality, rises
from risewatch.plans.queries import QUERIES
from risewatch.sources import tables

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_and_no_row_at_a_time_python(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition"):
        assert node not in plan


def test_time_range_reaches_the_scan(spark, sf_dir):
    plan = plan_of(entry.queries()["history_range"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThan(ts" in pushed and "LessThan(ts" in pushed
    assert "struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    readings = tables.event_readings(tables.events(spark, sf_dir))
    plan = plan_of(alerts.stateful_alerts(readings, 10))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_messages_are_parsed_once(spark, sf_dir):
    plan = final_plan(entry.queries()["stateful_alerts"](spark, sf_dir))
    assert plan.count("from_json(") == 1


def test_counts_and_sizes_share_one_shuffle_of_the_readings(spark, sf_dir):
    readings = tables.event_readings(tables.events(spark, sf_dir))
    plan = final_plan(alerts.window_alerts(readings, 10))
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["anomaly_windows", "anomaly_windows_sliding"])
def test_window_alerts_read_parse_and_range_their_log_once(spark, sf_dir, name):
    plan = final_plan(QUERIES[name](spark, sf_dir))
    assert [plan.count(x) for x in ("Exchange rangepartitioning", "FileScan", "from_json(")] == [1, 1, 1]


def test_neighbours_share_one_shuffle_of_the_ranges_and_take_no_join(spark, sf_dir):
    readings = tables.event_readings(tables.events(spark, sf_dir))
    plan = final_plan(quality.with_neighbours(readings))
    assert "ReusedExchange" in plan and "Join" not in plan


def test_a_long_series_is_spread_over_tasks(spark, sf_dir):
    one = tables.event_readings(tables.events(spark, sf_dir)).withColumn("truck", F.lit("H"))
    ranges = rises._ranges(one, ["truck"], ["k0"], "_timestamp", "value", 10)
    sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * sum(sizes) / 10
