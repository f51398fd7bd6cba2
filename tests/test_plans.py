"""What the physical plans look like: one scan, pruned columns, one exchange, no Python."""

import pytest

from conftest import TABLES
from streamlat.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [name for name in QUERIES if not name.startswith("stream_")]
WINDOWED = [name for name in BATCH if name.startswith(("parity_mean", "throughput"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_in_batch_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, TABLES))
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", WINDOWED)
def test_one_exchange_of_combined_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, TABLES))
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_shuffle_without_windows(spark):
    for name in ("record_latency_kafka", "parity_fused", "digit_sum_documents", "ramp_schedule",
                 "broker_latency", "port_latency", "label_union"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, TABLES)), name


def test_only_needed_columns_are_read(spark):
    for name in WINDOWED:
        plan = plan_of(QUERIES[name](spark, TABLES))
        columns = plan.split("ReadSchema: struct<")[1].split(">")[0]
        assert {c.split(":")[0] for c in columns.split(",")} <= {
            "event_id", "ts", "l_orderkey", "l_linenumber", "l_shipdate"}, name


def test_fused_parity_reads_once_and_branches_twice(spark):
    assert plan_of(QUERIES["parity_mean_6h"](spark, TABLES)).count("FileScan") == 1
    assert plan_of(QUERIES["parity_mean_two_branch_6h"](spark, TABLES)).count("FileScan") == 2


def test_lines_are_parsed_once(spark):
    # A filter on parsed columns would be pushed below the projection and parse again.
    for name in ("parity_mean_6h", "throughput_10s"):
        plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sequence number is not a whole number") == 1, name
        assert plan.count("creation time is not a whole number") == 1, name


def test_windows_from_a_start_have_the_same_plan(spark):
    plan = plan_of(QUERIES["parity_mean_from_start_2s"](spark, TABLES))
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_the_digit_load_is_not_optimized_away(spark):
    assert "digit_sum" in plan_of(QUERIES["throughput_10s"](spark, TABLES))
