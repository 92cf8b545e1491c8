"""Properties of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry_module
from wardline.driver.queries import MONTH
from wardline.driver.views import view
from wardline.operators import search
from wardline.plans import nat


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_cross_joins(name, spark, sf_dir, no_broadcast):
    plan = entry_module.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_requests_are_read_once(spark, sf_dir, no_broadcast):
    plan = final_plan(entry_module.queries()["nat_detection"](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet.*/events\.parquet", plan)) == 1
    assert "ReusedExchange" in plan


def test_time_filter_and_columns_reach_the_scan(spark, sf_dir):
    requests = view(spark, sf_dir, "requests", MONTH).select("ip", "ts")
    plan = requests._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_unwanted_codes_go_before_the_sum(spark, sf_dir, monkeypatch):
    def rows(limit):
        monkeypatch.setattr(nat, "fits_in_tasks", lambda keys: search.fits_in_tasks(keys, limit))
        inputs = [view(spark, sf_dir, n) for n in ("requests", "accounts", "industries", "networks")]
        frame = nat.nat_detection(*inputs)
        return sorted(map(tuple, frame.collect()), key=str), frame._jdf.queryExecution().optimizedPlan().toString()

    (few, with_filter), (many, without) = rows(10**6), rows(0)
    assert few == many
    assert "LeftSemi" in with_filter and "LeftSemi" not in without
