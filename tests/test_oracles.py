"""Every query against its SQL oracle, and the shape of the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import differences, oracle_frame
from plantpulse.plans.catalog import CATALOG
from plantpulse.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(CATALOG), dict(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    assert differences(got, oracle_frame(ORACLES[name], FOLDER)) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "asset_id", "health", "open_alarm_count", "quality"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["upsert_measurements", "asset_health", "rollup_15m", "threshold_alarms", "command_log", "backlog_trend"])
def test_no_plan_pairs_everything(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_time_range_reaches_the_scan(spark, tmp_path):
    from datetime import datetime

    from plantpulse.sources.tables import time_slice, write_table

    path = str(tmp_path / "m")
    write_table(QUERIES["upsert_measurements"](spark, FOLDER), path)
    cut = time_slice(spark.read.parquet(path), datetime(2024, 1, 3), datetime(2024, 1, 4, 12)).select("value")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts_date" in plan and "GreaterThanOrEqual(ts_source" in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "struct<ts_source:timestamp_ntz,value:double>" in scan
