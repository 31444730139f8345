"""Streams in several batches equal the batch result; restarts and repeats change nothing."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import routing
from plantpulse.operators.upsert import SPECS, command_changes, fold
from plantpulse.plans.views import Plant
from plantpulse.schemas import TABLES
from plantpulse.sources.files import stream_files
from plantpulse.sources.tables import FoldedTable, drop_expired_days, write_table
from plantpulse.streaming import features
from plantpulse.streaming.ingest import ARRIVAL, Ingest

LOG = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log_files(spark, tmp_path_factory):
    """The whole log in four files, in arrival order, and the log itself."""
    path = tmp_path_factory.mktemp("log")
    log = Plant(spark, FOLDER).log.select(*[c.split()[0] for c in LOG.split(", ")])
    log.write.parquet(str(path / "all"))
    log = spark.read.parquet(str(path / "all"))
    edges = [datetime(1990, 1, 1), datetime(1998, 6, 1), datetime(2024, 1, 10), datetime(2024, 1, 20), datetime(2030, 1, 1)]
    for low, high in zip(edges, edges[1:]):
        part = log.filter((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(str(path / "files"))
    return log, str(path / "files")


def rows(df):
    return sorted(map(str, df.collect()))


def test_ingest_in_batches(spark, log_files, tmp_path):
    log, files = log_files
    ingest = Ingest(spark, str(tmp_path / "store"))
    ingest.start(stream_files(spark, files, LOG, max_files=1), availableNow=True).awaitTermination()
    checked = routing.check(log)
    for name in ("measurements", "alarms", "events", "asset_state", "command_log", "model_scores"):
        arrivals = routing.table_rows(checked, name)
        arrivals = command_changes(arrivals) if name == "command_log" else arrivals
        assert rows(ingest.tables[name].read()) == rows(fold(arrivals, SPECS[name]).select(*ingest.tables[name].schema.names)), name
    assert rows(ingest.quarantine()) == rows(routing.quarantine(checked).select(*ingest.quarantine().columns))

    before = rows(ingest.tables["measurements"].read())
    ingest.start(stream_files(spark, files, LOG, max_files=1), availableNow=True).awaitTermination()
    assert rows(ingest.tables["measurements"].read()) == before


def scores(spark, *values):
    base = [(datetime(2024, 1, d), "m", "s", "a", "x", float(v), False, "{}", o) for d, v, o in values]
    df = spark.createDataFrame(base, f"{TABLES['model_scores']}, o bigint")
    return df.withColumn("arrival", F.struct(F.lit(datetime(2024, 1, 1)).alias("timestamp"), F.lit(0).alias("partition"), F.col("o").alias("offset"))).drop("o")


def by_day(table):
    return {r.ts_source.day: r.score for r in table.read().collect()}


def folded(spark, path):
    return FoldedTable(spark, path, SPECS["model_scores"], TABLES["model_scores"], ARRIVAL)


def test_append_repeat_and_compaction(spark, tmp_path):
    table = folded(spark, str(tmp_path))
    assert by_day(table) == {}
    table.append(scores(spark, (1, 1, 0), (2, 2, 1)), 0)
    table.append(scores(spark, (2, 5, 0)), 1)
    table.append(scores(spark, (2, 5, 0)), 1)
    assert by_day(table) == {1: 1.0, 2: 5.0}
    table.compact()
    assert by_day(table) == {1: 1.0, 2: 5.0} and table._batches() == []
    table.append(scores(spark, (2, 7, 0), (3, 3, 1)), 2)
    table.compact()
    assert by_day(table) == {1: 1.0, 2: 7.0, 3: 3.0}


def test_compaction_stopped_midway_is_finished(spark, tmp_path):
    table = folded(spark, str(tmp_path))
    table.append(scores(spark, (1, 1, 0), (2, 2, 1)), 0)
    table.compact()
    table.append(scores(spark, (2, 9, 0)), 1)
    # Stopped after the staged write, with the old day already gone.
    write_table(scores(spark, (2, 9, 0)).drop("arrival"), table.staged_path, only_days=False)
    from plantpulse.sources.tables import _remove

    _remove(spark, f"{table.base_path}/ts_date=2024-01-02")
    assert by_day(table) == {1: 1.0, 2: 9.0}
    table.compact()
    assert by_day(table) == {1: 1.0, 2: 9.0}


def test_retention_drops_whole_days(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(scores(spark, (1, 1, 0), (2, 2, 1), (3, 3, 2)).drop("arrival"), path)
    assert drop_expired_days(spark, path, datetime(2025, 2, 3)) == ["ts_date=2024-01-01", "ts_date=2024-01-02"]
    assert [r.score for r in spark.read.parquet(path).collect()] == [3.0]
    assert drop_expired_days(spark, path, datetime(2025, 3, 31), months=13) == ["ts_date=2024-01-03"]


def test_late_readings_are_dropped(spark, tmp_path):
    def telemetry(i, stamp):
        return f'{{"siteId":"s","assetId":"a","signalId":"x","ts_source":"{stamp}","seq":{i},"value":{i}}}'

    source = str(tmp_path / "in")
    # A batch filters late rows by the watermark of the batch before, so one batch lies between the jump in time and the late reading.
    batches = (["00:00:10"], ["01:00:00"], ["01:30:00"], ["00:00:20", "03:00:00"], ["04:00:00"])
    for i, times in enumerate(batches):
        stamps = [f"2024-01-01T{t}Z" for t in times]
        spark.createDataFrame([(telemetry(i, s),) for s in stamps], "value string").coalesce(1).write.mode("append").parquet(source)
    query = (
        features.rolling_means(features.parsed_telemetry(stream_files(spark, source, "value string", max_files=1)))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.window_start.strftime("%H:%M"): r.avg_value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"00:00": 0.0, "01:00": 1.0, "01:30": 2.0, "03:00": 3.0}
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1


def test_kafka_and_jdbc_builders(spark):
    """Option builders only: neither connector is part of PySpark."""
    from plantpulse.sources import jdbc, kafka

    assert kafka.telemetry_source(spark, "broker:9092") is not None
    assert kafka.log_source(spark, "broker:9092", max_offsets=10, min_partitions=4) is not None
    assert jdbc.table_reader(spark, "jdbc:x:y", "m", "u", "p", start=datetime(2024, 1, 1), end=datetime(2024, 2, 1), partitions=4) is not None
