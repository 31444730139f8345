"""Jobs with state, several outputs or several batches: restarts, repeats and bounds."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.functions.constants import ROLLUPS
from plantpulse.operators import anomaly, commands, routing
from plantpulse.operators.rollups import rollup
from plantpulse.operators.upsert import COMMAND_LOG, command_changes, fold
from plantpulse.plans.views import Plant
from plantpulse.schemas import TABLES
from plantpulse.sources.files import stream_files
from plantpulse.streaming import features, live
from plantpulse.streaming.ingest import Ingest
from plantpulse.streaming.replay import KeyedReplay
from plantpulse.streaming.rolled import StoredRollup
from plantpulse.streaming.scoring import ScoringJob
from plantpulse.streaming.unique import UniqueFeed

FOLDER = "/root/testdata/sf0.001"
NOON = datetime(2024, 1, 1, 12)


def rows(df):
    return sorted(map(str, df.collect()))


def add(spark, path, values, schema):
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(path)


# --- duplicate drop ---------------------------------------------------------------------


def test_unique_over_batches_and_a_restart(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id string, at timestamp"
    minute = lambda m: NOON + timedelta(minutes=m)
    feed = UniqueFeed(spark, str(tmp_path / "out"), ["id"], "at", "10 minutes")
    assert feed.rows(schema).count() == 0 and feed.counters().count() == 0
    add(spark, source, [("a", minute(0)), ("b", minute(1)), ("a", minute(0)), ("x", None)], schema)
    add(spark, source, [("b", minute(1)), ("c", minute(4)), ("c", minute(4)), ("d", minute(5))], schema)
    feed.run(stream_files(spark, source, schema, max_files=1))
    kept = feed.progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept == 4
    # After the restart: a repeat of an earlier batch, a jump of an hour, and what is too late by then.
    add(spark, source, [("d", minute(5)), ("e", minute(70))], schema)
    add(spark, source, [("f", minute(71))], schema)
    add(spark, source, [("a", minute(0)), ("g", minute(72))], schema)
    feed.run(stream_files(spark, source, schema, max_files=1))
    assert sorted(r.id for r in feed.rows(schema).collect()) == list("abcdefg")
    # Ids that the watermark has passed are forgotten.
    assert feed.progress[-1]["stateOperators"][0]["numRowsTotal"] == 3
    counted = [(r.seen, r.unique, r.repeated, r.late) for r in feed.counters().orderBy("batch").collect()]
    assert counted == [(3, 2, 1, 0), (4, 2, 2, 0), (2, 1, 1, 0), (1, 1, 0, 0), (2, 1, 0, 1)]


# --- windows ----------------------------------------------------------------------------


@pytest.mark.parametrize("block", [8, 4096])
def test_moments_and_errors_without_windows(spark, block):
    rng = np.random.default_rng(8)
    series = {("s", f"a{k}"): np.cumsum(rng.normal(size=n)) + 1e6 for k, n in enumerate((1, 7, 8, 40, 300))}
    samples = [(s, a, NOON + timedelta(minutes=7 * i), i, float(v)) for (s, a), x in series.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(samples, "site_id string, asset_id string, ts_source timestamp, seq bigint, value double").repartition(4)
    keys = ["site_id", "asset_id"]
    found = anomaly.window_totals(table, keys, length=8, block=block)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, 8) for x in series.values() if len(x) >= 8])
    assert found.count == len(windows) and found.mean == pytest.approx(windows.mean(axis=0), rel=1e-12)
    centred = windows - windows.mean(axis=0)
    assert found.scatter == pytest.approx(centred.T @ centred, rel=1e-6)
    model = anomaly.bottleneck(found, 3)
    stored = anomaly.sliding_windows(table, keys, length=8, block=block)
    assert model.residual == pytest.approx(anomaly.fit(stored, 3).residual, rel=1e-6)
    got = {(r.asset_id, r.seq): r.score for r in anomaly.window_errors(table, keys, model, length=8, block=block).collect()}
    want = {}
    for (_, a), x in series.items():
        for i in range(7, len(x)):
            c = x[i - 7 : i + 1] - model.mean
            want[a, i] = float(((c - c @ model.directions @ model.directions.T) ** 2).mean())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_no_windows(spark):
    empty = spark.createDataFrame([], "site_id string, asset_id string, ts_source timestamp, seq bigint, value double")
    total = anomaly.window_totals(empty, ["site_id", "asset_id"])
    assert total.count == 0
    with pytest.raises(ValueError, match="no windows"):
        anomaly.bottleneck(total)


# --- ingest, rollups --------------------------------------------------------------------


def telemetry_log(spark):
    return Plant(spark, FOLDER).telemetry_messages


def test_rollups_follow_the_changes(spark, tmp_path):
    log, source = telemetry_log(spark), str(tmp_path / "log")
    edges = [datetime(2024, 1, d) for d in (1, 9, 17, 25)] + [datetime(2025, 1, 1)]
    for low, high in zip(edges, edges[1:]):
        log.filter((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high))).coalesce(1).write.mode("append").parquet(source)
    # A fifth batch corrects readings of two days only.
    again = log.filter(F.to_date("timestamp").isin(datetime(2024, 1, 5).date(), datetime(2024, 1, 20).date()))
    again.withColumn("offset", F.col("offset") + 10**9).coalesce(1).write.mode("append").parquet(source)
    kept = {name: StoredRollup(spark, str(tmp_path / name), p["width"]) for name, p in ROLLUPS.items()}
    days = []
    ingest = Ingest(spark, str(tmp_path / "store"), ["measurements"], compact_every=2, after=lambda b: days.append([r.refresh(ingest.tables["measurements"], b) for r in kept.values()]))
    ingest.start(stream_files(spark, source, log.schema, max_files=1), availableNow=True).awaitTermination()
    table = ingest.tables["measurements"].read()
    rounded = lambda df: rows(df.withColumn("avg_value", F.round("avg_value", 6)))
    for name, r in kept.items():
        assert rounded(r.read()) == rounded(rollup(table, ROLLUPS[name]["width"])), name
    assert len(days) == 5 and len(days[-1][0]) <= 3 and len(days[0][0]) > 5
    # A batch that is refreshed again changes nothing; a swap that was stopped is ended by the next refresh.
    one = kept["15m"]
    before = rounded(one.read())
    one._stored().drop("ts_date").limit(0).write.mode("overwrite").parquet(one.staged_path + "-unfinished")
    assert one.refresh(ingest.tables["measurements"], 99) == [] and rounded(one.read()) == before


def test_only_touched_days_are_read(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path), ["measurements"], compact_every=1)
    ingest.apply(telemetry_log(spark), 0)
    day = datetime(2024, 1, 5).date()
    plan = ingest.tables["measurements"].read([day])._jdf.queryExecution().executedPlan().toString()
    filters = [part for part in plan.split("PartitionFilters: ")[1:] if "ts_date" in part[:200]]
    assert filters and "2024-01-05" in plan
    assert {r.d for r in ingest.tables["measurements"].read([day]).select(F.to_date("ts_source").alias("d")).distinct().collect()} == {day}


def test_a_batch_is_one_write_and_may_be_repeated(spark, tmp_path):
    log = Plant(spark, FOLDER).log
    ingest = Ingest(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-batch", "ingest")
    ingest.apply(log, 0)
    jobs = len(tracker.getJobIdsForGroup("one-batch"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Broadcasts of the views that make the messages aside, one job for six tables and the quarantine.
    assert jobs <= 3
    first = {name: rows(t.read()) for name, t in ingest.tables.items()}
    ingest.apply(log, 0)
    assert {name: rows(t.read()) for name, t in ingest.tables.items()} == first and all(first.values())
    checked = routing.check(log)
    assert ingest.quarantine().count() == routing.quarantine(checked).count()


# --- commands ---------------------------------------------------------------------------


def test_status_view_keeps_no_state(spark, tmp_path):
    plant = Plant(spark, FOLDER)
    some = plant.command_arrivals.filter(F.col("issued_at") < F.lit(datetime(1995, 4, 1)))
    changes = command_changes(some).withColumn("part", F.pmod(F.xxhash64("command_id"), F.lit(12)))
    stored = str(tmp_path / "in")
    schema = changes.drop("part").schema
    for k in range(12):
        changes.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(stored)
    view = live.CommandStatusView(spark, str(tmp_path / "view"), "bigint", compact_every=5)
    assert view.read().count() == 0
    query = view.start(stream_files(spark, stored, schema, max_files=1), availableNow=True)
    query.awaitTermination()
    assert len(query.recentProgress) >= 12 and not any(p["stateOperators"] for p in query.recentProgress)
    names = view.table.schema.names
    assert rows(view.read()) == rows(fold(changes, COMMAND_LOG).select(*names))
    # All changes of a command came in one batch, which sent its record.
    assert sorted(x for k in range(12) for x in rows(view.sent(k))) == rows(view.read()) != []


def test_overdue_as_a_stream(spark, tmp_path):
    at = lambda s: NOON + timedelta(seconds=s)
    request = lambda c, s: ("request", c, at(s), None)
    ack = lambda c, s: ("ack", c, at(0), at(s))
    schema, source = "kind string, command_id string, issued_at timestamp, acked_at timestamp", str(tmp_path / "in")
    batches = [
        [request("in-time", 0), request("late", 1), request("never", 2), ack("early", 3)],
        [ack("in-time", 50), request("early", 20), ack("late", 400)],
        [request("other", 7200), ack("other", 7210), ("ack", None, at(0), at(7200))],
        [request("last", 20_000), ack("last", 20_001), ("beat", None, at(90_000), at(90_000))],
    ]
    for b in batches:
        add(spark, source, b, schema)
    out = str(tmp_path / "out")
    found = commands.overdue_stream(stream_files(spark, source, schema, max_files=1), 60)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([r for b in batches for r in b if r[1]], schema)
    want = commands.overdue_commands(whole, at(80_000), 60).select("command_id", "issued_at")
    assert rows(spark.read.schema(found.schema).parquet(out)) == rows(want) and want.count() == 2


# --- replay -----------------------------------------------------------------------------


def test_keyed_replay(spark, tmp_path):
    from plantpulse.schemas import SPOOL

    def spool(low, high, key=lambda k: "hot" if k % 3 else f"k{k % 5}"):
        return [(k, "s", "t", key(k), f"p{k}", "pending" if k % 10 else "sent", 0, "", NOON, None) for k in range(low, high)]

    source, sent = str(tmp_path / "in"), []
    job = KeyedReplay(spark, str(tmp_path / "out"), lambda df, batch: sent.append((batch, df.count())))
    add(spark, source, spool(0, 90), SPOOL)
    add(spark, source, spool(90, 100) + spool(100, 101, lambda k: None), SPOOL)
    job.run(source, max_files=1).awaitTermination()
    add(spark, source, spool(101, 200), SPOOL)
    job.run(source, max_files=1).awaitTermination()
    found = job.published().collect()
    assert sorted(r.row_id for r in found) == [k for k in range(200) if k % 10] and len(sent) == 3
    for key in {r.key for r in found}:
        own = sorted((r.number, r.row_id) for r in found if r.key == key)
        assert [n for n, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    # A batch that is published again gets the same numbers; a lost batch is a gap that stops the next run.
    again = spark.createDataFrame([(k, "t", r.key, r.value) for r in found for k in [r.row_id] if k > 100], "row_id bigint, topic string, key string, value string")
    job.publish(again, 2)
    assert sorted(map(str, job.published().collect())) == sorted(map(str, found)) and job.gaps().count() == 0
    from plantpulse.sources.tables import _remove

    _remove(spark, f"{job.path}/published/batch=1")
    assert job.gaps().count() > 0
    with pytest.raises(RuntimeError, match="not whole"):
        job.run(source)


# --- scoring, views, features -------------------------------------------------------------


def test_scoring_job_repeats_without_change(spark, tmp_path):
    good = '{"assetId":"a","signalId":"x","siteId":"s","ts_source":"2024-01-01T00:00:00Z","window":[1,2,3]}'
    lines = spark.createDataFrame([(good,), (good.replace("1,2,3", "0,0,0"),), ("no json",), ('{"assetId":"a"}',)], "value string")
    job = ScoringJob(spark, str(tmp_path), "m", "v2", lambda w: F.transform(w, lambda x: F.lit(0.0)))
    job.apply(lines, 0)
    first = rows(job.scores()), rows(job.rejected()), rows(job.manifest())
    job.apply(lines.repartition(3), 0)
    assert (rows(job.scores()), rows(job.rejected()), rows(job.manifest())) == first
    job.apply(lines.limit(0), 1)
    m = {r.batch: r for r in job.manifest().collect()}
    assert (m[0].scored, m[0].rejected, m[0].anomalous, m[0].version) == (2, 2, 1, "v2") and (m[1].scored, m[1].rejected) == (0, 0)
    assert sorted(r.error for r in job.rejected().collect()) == ["line is not JSON", "line lacks a usable window"]


def test_an_empty_view_reads_empty(spark, tmp_path):
    schema = "updated_at timestamp, site_id string, connected boolean, mqtt_connected boolean, spool_depth int, kafka_lag int"
    source = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(source)
    view = live.LiveView(spark, str(tmp_path / "view"), ["site_id"])
    view.start(live.site_connectivity(stream_files(spark, source, schema)), availableNow=True).awaitTermination()
    assert view.read().count() == 0 and view.read("updated_at", NOON, timedelta(hours=1)).count() == 0
    with pytest.raises(ValueError, match="no batch"):
        live.LiveView(spark, str(tmp_path / "none"), ["site_id"]).read()
    assert live.CommandStatusView(spark, str(tmp_path / "c"), "bigint").read().count() == 0
    assert Ingest(spark, str(tmp_path / "i")).quarantine().count() == 0


def test_feature_job_restarts_inside_a_window(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def message(second, value):
        stamp = (NOON + timedelta(seconds=second)).isoformat() + "Z"
        return (f'{{"siteId":"s","assetId":"a","signalId":"x","ts_source":"{stamp}","value":{value}}}',)

    def run():
        job = features.feature_job(
            stream_files(spark, source, "value string", max_files=1), lambda m: m.writeStream.format("text").option("path", out), str(tmp_path / "cp")
        )
        job.awaitTermination()

    add(spark, source, [message(1, 1), message(30, 3)], "value string")
    run()
    assert not spark.read.text(out).count()
    add(spark, source, [message(50, 8), message(65, 100)], "value string")
    add(spark, source, [message(3600, 5)], "value string")
    run()
    got = [r.value for r in spark.read.text(out).collect()]
    assert len(got) == 2 and '"avg_value":4.0' in "".join(got) and '"avg_value":100.0' in "".join(got)


def test_backfill_job(spark):
    taken = []
    features.backfill_job(spark.createDataFrame([("s", "a", "x", 1.0), ("s", "a", "x", 3.0)], "site_id string, asset_id string, signal_id string, value double"), taken.append)
    assert [r.avg_value for r in taken[0].collect()] == [2.0]


def test_parsed_telemetry_has_all_fields(spark):
    parsed = features.parsed_telemetry(telemetry_log(spark))
    assert set(parsed.columns) == {f.split()[0] for f in TABLES["measurements"].split(", ")}
