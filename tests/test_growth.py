"""What must not grow faster than the input: topics read, work per message, tasks per batch."""

import time
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantpulse.operators.upsert import SPECS
from plantpulse.plans import catalog, views
from plantpulse.schemas import TABLES
from plantpulse.session import configure
from plantpulse.sources.tables import FoldedTable, on_days
from plantpulse.streaming import features

LINE = '{"eventId":"e%d","siteId":"s","assetId":"a","signalId":"v","quality":"good","ts_source":"2024-01-01T00:00:00Z",' \
       '"ts_ingest":"2024-01-01T00:00:01Z","seq":%d,"value":1.5}'


def log(spark, topic="raw.telemetry", n=3):
    rows = [(f"k{i}", LINE % (i, i), topic, 0, i, datetime(2024, 1, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint, timestamp timestamp")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class OneTopic(views.Plant):
    """A log of telemetry only; the other topics may not be asked for."""

    telemetry_messages = property(lambda self: log(self.spark))
    alarm_messages = event_messages = state_messages = command_messages = score_messages = audit_messages = property(
        lambda self: (_ for _ in ()).throw(AssertionError("another topic was read"))
    )


def test_route_reads_only_its_topic(spark):
    routed = catalog._routed(OneTopic(spark, "nowhere"), "raw.telemetry")
    assert sorted(r.event_id for r in routed.collect()) == ["e0", "e1", "e2"]


def test_every_topic_of_the_log_has_its_view():
    assert set(views.TOPIC_VIEWS) == {*catalog.routing.ROUTES, "platform.audit"}


def test_messages_are_built_from_dealt_rows_and_not_sorted(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), i % 3, "error", 1.0, "{}") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert views.Plant(spark, str(tmp_path)).state_messages.count() == 40
    path = views._staged[spark.sparkContext.applicationId, str(tmp_path), "state_messages"]
    assert len({r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}) > 1
    dealt = views.Plant(spark, str(tmp_path)).dealt(events, "event_id")
    assert "hashpartitioning" in dealt._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_a_parsed_field_does_not_parse_again(spark):
    parsed = features.parsed_telemetry(log(spark), "event_id", "ts_source").filter("event_id IS NOT NULL AND ts_source IS NOT NULL")
    assert not [line for line in plan(parsed).splitlines() if "Filter" in line and "variant" in line.lower()]
    assert parsed.columns == ["event_id", "ts_source"] and parsed.count() == 3


def test_large_batches_of_a_feed_are_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    days = F.timestamp_seconds(F.lit(datetime(2024, 1, 1).timestamp()).cast("bigint") + F.col("id") % 30 * 86400)
    rows = spark.range(0, 30000, 1, 4).select("id", days.alias("timestamp"))
    edges, p = catalog.MONTH, views.Plant(spark, "nowhere")
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 2000, raising=False)
    feed = catalog._Feed(p, rows, edges, "many")
    assert feed.files == 4  # as many as a shuffle has parts, here
    feed.write(0, 1, 2, 3)
    found = spark.read.parquet(f"{tmp_path}/many").groupBy(F.input_file_name().alias("f")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"), F.count("*").alias("n")).collect()
    assert len(found) == 16 and sum(r.n for r in found) == 30000
    # No file holds rows of two batches; a feed with an empty batch stays with two files each.
    assert all(sum(r.a >= e for e in edges) == sum(r.z >= e for e in edges) for r in found)
    assert catalog._Feed(p, rows.filter(F.col("timestamp") >= F.lit(edges[0])), edges, "few").files == 2


def test_methods_too_large_for_the_compiler_are_cut(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_a_batch_of_some_ten_thousands_is_read_by_more_than_two_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    days = F.timestamp_seconds(F.lit(datetime(2024, 1, 1).timestamp()).cast("bigint") + F.col("id") % 30 * 86400)
    rows = spark.range(0, 480000, 1, 4).select("id", days.alias("timestamp"))
    assert catalog._Feed(views.Plant(spark, "nowhere"), rows, catalog.MONTH, "some").files == 4  # the parts of a shuffle, here


def test_large_tables_stream_in_four_batches_of_several_files(spark, monkeypatch):
    asked = []
    stream = catalog.files.stream_files
    monkeypatch.setattr(catalog.files, "stream_files", lambda s, path, schema, max_files: asked.append((path, max_files)) or stream(s, path, schema, max_files))
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 100)
    plant = views.Plant(spark, "/root/testdata/sf0.001")
    catalog._in_batches(plant, "orders")
    (path, each), = asked
    stored = spark.read.parquet(path)
    assert each > 1 and len(stored.inputFiles()) == 4 * each
    assert stored.exceptAll(plant.table("orders")).isEmpty() and stored.count() == plant.table("orders").count()


def _table(spark, path):
    return FoldedTable(spark, str(path), SPECS["model_scores"], TABLES["model_scores"], "bigint")


def _scores(spark, days):
    columns = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in StructType.fromDDL(TABLES["model_scores"]) if f.name not in ("ts_source", "asset_id")]
    rows = spark.range(400).selectExpr(f"TIMESTAMP'2024-01-01' + make_dt_interval(id % {days}) AS ts_source", "string(id) AS asset_id", "id AS arrival", *columns)
    return rows.coalesce(1)


def test_a_batch_in_one_part_is_stored_by_several_tasks(spark, tmp_path):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        table = _table(spark, tmp_path)
        table.append(_scores(spark, 3), 0)
    finally:
        spark.conf.set(name, before)
    assert len(table.changes(0).inputFiles()) > 1 and table.changes(0).count() == 400


def test_days_are_named_in_one_expression(spark, tmp_path):
    table = _table(spark, tmp_path)
    table.append(_scores(spark, 5), 0)
    kept = table.read([date(2024, 1, 1), date(2024, 1, 4), None, date(1850, 1, 1)])
    assert {r.ts_source.day for r in kept.select("ts_source").distinct().collect()} == {1, 4} and kept.count() == 160
    assert table.read([]).count() == table.read([None]).count() == 0
    many = [date(2000, 1, 1) + timedelta(k) for k in range(3000)]
    began = time.monotonic()
    on_days(many)
    assert time.monotonic() - began < 1
