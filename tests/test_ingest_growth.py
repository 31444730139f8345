"""What a batch of the ingest costs: rules run compiled, fields are read once and only for their own topic, rows are not sorted."""

from datetime import datetime

from pyspark.sql import functions as F

from plantpulse.functions.payload import FlatPayload, with_payloads
from plantpulse.operators import routing
from plantpulse.operators.upsert import COMMAND_LOG, SPECS, command_changes
from plantpulse.schemas import TABLES
from plantpulse.streaming.ingest import Ingest

GOOD = '{"eventId":"e1","siteId":"s","assetId":"a","signalId":"v","quality":"good","ts_source":"2024-01-01T00:00:00Z",' \
       '"ts_ingest":"2024-01-01T00:00:01Z","seq":1,"value":1.5}'
COMMAND = '{"commandId":"c1","siteId":"s","assetId":"a","targetSignal":"t","requestedValue":true,"requestedBy":"me",' \
          '"expiresAt":"2024-01-01T00:00:00Z","approved":1}'
SCORE = '{"siteId":"s","assetId":"a","signalId":"v","score":0.5,"anomalous":"yes","timestamp":"2024-01-01T00:00Z"}'


def _variants() -> list[str | None]:
    """Messages whose fields are absent, null, of another type, or nested; and texts that are no messages."""
    out = [None, "", "no json", "[1]", "[%s]" % GOOD, "1", "{}", "null", " \n" + GOOD]
    for text in (GOOD, COMMAND, SCORE, '{"ts_source":"2024-01-01","siteId":"s","assetId":"a","state":true,"value":7,"type":"x","id":5}'):
        fields = dict(p.split(":", 1) for p in text[1:-1].split(","))
        out.append(text)
        for name in fields:
            for other in (None, "null", '""', "7", "7.5", "true", '"2"', "[]", '{"severity":"low","x":1}'):
                changed = {**fields, name: other}
                out.append("{" + ",".join(f"{k}:{v}" for k, v in changed.items() if v is not None) + "}")
    return out


def _log(spark):
    topics = [*routing.ROUTES, "platform.audit", None]
    rows = [(value, topic) for topic in topics for value in _variants()]
    rows = [("k", v, t, n % 3, n, datetime(2024, 1, 1, 0, n % 60)) for n, (v, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint, timestamp timestamp")


def _lines(df):
    return sorted(df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0])


def _kept(df, path):
    df.coalesce(2).write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def test_sorted_out_rows_are_those_of_the_routes(spark, tmp_path):
    log = _kept(_log(spark), tmp_path / "log")
    checked = _kept(routing.check(log), tmp_path / "checked")
    found = _kept(routing.sorted_out(log, list(SPECS)), tmp_path / "found")
    for name in SPECS:
        expected = routing.table_rows(checked, name)
        expected = command_changes(expected) if name == COMMAND_LOG.table else expected
        got = found.filter(F.col("target") == name).select(f"{name}.*")
        assert got.count() > 5 and _lines(got) == _lines(expected.select(*got.columns)), name
    got = found.filter("target = 'quarantine'").select("quarantine.*")
    assert got.count() > 500 and _lines(got) == _lines(routing.quarantine(checked))
    some = routing.sorted_out(log, ["measurements", "command_log"])
    both = found.filter("target IN ('measurements', 'command_log', 'quarantine')").select(*some.columns)
    assert set(some.columns) == {"target", "measurements", "command_log", "quarantine"} and _lines(some) == _lines(both)


def test_rules_are_no_generator(spark):
    plan = routing.sorted_out(_log(spark), list(SPECS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("parseJson") == 1


def test_only_what_is_asked_of_a_field_is_read(spark):
    p = FlatPayload("some")
    asked = [p.text("eventId"), p.present("eventId"), p.present("unit"), p.time("ts_source"), p.number("value"), p.kind("seq")]
    reads = routing.ROUTES["raw.telemetry"].reads
    rows = with_payloads(_log(spark), F.col("value"), [(p, F.col("topic") == "raw.telemetry", reads)])
    assert {c for c in rows.columns if c.startswith("some.")} == {
        "some.eventId.text", "some.eventId.present", "some.unit.present", "some.ts_source.text", "some.ts_source.typed",
        "some.value.kind", "some.value.text", "some.value.cast", "some.value.typed", "some.seq.kind",
    }
    odd = rows.filter("topic = 'raw.telemetry' AND raw LIKE '{%\"eventId\":null%'").select(*asked).first()
    assert odd[:3] == (None, True, False) and odd[4:] == (1.5, "BIGINT")


def test_a_batch_is_written_without_a_sort(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    seen = []
    jvm = spark._jvm
    store = spark._jsparkSession.sharedState().statusStore()
    last = max((e.executionId() for e in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())), default=-1)
    Ingest(spark, str(tmp_path)).apply(_log(spark), 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for e in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList()):
        if e.executionId() > last:
            seen.append(e.physicalPlanDescription())
    assert any("WriteFiles" in p for p in seen) and not any("Sort [" in p or "Sort (" in p for p in seen)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before


def test_a_compacted_table_is_not_folded_again(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path), ["measurements"])
    table = ingest.tables["measurements"]
    ingest.apply(_log(spark), 0)
    expected = _lines(table.read())
    table.compact()
    again = table.read()
    assert "Aggregate" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.columns == [f.split()[0] for f in TABLES["measurements"].split(", ")] and _lines(again) == expected and expected
