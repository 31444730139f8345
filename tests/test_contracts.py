"""Contract cases: one row each, with the error or the fields expected."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from plantpulse.operators import contracts, routing

TELEMETRY = {
    "eventId": "e-77", "siteId": "north", "assetId": "pump-3", "signalId": "flow", "quality": "uncertain",
    "ts_source": "2024-02-03T04:05:06Z", "ts_ingest": "2024-02-03T04:05:09Z", "seq": 12, "unit": "l/s", "value": 7.25,
    "tags": {"line": "b"}, "traceId": "t-9",
}
COMMAND = {
    "commandId": "cmd-1", "siteId": "s", "assetId": "a", "targetSignal": "speed", "requestedValue": 1400,
    "requestedBy": "op", "priority": "high", "expiresAt": "2024-02-03T05:00:00Z",
}
DEVICE = {
    "siteId": "s", "assetId": "a", "deviceId": "d", "protocol": "opcua", "signalMap": {"x": "ns=1"}, "units": {}, "samplingClass": "1s",
}
MODEL = {
    "modelId": "m", "version": "1", "checksum": "c", "inputSchema": "i", "approvalState": "approved", "targetScope": "t",
}
DROP = object()


def changed(base, **changes):
    out = {**base, **changes}
    return json.dumps({k: v for k, v in out.items() if v is not DROP})


def errors(spark, contract, rows, mode="lenient"):
    df = spark.createDataFrame(list(enumerate(rows)), "n int, raw string")
    return [r.error for r in contracts.validate(df, contract, mode).orderBy("n").collect()]


CASES = [
    ("telemetry", "lenient", changed(TELEMETRY), None),
    ("telemetry", "lenient", changed(TELEMETRY, eventId=""), "event_id may not be empty"),
    ("telemetry", "lenient", changed(TELEMETRY, eventId=None), "event_id may not be empty"),
    ("telemetry", "lenient", changed(TELEMETRY, eventId=DROP), "eventId is missing"),
    ("telemetry", "lenient", changed(TELEMETRY, quality="great"), "quality has a value outside its list"),
    ("telemetry", "lenient", changed(TELEMETRY, seq=-1), "seq is below zero"),
    ("telemetry", "lenient", changed(TELEMETRY, seq="abc"), "seq is not a whole number"),
    ("telemetry", "lenient", changed(TELEMETRY, seq="101.0"), "seq is not a whole number"),
    ("telemetry", "lenient", changed(TELEMETRY, seq=None), "seq is not a number"),
    ("telemetry", "lenient", changed(TELEMETRY, seq=[1]), "seq is not a number"),
    ("telemetry", "lenient", changed(TELEMETRY, tags=None), "tags is not an object"),
    ("telemetry", "lenient", changed(TELEMETRY, unit=DROP, tags=DROP, traceId=DROP, extra=1), None),
    ("telemetry", "lenient", changed(TELEMETRY, ts_source="2026"), "no full date and time: 2026"),
    ("telemetry", "lenient", changed(TELEMETRY, ts_ingest="08:00"), "no full date and time: 08:00"),
    ("telemetry", "lenient", "{", "payload is not valid JSON"),
    ("telemetry", "lenient", "[1]", "payload is not an object"),
    ("telemetry", "strict", changed(TELEMETRY), None),
    ("telemetry", "strict", changed(TELEMETRY, unit=DROP), "unit is missing"),
    ("telemetry", "strict", changed(TELEMETRY, extra=1), "unknown key: extra"),
    ("telemetry", "strict", changed(TELEMETRY, tags={"a": 1}), "tags values must be of type string"),
    ("telemetry", "strict", changed(TELEMETRY, value=7), None),
    ("telemetry", "strict", changed(TELEMETRY, seq=1.5), "seq must be of type integer"),
    ("command", "lenient", changed(COMMAND), None),
    ("command", "lenient", changed(COMMAND, priority="urgent"), "priority has a value outside its list"),
    ("command", "lenient", changed(COMMAND, priority=DROP), None),
    ("command", "lenient", changed(COMMAND, approvalReference="r"), "approval_reference stands without an approval"),
    ("command", "lenient", changed(COMMAND, approvalReference="r", approved="false"), None),
    ("command", "strict", changed(COMMAND, priority=DROP), "priority is missing"),
    ("command", "strict", changed(COMMAND, approvalReference="r"), None),
    ("command", "strict", changed(COMMAND, approvalReference="r", approved=False), "approval_reference stands without an approval"),
    ("device", "lenient", changed(DEVICE), None),
    ("device", "lenient", changed(DEVICE, signalMap={}), "signal_map may not be empty"),
    ("device", "lenient", changed(DEVICE, samplingClass="2s"), "sampling_class has a value outside its list"),
    ("device", "strict", changed(DEVICE, thresholds={"x": "high"}), "thresholds values must be of type number"),
    ("model", "lenient", changed(MODEL), None),
    ("model", "lenient", changed(MODEL, approvalState="live"), "approval_state has a value outside its list"),
    ("model", "strict", changed(MODEL, rollbackVersion=1), "rollbackVersion must be of type string"),
]


@pytest.mark.parametrize("contract,mode", sorted({(c, m) for c, m, _, _ in CASES}))
def test_cases(spark, contract, mode):
    mine = [(raw, error) for c, m, raw, error in CASES if (c, m) == (contract, mode)]
    assert errors(spark, contract, [raw for raw, _ in mine], mode) == [error for _, error in mine]


def log(spark, topic, *payloads):
    rows = [(None, p, topic, 0, i, datetime(2024, 2, 3, 9)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint, timestamp timestamp")


def routed(spark, topic, *payloads):
    return routing.route(routing.check(log(spark, topic, *payloads)), topic).orderBy("arrival").collect()


def test_measurement(spark):
    row = routed(spark, "raw.telemetry", changed(TELEMETRY))[0]
    assert (row.event_id, row.value, row.seq) == ("e-77", 7.25, 12)
    assert row.tags == '{"line":"b"}'


@pytest.mark.parametrize(
    "value,expected",
    [(True, 1.0), (False, 0.0), ("42.5", 42.5), (" 7 ", 7.0), (7, 7.0), (1e3, 1000.0), ("running", None), ("true", None),
     ("1_000", None), ("1.0d", None), (None, None), ({"a": 1}, None), ("nan", None)],
)
def test_value_kinds(spark, value, expected):
    rows = routed(spark, "raw.telemetry", changed(TELEMETRY, value=value))
    assert [r.value for r in rows] == ([] if expected is None else [expected])


@pytest.mark.parametrize("seq,expected", [(101.7, 101), ("101", 101), (True, 1)])
def test_whole_numbers(spark, seq, expected):
    assert routed(spark, "raw.telemetry", changed(TELEMETRY, seq=seq))[0].seq == expected


@pytest.mark.parametrize(
    "text,hour",
    [("2024-02-03T08:00:00Z", 8), ("2024-02-03T08:00:00+02:00", 6), ("2024-02-03T08:00:00", 8), ("2024-02-03 08:00:00.5", 8),
     ("2024-02-03T08:00Z", 8), ("2024-02-03", 0)],
)
def test_timestamps(spark, text, hour):
    row = routed(spark, "raw.telemetry", changed(TELEMETRY, ts_source=text))[0]
    assert row.ts_source.hour == hour or spark.conf.get("spark.sql.session.timeZone") != "UTC"


def test_duplicate_keys_take_the_last(spark):
    doubled = changed(TELEMETRY)[:-1] + ', "value": 5}'
    assert routed(spark, "raw.telemetry", doubled)[0].value == 5.0


def test_alarm(spark):
    tagged = changed(TELEMETRY, quality="bad", value="x", tags={"severity": "high", "message": "hot"})
    rows = routed(spark, "raw.alarms", tagged, changed(TELEMETRY, tags=DROP))
    assert [(r.severity, r.message, r.state) for r in rows] == [
        ("high", "hot", "open"), ("medium", "flow threshold exceeded", "open"),
    ]


def test_score(spark):
    base = {"modelId": "m", "siteId": "s", "assetId": "a", "signalId": "x", "score": 0.61, "anomalous": True, "timestamp": "2024-02-03T08:00:00Z"}
    rows = routed(spark, "analytics.inference", changed(base), changed(base, score=DROP), changed(base, modelId=DROP, anomalous=0))
    assert [(r.model_id, r.score, r.anomalous) for r in rows] == [("m", 0.61, True), ("unknown-model", 0.61, False)]


def test_event_payload_is_canonical(spark):
    row = routed(spark, "raw.events", '{"id": "e", "type": "start", "payload": {"b": 1, "a": [1, 2]}}')[0]
    assert (row.event_id, row.event_type, row.site_id) == ("e", "start", "unknown-site")
    assert row.payload == '{"id":"e","payload":{"a":[1,2],"b":1},"type":"start"}'


def test_command_values_are_shown_as_text(spark):
    rows = routed(spark, "command.request", *[changed(COMMAND, requestedValue=v) for v in (1400, True, "on", 2.5)])
    assert [r.requested_value for r in rows] == ["1400", "True", "on", "2.5"]
    assert {r.status for r in rows} == {"pending-approval"}


def test_unknown_topic_and_custom_route(spark):
    checked = routing.check(log(spark, "mine", '{"n": 1}'))
    assert routing.quarantine(checked).first().error == "no table takes messages of topic mine"
    own = {"mine": routing.Route("t", {"n": "whole"}, lambda p: [], lambda p: {"n": p.whole_number("n")})}
    assert routing.route(routing.check(log(spark, "mine", '{"n": 1}'), routes=own), "mine", own).first().n == 1


def test_live_feed_carries_text_and_json(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [("site/s/area/a/asset/x/event", '{"b": 1}'), ("site/s/area/a/asset/x/event", "not json"), ("other", "{}")], "topic string, value string"
    ).withColumn("timestamp", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    got = [json.loads(r.value)["payload"] for r in routing.live_feed(rows, "site/+/area/+/asset/+/#").collect()]
    assert got == [{"b": 1}, "not json"]
