"""The given star-schema tables seen as the telemetry model: registries, arrivals, messages.

``Plant(spark, folder)`` gives each view as a DataFrame. Message views build the JSON text
devices would send, with faulty messages mixed in by ``seq``, so that the contracts and the
routing run over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import COMMAND_LOG, MEASUREMENTS, UpsertSpec, command_changes, fold
from ..operators import alarms as alarm_ops
from ..session import new_folder

# Fixed value: a moment after the last event at every scale.
AS_OF = datetime(2024, 1, 31)
# Alarm limits of the test signals.
THRESHOLDS = {"error": 120.0, "purchase": 150.0, "view": 150.0, "click": 200.0}
# Fixed value: how much later a replayed reading arrives.
REPLAY_OFFSET = 100_000_000

#: The view that makes the messages of each topic.
TOPIC_VIEWS = {
    "raw.telemetry": "telemetry_messages", "raw.alarms": "alarm_messages", "raw.events": "event_messages",
    "asset.state": "state_messages", "command.request": "command_messages", "command.ack": "command_messages",
    "analytics.inference": "score_messages", "platform.audit": "audit_messages",
}

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def _unit(signal: Column) -> Column:
    return F.when(signal == "error", "C").when(signal == "click", "A").otherwise("bar")


def _pick(selector: Column, cases: dict[int, Column | None], default: Column) -> Column:
    """``default`` except where the selector equals one of the cases."""
    out = None
    for number, value in cases.items():
        value = F.lit(None).cast("string") if value is None else value
        out = F.when(selector == number, value) if out is None else out.when(selector == number, value)
    return out.otherwise(default)


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


def _object(fields: dict[str, Column]) -> Column:
    """JSON text of the fields; a field whose text is NULL is left out."""
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: Where messages of this process were written, by application, folder and view.
_staged: dict[tuple[str, str, str], str] = {}


def staged(build: Callable[[Plant], DataFrame]) -> property:
    """Messages are test input: made once per application and read from there. They are written where they are built: what
    they are built from was dealt out before (``Plant.dealt``), so the long texts are neither shuffled nor sorted."""
    def get(self: Plant) -> DataFrame:
        place = (self.spark.sparkContext.applicationId, self.folder, build.__name__)
        if place not in _staged:
            path = new_folder(self.spark, build.__name__)
            build(self).write.option("compression", "zstd").parquet(path)
            _staged[place] = path
        return self.spark.read.parquet(_staged[place])

    return property(get)


class Plant:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows that messages are built from, dealt by a key to as many tasks as a shuffle has parts: the given tables are
        few row groups, and where a join broadcasts one side, few tasks would build all messages. By hash, as dealing in turn
        sorts every row first."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    # --- registries -------------------------------------------------------------------

    @cached_property
    def keyed_assets(self) -> DataFrame:
        """The asset registry with its numeric key, which joins cheaper than the text id."""
        nation, region = self.table("nation"), self.table("region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
        customer = self.table("customer")
        joined = customer.join(places, customer.c_nationkey == places.n_nationkey).select(
            F.col("c_custkey").alias("asset_key"),
            F.concat(F.lit("asset-"), "c_custkey").alias("asset_id"),
            F.concat(F.lit("site-"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))).alias("site_id"),
            F.concat(F.lit("area-"), "n_nationkey").alias("area_id"),
            F.col("c_name").alias("name"),
            F.lit("mqtt").alias("protocol"),
        )
        return joined

    @property
    def assets(self) -> DataFrame:
        return self.keyed_assets.drop("asset_key")

    @property
    def signals(self) -> DataFrame:
        signal = F.col("event_type")
        known = self.table("events").select("user_id", "event_type").distinct().select(
            F.concat(F.lit("asset-"), "user_id").alias("asset_id"),
            signal.alias("signal_id"),
            _unit(signal).alias("unit"),
            F.when(signal == "error", "5s").otherwise("1s").alias("sampling_class"),
        )
        orphan = self.spark.sql(
            "SELECT 'asset-orphan' AS asset_id, 'error' AS signal_id, 'C' AS unit, '5s' AS sampling_class"
        )
        return known.unionByName(orphan)

    @property
    def thresholds(self) -> DataFrame:
        rows = ", ".join(f"('{signal}', {limit}D)" for signal, limit in THRESHOLDS.items())
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(signal_id, limit_value)")

    # --- telemetry --------------------------------------------------------------------

    def arrivals_of(self, events: DataFrame) -> DataFrame:
        """Readings of an events table, batch or stream; every tenth is replayed with value + 1."""
        assets = self.keyed_assets.select("asset_key", "asset_id", "site_id")
        rows = events.join(assets, events.user_id == assets.asset_key)
        copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        replayed = F.col("copy") == 1
        event_id, signal = F.col("event_id"), F.col("event_type")
        quality = F.when(replayed, "good").when(event_id % 20 == 3, "bad").when(event_id % 7 == 0, "uncertain").otherwise("good")
        return rows.withColumn("copy", F.explode(copies)).select(
            F.col("ts").alias("ts_source"),
            (F.col("ts") + F.when(replayed, _seconds(60)).otherwise(_seconds(1))).alias("ts_ingest"),
            F.concat(F.when(replayed, "evt-r").otherwise("evt-"), event_id).alias("event_id"),
            "site_id",
            "asset_id",
            signal.alias("signal_id"),
            event_id.alias("seq"),
            quality.alias("quality"),
            _unit(signal).alias("unit"),
            (F.col("value") + F.col("copy")).alias("value"),
            F.col("props").alias("tags"),
            F.concat(F.when(replayed, "trace-r").otherwise("trace-"), event_id).alias("trace_id"),
            (event_id + F.col("copy") * F.lit(REPLAY_OFFSET)).alias("arrival"),
        )

    @property
    def arrivals(self) -> DataFrame:
        return self.arrivals_of(self.table("events"))

    @property
    def measurements(self) -> DataFrame:
        return fold(self.arrivals, MEASUREMENTS)

    @property
    def alarms(self) -> DataFrame:
        return self.alarms_of(self.measurements)

    def alarms_of(self, readings: DataFrame, *carried: str) -> DataFrame:
        breaching = alarm_ops.breaches(readings, self.thresholds)
        third = F.col("seq") % 3 == 0
        return breaching.select(
            F.col("ts_source").alias("raised_at"),
            F.concat(F.lit("alm-"), "seq").alias("alarm_id"),
            "site_id",
            "asset_id",
            F.when(F.col("value") > 2 * F.col("limit_value"), "critical").otherwise("high").alias("severity"),
            F.concat("signal_id", F.lit(" threshold exceeded")).alias("message"),
            F.when(third, "acknowledged").otherwise("open").alias("state"),
            F.when(third, F.col("ts_source") + _seconds(60)).alias("acknowledged_at"),
            *carried,
        )

    @property
    def site_health(self) -> DataFrame:
        bad, uncertain = F.count_if(F.col("quality") == "bad"), F.count_if(F.col("quality") == "uncertain")
        per_day = self.measurements.groupBy("site_id", F.to_date("ts_source").alias("day")).agg(
            F.max("ts_source").alias("updated_at"), bad.alias("bad"), uncertain.alias("uncertain")
        )
        return per_day.select(
            "updated_at",
            "site_id",
            F.upper("site_id").alias("site_name"),
            F.when(F.col("bad") > 0, "degraded").otherwise("connected").alias("status"),
            (F.col("bad") < 4).alias("connected"),
            F.lit(True).alias("mqtt_connected"),
            F.col("bad").cast("int").alias("spool_depth"),
            F.col("uncertain").cast("int").alias("kafka_lag"),
        )

    # --- commands ---------------------------------------------------------------------

    @property
    def command_arrivals(self) -> DataFrame:
        return self.command_arrivals_of(self.table("orders"))

    def command_arrivals_of(self, orders: DataFrame) -> DataFrame:
        """Requests from orders, and acknowledgements of the finished ones; some acks come first."""
        assets = self.keyed_assets.select("asset_key", "asset_id", "site_id")
        rows = orders.join(assets, orders.o_custkey == assets.asset_key)
        kinds = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("request"), F.lit("ack"))).otherwise(F.array(F.lit("request")))
        order_key, ack = F.col("o_orderkey"), F.col("kind") == "ack"
        approved = F.col("o_orderstatus") != "P"
        priority = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high")
            .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium")
        )

        def either(for_ack: Column, for_request: Column) -> Column:
            return F.when(ack, for_ack).otherwise(for_request)

        return rows.withColumn("kind", F.explode(kinds)).select(
            "kind",
            F.col("o_orderdate").alias("issued_at"),
            F.concat(F.lit("cmd-"), order_key).alias("command_id"),
            "site_id",
            "asset_id",
            either(F.lit(""), F.concat(F.lit("setpoint-"), order_key % 5)).alias("target_signal"),
            either(F.lit(""), F.floor("o_totalprice").cast("bigint").cast("string")).alias("requested_value"),
            either(F.lit("system"), F.concat(F.lit("operator-"), F.col("o_custkey") % 10)).alias("requested_by"),
            either(F.lit("medium"), priority).alias("priority"),
            either(F.lit(True), approved).alias("approved"),
            either(F.lit(""), F.when(approved, F.concat(F.lit("ref-"), order_key)).otherwise("")).alias("approval_reference"),
            (F.col("o_orderdate") + F.when(ack, _seconds(300)).otherwise(_seconds(90))).alias("expires_at"),
            either(F.lit("completed"), F.when(approved, "approved").otherwise("pending-approval")).alias("status"),
            (order_key * 10 + F.when(~ack, 0).when(order_key % 11 == 0, -5).otherwise(5)).alias("arrival"),
        )

    @property
    def command_log(self) -> DataFrame:
        return fold(command_changes(self.command_arrivals), COMMAND_LOG)

    # --- messages ---------------------------------------------------------------------

    def telemetry_messages_of(self, a: DataFrame) -> DataFrame:
        """Arrivals of telemetry as the log carries them: topic, key, JSON value, position."""
        fault = F.col("seq") % 50
        iso = F.date_format("ts_source", ISO_MICROS)
        two_hours_on = F.date_format(F.col("ts_source") + F.expr("INTERVAL '2' HOUR"), ISO_MICROS)
        number = F.col("value").cast("decimal(18,2)").cast("string")
        seq = F.col("seq").cast("string")
        text = _object(
            {
                "eventId": _quoted(F.col("event_id")),
                "siteId": _pick(fault, {16: F.lit('""')}, _quoted(F.col("site_id"))),
                "assetId": _pick(fault, {0: None}, _quoted(F.col("asset_id"))),
                "signalId": _quoted(F.col("signal_id")),
                "quality": _pick(fault, {1: F.lit('"great"')}, _quoted(F.col("quality"))),
                "ts_source": _pick(
                    fault,
                    {10: _quoted(iso), 11: _quoted(F.concat(two_hours_on, F.lit("+02:00"))), 15: F.lit('"not-a-time"')},
                    _quoted(F.concat(iso, F.lit("Z"))),
                ),
                "ts_ingest": _quoted(F.concat(F.date_format("ts_ingest", ISO_MICROS), F.lit("Z"))),
                "seq": _pick(fault, {3: F.lit("-1"), 12: _quoted(seq), 13: F.concat(seq, F.lit(".7"))}, seq),
                "unit": _pick(fault, {7: None}, _quoted(F.col("unit"))),
                "value": _pick(
                    fault,
                    {2: F.lit('"running"'), 5: F.lit("true"), 6: _quoted(number), 8: F.lit("null")},
                    number,
                ),
                "tags": _pick(fault, {9: F.lit("null"), 17: None}, F.col("tags")),
                "traceId": _pick(fault, {18: None}, _quoted(F.col("trace_id"))),
            }
        )
        value = F.when(fault == 4, F.left(text, F.lit(40))).when(fault == 19, F.concat(F.lit("\n\t"), text)).when(fault == 14, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
        return a.select(
            F.col("event_id").alias("key"),
            value.alias("value"),
            F.lit("raw.telemetry").alias("topic"),
            (F.col("seq") % 8).cast("int").alias("partition"),
            F.col("arrival").alias("offset"),
            F.col("ts_ingest").cast("timestamp").alias("timestamp"),
        )

    @staged
    def telemetry_messages(self) -> DataFrame:
        return self.telemetry_messages_of(self.dealt(self.arrivals, "event_id"))

    @staged
    def alarm_messages(self) -> DataFrame:
        """Alarm envelopes of breaching readings; some carry no severity, some no tags."""
        m = self.dealt(alarm_ops.breaches(self.arrivals, self.thresholds), "event_id")
        fault = F.col("seq") % 5
        iso = F.concat(F.date_format("ts_source", ISO_MICROS), F.lit("Z"))
        full = F.concat(F.lit('{"severity":"high","message":"'), F.col("signal_id"), F.lit(' over limit"}'))
        text = _object(
            {
                "assetId": _quoted(F.col("asset_id")),
                "eventId": F.concat(F.lit('"alm-'), F.col("seq"), F.lit('"')),
                "quality": F.lit('"bad"'),
                "seq": F.col("seq").cast("string"),
                "signalId": _quoted(F.col("signal_id")),
                "siteId": _quoted(F.col("site_id")),
                "tags": _pick(fault, {0: F.lit('{"message":"check it"}'), 1: None}, full),
                "ts_ingest": _quoted(F.concat(F.date_format("ts_ingest", ISO_MICROS), F.lit("Z"))),
                "ts_source": _quoted(iso),
                "value": F.lit('"over"'),
            }
        )
        return m.select(
            F.concat(F.lit("alm-"), F.col("seq")).alias("key"), text.alias("value"), F.lit("raw.alarms").alias("topic"),
            (F.col("seq") % 4).cast("int").alias("partition"), F.col("arrival").alias("offset"),
            F.col("ts_ingest").cast("timestamp").alias("timestamp"),
        )

    @staged
    def event_messages(self) -> DataFrame:
        """Plain events with the id, type and time under their various names, or absent."""
        e = self.dealt(self.table("events"), "event_id")
        fault = F.col("event_id") % 6
        iso = _quoted(F.concat(F.date_format("ts", ISO_MICROS), F.lit("Z")))
        name = F.concat(F.lit('"ev-'), F.col("event_id"), F.lit('"'))
        kind_ = _quoted(F.col("event_type"))
        asset = F.concat(F.lit('"asset-'), F.col("user_id"), F.lit('"'))
        text = _object(
            {
                "assetId": _pick(fault, {4: None}, asset),
                "eventId": _pick(fault, {1: None, 5: None}, name),
                "eventType": _pick(fault, {2: None, 3: None}, kind_),
                "id": _pick(fault, {1: name}, F.lit(None).cast("string")),
                "payload": F.col("props"),
                "siteId": _pick(fault, {4: None}, F.lit('"site-x"')),
                "timestamp": _pick(fault, {1: iso, 2: iso, 4: F.lit('"soon"')}, F.lit(None).cast("string")),
                "ts_source": _pick(fault, {1: F.lit('""'), 2: None, 3: None, 4: None}, iso),
                "type": _pick(fault, {2: kind_}, F.lit(None).cast("string")),
            }
        )
        return e.select(
            F.col("event_id").cast("string").alias("key"), text.alias("value"), F.lit("raw.events").alias("topic"),
            (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
            (F.col("ts") + _seconds(5)).cast("timestamp").alias("timestamp"),
        )

    @staged
    def state_messages(self) -> DataFrame:
        """Asset states named by the event type, or by a value, or not at all."""
        e = self.dealt(self.table("events"), "event_id")
        fault = F.col("event_id") % 6
        iso = _quoted(F.concat(F.date_format("ts", ISO_MICROS), F.lit("Z")))
        text = _object(
            {
                "assetId": _pick(fault, {5: None}, F.concat(F.lit('"asset-'), F.col("user_id"), F.lit('"'))),
                "siteId": F.lit('"site-x"'),
                "state": _pick(fault, {1: None, 2: None, 3: F.lit("true")}, _quoted(F.col("event_type"))),
                "ts_source": _pick(fault, {4: None}, iso),
                "value": _pick(fault, {1: F.col("event_id").cast("string")}, F.lit(None).cast("string")),
            }
        )
        return e.select(
            F.col("event_id").cast("string").alias("key"), text.alias("value"), F.lit("asset.state").alias("topic"),
            (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
            (F.col("ts") + _seconds(5)).cast("timestamp").alias("timestamp"),
        )

    @staged
    def command_messages(self) -> DataFrame:
        """Requests and acknowledgements as messages; every fortieth order has a faulty request."""
        c = self.dealt(self.command_arrivals, "command_id").withColumn("order_key", F.substring("command_id", 5, 20).cast("bigint"))
        ack = F.col("kind") == "ack"
        fault = F.when(ack, F.lit(-1)).otherwise(F.col("order_key") % 40)
        ack_fault = F.when(ack, F.col("order_key") % 7).otherwise(-1)
        nothing = F.lit(None).cast("string")

        def iso(name: str) -> Column:
            return _quoted(F.concat(F.date_format(name, ISO_MICROS), F.lit("Z")))

        def request_only(text: Column) -> Column:
            return F.when(~ack, text)

        text = _object(
            {
                "approvalReference": request_only(
                    _pick(fault, {2: F.lit('"ref-x"')}, F.when(F.col("approval_reference") != "", _quoted(F.col("approval_reference"))))
                ),
                "approved": request_only(_pick(fault, {2: F.lit("false"), 8: F.lit("0")}, F.col("approved").cast("string"))),
                "assetId": F.when(ack_fault == 2, nothing).otherwise(_quoted(F.col("asset_id"))),
                "commandId": F.when((ack_fault == 3), nothing).otherwise(_quoted(F.col("command_id"))),
                "expiresAt": _pick(fault, {3: F.lit('"later"')}, F.when(ack_fault != 4, iso("expires_at")).when(~ack, iso("expires_at"))),
                "issuedAt": _pick(fault, {4: None}, F.when(ack_fault == 5, nothing).otherwise(iso("issued_at"))),
                "priority": request_only(_pick(fault, {0: F.lit('"urgent"'), 7: None}, _quoted(F.col("priority")))),
                "requestedBy": request_only(_pick(fault, {1: None}, _quoted(F.col("requested_by")))),
                "requestedValue": request_only(
                    _pick(fault, {5: F.lit("true"), 6: _quoted(F.col("requested_value"))}, F.col("requested_value"))
                ),
                "siteId": F.when(ack_fault == 2, nothing).otherwise(_quoted(F.col("site_id"))),
                "status": F.when(ack & (ack_fault != 1), _quoted(F.col("status"))),
                "targetSignal": request_only(_quoted(F.col("target_signal"))),
            }
        )
        return c.select(
            F.col("command_id").alias("key"), text.alias("value"),
            F.when(ack, "command.ack").otherwise("command.request").alias("topic"),
            F.lit(0).alias("partition"), F.col("arrival").alias("offset"),
            (F.col("issued_at") + _seconds(1)).cast("timestamp").alias("timestamp"),
        )

    @property
    def score_messages(self) -> DataFrame:
        """Scores of the vectors' first element, with the optional fields varied."""
        e = self.table("embeddings")
        fault = F.col("vec_id") % 6
        text = _object(
            {
                "anomalous": _pick(fault, {1: None, 2: F.lit("1"), 3: F.lit('""')}, (F.col("label") > 4).cast("string")),
                "assetId": F.concat(F.lit('"asset-'), F.col("label"), F.lit('"')),
                "modelId": _pick(fault, {2: None}, F.lit('"vec-model"')),
                "score": _pick(fault, {4: None, 5: F.lit('"0.25"')}, (F.col("vec_id") % 100).cast("string")),
                "signalId": F.lit('"vibration"'),
                "siteId": F.lit('"site-x"'),
                "timestamp": F.lit('"2024-01-30T00:00:00Z"'),
            }
        )
        return e.select(
            F.col("vec_id").cast("string").alias("key"), text.alias("value"), F.lit("analytics.inference").alias("topic"),
            F.lit(0).alias("partition"), F.col("vec_id").alias("offset"),
            F.lit("2024-01-30 00:00:00").cast("timestamp").alias("timestamp"),
        )

    @property
    def audit_messages(self) -> DataFrame:
        """Messages of a topic nothing consumes."""
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("key"), F.lit("{}").alias("value"), F.lit("platform.audit").alias("topic"),
            F.lit(0).alias("partition"), F.col("o_orderkey").alias("offset"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        )

    @property
    def log(self) -> DataFrame:
        """All messages of all topics."""
        parts = [getattr(self, name) for name in dict.fromkeys(TOPIC_VIEWS.values())]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def log_of(self, topic: str) -> DataFrame:
        """The messages a reader of one topic has to go through: those of the view that holds it."""
        return getattr(self, TOPIC_VIEWS[topic])

    @property
    def device_messages(self) -> DataFrame:
        """Device registrations, one per asset, with faults by customer key."""
        a = self.keyed_assets
        fault = F.col("asset_key") % 20
        text = _object(
            {
                "siteId": _quoted(F.col("site_id")),
                "assetId": _pick(fault, {5: F.lit('""')}, _quoted(F.col("asset_id"))),
                "deviceId": F.concat(F.lit('"dev-'), F.col("asset_key"), F.lit('"')),
                "protocol": _quoted(F.col("protocol")),
                "signalMap": _pick(fault, {0: F.lit("{}"), 6: F.lit('{"error":7}')}, F.lit('{"error":"ns=2;s=1","view":"ns=2;s=2"}')),
                "units": _pick(fault, {2: None}, F.lit('{"error":"C","view":"bar"}')),
                "samplingClass": _pick(fault, {1: F.lit('"2s"')}, F.lit('"5s"')),
                "thresholds": _pick(fault, {3: None, 7: F.lit('{"error":"hot"}')}, F.lit('{"error":120.5,"view":150}')),
                "ownershipTags": _pick(fault, {4: F.lit('{"team":"a","shift":"b"}')}, F.lit(None).cast("string")),
                "colour": _pick(fault, {8: F.lit('"red"')}, F.lit(None).cast("string")),
            }
        )
        return a.select(F.col("asset_key"), text.alias("raw"))

    @property
    def model_messages(self) -> DataFrame:
        """Model deployments, one per part."""
        p = self.table("part")
        fault = F.col("p_partkey") % 20
        text = _object(
            {
                "modelId": F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')),
                "version": _pick(fault, {1: F.lit('""')}, F.concat(F.lit('"v'), F.col("p_partkey"), F.lit('"'))),
                "checksum": F.concat(F.lit('"sum-'), F.col("p_size"), F.lit('"')),
                "inputSchema": _pick(fault, {3: None}, F.lit('"telemetry-envelope-v1"')),
                "approvalState": _pick(fault, {0: F.lit('"live"'), 4: F.lit('"draft"')}, F.lit('"approved"')),
                "targetScope": F.lit('"site-asia"'),
                "rollbackVersion": _pick(fault, {2: None, 5: F.lit("7")}, F.concat(F.lit('"v'), F.col("p_partkey") - 1, F.lit('"'))),
                "owner": _pick(fault, {6: F.lit('"me"')}, F.lit(None).cast("string")),
            }
        )
        return p.select(F.col("p_partkey"), text.alias("raw"))

    # --- delivery ---------------------------------------------------------------------

    @property
    def delivery_attempts(self) -> DataFrame:
        """Tries to send each order's record, one per line item; those of lines not returned fail with a long error."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_orderkey").alias("row_id"),
            (F.col("l_shipdate") + F.col("l_linenumber") * _seconds(1)).alias("attempted_at"),
            (F.col("l_returnflag") == "R").alias("ok"),
            F.when(
                F.col("l_returnflag") != "R",
                F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" part "), F.col("l_partkey"), F.lit(": "), F.repeat(F.lit("timeout "), F.lit(60))),
            ).alias("error"),
        )

    @property
    def spool(self) -> DataFrame:
        """One record per order at its asset's site; finished orders are sent."""
        orders = self.table("orders")
        assets = self.keyed_assets.select("asset_key", "site_id")
        sent = F.col("o_orderstatus") == "F"
        return orders.join(assets, orders.o_custkey == assets.asset_key).select(
            F.col("o_orderkey").alias("row_id"),
            "site_id",
            F.lit("command.request").alias("kafka_topic"),
            F.concat(F.lit("cmd-"), F.col("o_orderkey")).alias("message_key"),
            F.concat(F.lit('{"order":'), F.col("o_orderkey"), F.lit("}")).alias("payload"),
            F.when(sent, "sent").otherwise("pending").alias("status"),
            F.when(sent, 1).otherwise(0).alias("attempts"),
            F.lit("").alias("last_error"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(sent, F.col("o_orderdate") + F.expr("INTERVAL '20' MINUTE")).cast("timestamp").alias("sent_at"),
        )

    # --- topics, scalar cases, deployments ---------------------------------------------

    @property
    def topic_parts(self) -> DataFrame:
        """A topic's parts per asset, some of which no topic can be built from."""
        turn = F.col("asset_key") % 8
        channel = _pick(
            turn,
            {
                0: F.lit("telemetry"), 1: F.lit("event"), 2: F.lit("alarm"), 3: F.lit("state"),
                4: F.lit("command/request"), 5: F.lit("command/ack"), 6: F.lit("write"),
            },
            F.lit("telemetry"),
        )
        return self.keyed_assets.select(
            "asset_id", _pick(turn, {7: F.lit("north/south")}, F.col("site_id")).alias("site_id"), "area_id", channel.alias("channel")
        )

    @property
    def device_topics(self) -> DataFrame:
        """Topic text per order at its asset, well formed and not."""
        orders = self.table("orders")
        a = self.keyed_assets.select("asset_key", "asset_id", "site_id", "area_id")
        rows = orders.join(a, orders.o_custkey == a.asset_key)
        turn = F.col("o_orderkey") % 7
        path = F.concat(F.lit("site/"), F.col("site_id"), F.lit("/area/"), F.col("area_id"), F.lit("/asset/"), F.col("asset_id"))
        topic = _pick(
            turn,
            {
                0: F.concat(path, F.lit("/telemetry")),
                1: F.concat(path, F.lit("/command/ack")),
                2: F.concat(path, F.lit("/write")),
                3: path,
                4: F.concat(F.lit("plant/"), F.col("site_id"), F.lit("/area/x/asset/y/event")),
                5: F.concat(path, F.lit("/command/request/now")),
            },
            F.concat(path, F.lit("/command/request")),
        )
        return rows.select("o_orderkey", "asset_id", "site_id", topic.alias("topic"))

    @property
    def policy_messages(self) -> DataFrame:
        """Command envelopes on their asset's topic; some lack a required field."""
        c = self.command_arrivals.filter(F.col("kind") == "request")
        areas = self.assets.select("asset_id", "area_id")
        turn = F.substring("command_id", 5, 20).cast("bigint") % 9
        text = _object(
            {
                "commandId": _quoted(F.col("command_id")),
                "siteId": _pick(turn, {0: None}, _quoted(F.col("site_id"))),
                "assetId": _pick(turn, {1: F.lit('""')}, _quoted(F.col("asset_id"))),
                "approvalReference": _pick(turn, {2: F.lit("null")}, _quoted(F.col("approval_reference"))),
                "expiresAt": _quoted(F.date_format("expires_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            }
        )
        topic = F.concat_ws("/", F.lit("site"), "site_id", F.lit("area"), "area_id", F.lit("asset"), "asset_id", F.lit("command/request"))
        return c.join(areas, "asset_id").select("command_id", topic.alias("topic"), text.alias("raw"))

    @property
    def allowed_topics(self) -> DataFrame:
        """Request topics of the assets in the machinery segment."""
        machinery = self.table("customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("asset_key"))
        return self.keyed_assets.join(machinery, "asset_key").select(
            F.concat_ws("/", F.lit("site"), "site_id", F.lit("area"), "area_id", F.lit("asset"), "asset_id", F.lit("command/request")).alias("topic")
        )

    @property
    def value_cases(self) -> DataFrame:
        """JSON values of every scalar kind, around the event values."""
        number = F.col("value").cast("decimal(18,2)").cast("string")
        shown = _pick(
            F.col("event_id") % 12,
            {
                1: F.col("event_id").cast("string"), 2: F.lit("true"), 3: F.lit("false"), 4: _quoted(number), 5: F.lit('" 7 "'),
                6: F.lit('"abc"'), 7: F.lit("null"), 8: F.lit('{"a":1}'), 9: F.lit('"1_000"'), 10: F.lit('"1e3"'), 11: F.lit('"true"'),
            },
            number,
        )
        return self.table("events").select("event_id", F.concat(F.lit('{"value":'), shown, F.lit("}")).alias("raw"))

    @property
    def time_cases(self) -> DataFrame:
        """Timestamp text in and out of the accepted formats, around the event times."""
        def iso(pattern: str, tail: str = "") -> Column:
            return F.concat(F.date_format("ts", pattern), F.lit(tail))

        shown = _pick(
            F.col("event_id") % 10,
            {
                1: iso(ISO_MICROS), 2: F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL '2' HOUR"), ISO_MICROS), F.lit("+02:00")),
                3: iso("yyyy-MM-dd"), 4: iso("yyyy-MM-dd HH:mm:ss"), 5: iso("yyyy-MM-dd'T'HH:mm", "Z"), 6: iso("yyyy"),
                7: iso("yyyyMMdd'T'HHmmss"), 8: F.lit("2024-W05-2"), 9: F.lit("2024-02-30T00:00:00Z"),
            },
            iso(ISO_MICROS, "Z"),
        )
        return self.table("events").select("event_id", shown.alias("text"))

    @property
    def model_registry(self) -> DataFrame:
        """Deployments named after parts, one day apart in size order."""
        p = self.table("part")
        return p.select(
            (F.lit(AS_OF.isoformat()).cast("timestamp_ntz") - F.make_dt_interval(F.col("p_size"))).alias("deployed_at"),
            F.col("p_brand").alias("model_id"),
            F.concat(F.lit("v"), F.col("p_partkey")).alias("version"),
            F.concat(F.lit("sum-"), F.col("p_size")).alias("checksum"),
            F.lit("telemetry-envelope-v1").alias("input_schema"),
            F.lit("approved").alias("approval_state"),
            F.lit("site-asia").alias("target_scope"),
            F.lit("").alias("rollback_version"),
            F.lit("platform-admin").alias("deployed_by"),
        )
