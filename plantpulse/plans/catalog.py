"""Every operator as a query over the given tables: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as key_fn
from ..functions import topics as topic_fn
from ..functions.constants import DEVICE_TOPIC_FILTER, ROLLUPS
from ..functions.payload import NUMBER, TEXT, Payload, timestamp, with_payload
from ..operators import alarms, anomaly, commands, contracts, delivery, health, readmodel, registry, rollups, routing
from ..operators.upsert import (
    ALARMS, ASSET_STATE, COMMAND_LOG, COMMAND_REQUESTS, EVENTS, MEASUREMENTS, MODEL_SCORES,
    command_changes, fold, insert_if_absent, new_commands, new_deployments,
)
from ..schemas import SITE_HEALTH
from ..session import configure, new_folder, stored
from ..sources import files, tables
from ..streaming import features, live, replay, rolled, scoring, unique
from ..streaming.ingest import Ingest
from .views import AS_OF, REPLAY_OFFSET, Plant

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# The asset, signal, site and command that lookups ask for, and their range.
ASSET, SIGNAL, SITE, COMMAND = "asset-7", "view", "site-asia", "cmd-42"
START, END = datetime(2024, 1, 1), datetime(2024, 1, 30, 12)


def query(build: Callable[[Plant], DataFrame]) -> Callable[[Plant], DataFrame]:
    """Register a query under its function name. Instants are shown without a zone, in UTC."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = build(Plant(configure(spark), folder))
        casts = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
        return df.withColumns(casts) if casts else df

    CATALOG[build.__name__] = run
    return build


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Means are sums in no fixed order; six digits are the same in any order."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- upserts --------------------------------------------------------------------------


@query
def upsert_measurements(p: Plant) -> DataFrame:
    return p.measurements


def _folded(p: Plant, topic: str, messages: DataFrame, spec) -> DataFrame:
    return fold(routing.route(routing.check(messages, [topic]), topic), spec)


@query
def upsert_alarms(p: Plant) -> DataFrame:
    return _folded(p, "raw.alarms", p.alarm_messages, ALARMS)


def _again(messages: DataFrame, which: Column, changes: dict[str, str]) -> DataFrame:
    """The messages, and the chosen ones once more: later on the log, with parts of their text replaced."""
    text = F.col("value")
    for old, new in changes.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    later = messages.filter(which).withColumns({"value": text, "offset": F.col("offset") + REPLAY_OFFSET})
    return messages.unionByName(later)


@query
def upsert_events(p: Plant) -> DataFrame:
    """Errors come twice, the second time under another site and type."""
    named = F.col("value").contains('"eventId"') & F.col("value").contains('"eventType":"error"')
    changes = {'"site-x"': '"site-y"', '"eventType":"error"': '"eventType":"fault"'}
    return _folded(p, "raw.events", _again(p.event_messages, named, changes), EVENTS)


@query
def upsert_asset_state(p: Plant) -> DataFrame:
    """Error states come twice, the second time under another site and state."""
    failing = F.col("value").contains('"state":"error"')
    changes = {'"site-x"': '"site-y"', '"state":"error"': '"state":"fault"'}
    return _folded(p, "asset.state", _again(p.state_messages, failing, changes), ASSET_STATE)


@query
def upsert_model_scores(p: Plant) -> DataFrame:
    return _folded(p, "analytics.inference", p.score_messages, MODEL_SCORES)


@query
def command_requests(p: Plant) -> DataFrame:
    """Every seventh order asks again, with another operator, value and status."""
    requests = p.command_arrivals.filter(F.col("kind") == "request")
    again = requests.filter(F.substring("command_id", 5, 20).cast("bigint") % 7 == 0).withColumns(
        {
            "requested_by": F.lit("operator-late"), "requested_value": F.concat("requested_value", F.lit("0")),
            "status": F.lit("superseded"), "arrival": F.col("arrival") + REPLAY_OFFSET,
        }
    )
    return fold(requests.unionByName(again), COMMAND_REQUESTS)


@query
def command_log(p: Plant) -> DataFrame:
    return p.command_log


@query
def command_log_from_messages(p: Plant) -> DataFrame:
    checked = routing.check(p.command_messages, ["command.request", "command.ack"])
    return fold(command_changes(routing.table_rows(checked, "command_log")), COMMAND_LOG)


@query
def command_latest(p: Plant) -> DataFrame:
    return readmodel.latest_commands(p.command_log)


@query
def command_lookup(p: Plant) -> DataFrame:
    return readmodel.command_by_id(p.command_log, COMMAND)


@query
def command_append(p: Plant) -> DataFrame:
    requests = p.command_arrivals.filter(F.col("kind") == "request").drop("kind", "status", "arrival")
    return new_commands(requests, F.col("issued_at") + F.expr("INTERVAL '0.75' SECOND"))


@query
def deployment_append(p: Plant) -> DataFrame:
    valid = contracts.validate(p.model_messages, "model").filter(F.col("error").isNull()).drop("raw", "reason", "error")
    return new_deployments(valid, F.lit(AS_OF.isoformat()).cast("timestamp"), "platform-admin")


# --- rollups --------------------------------------------------------------------------


def _rollup(p: Plant, name: str) -> DataFrame:
    return rounded(rollups.rollup(p.measurements, ROLLUPS[name]["width"]), "avg_value")


@query
def rollup_1m(p: Plant) -> DataFrame:
    return _rollup(p, "1m")


@query
def rollup_15m(p: Plant) -> DataFrame:
    return _rollup(p, "15m")


@query
def rollup_1h(p: Plant) -> DataFrame:
    return _rollup(p, "1h")


@query
def rollup_1h_good_quality(p: Plant) -> DataFrame:
    return rounded(rollups.rollup(p.measurements, "1 hour", quality_in=["good"]), "avg_value")


@query
def rollup_refresh(p: Plant) -> DataFrame:
    """The stored rollup knows first arrivals only; the refresh brings its last 14 days up to date."""
    stale = rollups.rollup(p.arrivals.filter(~F.col("event_id").startswith("evt-r")), "15 minutes")
    return rounded(rollups.refresh_named("15m", stale, p.measurements, AS_OF), "avg_value")


@query
def backfill_summary(p: Plant) -> DataFrame:
    return rounded(rollups.series_mean(p.measurements), "avg_value")


@query
def time_group_10s(p: Plant) -> DataFrame:
    return rounded(rollups.time_group(p.measurements, ASSET, SIGNAL, START, END), "value")


@query
def retention_cut(p: Plant) -> DataFrame:
    return rollups.retained(p.measurements, datetime(2025, 2, 15))


@query
def layout_write(p: Plant) -> DataFrame:
    """Rows per day after a write in the clustered layout, read back through a time slice."""
    path = new_folder(p.spark, "layout")
    tables.write_table(p.measurements, path)
    back = tables.time_slice(p.spark.read.parquet(path), START, END)
    return back.groupBy(F.to_date("ts_source").cast("string").alias("day")).agg(F.count("*").alias("rows"))


# --- health and read models -------------------------------------------------------------


@query
def total_measurements(p: Plant) -> DataFrame:
    return health.total_measurements(p.measurements)


@query
def asset_health(p: Plant) -> DataFrame:
    return health.asset_health(p.measurements, p.alarms, AS_OF)


@query
def latest_telemetry(p: Plant) -> DataFrame:
    return health.latest_telemetry(p.measurements, AS_OF)


@query
def open_alarms_by_asset(p: Plant) -> DataFrame:
    return health.open_alarms_by_asset(p.alarms, AS_OF)


@query
def open_alarms_24h(p: Plant) -> DataFrame:
    return health.open_alarm_count(p.alarms, AS_OF)


@query
def latest_site_health(p: Plant) -> DataFrame:
    return health.latest_site_health(p.site_health)


@query
def latest_sites(p: Plant) -> DataFrame:
    return registry.latest_sites(p.site_health)


@query
def ingest_status(p: Plant) -> DataFrame:
    return health.ingest_status(p.site_health, AS_OF)


@query
def latest_spool_depth(p: Plant) -> DataFrame:
    return health.latest_spool_depth(p.site_health)


@query
def telemetry_window(p: Plant) -> DataFrame:
    return readmodel.telemetry_window(p.measurements, p.assets, ASSET, AS_OF, START, END)


@query
def telemetry_window_all(p: Plant) -> DataFrame:
    return readmodel.telemetry_window_all(p.measurements, p.assets, AS_OF, START, END)


@query
def telemetry_points(p: Plant) -> DataFrame:
    """Points as shown: the value as text."""
    return readmodel.points(p.measurements).select("asset_id", "seq", *readmodel.POINT_COLUMNS)


@query
def alarm_list(p: Plant) -> DataFrame:
    return readmodel.alarm_list(p.alarms)


@query
def alarm_list_filtered(p: Plant) -> DataFrame:
    return readmodel.alarm_list(p.alarms, SITE, "open")


@query
def threshold_alarms(p: Plant) -> DataFrame:
    return alarms.breaches(p.measurements, p.thresholds).select(
        "ts_source", "asset_id", "signal_id", "seq", "value", "limit_value"
    )


@query
def device_threshold_alarms(p: Plant) -> DataFrame:
    """Limits per asset and signal, from the device registrations."""
    devices = contracts.validate(p.device_messages, "device", contracts.STRICT).filter(F.col("error").isNull())
    found = alarms.breaches(p.measurements, alarms.device_thresholds(devices))
    return found.select("ts_source", "asset_id", "signal_id", "seq", "value", "limit_value")


@query
def alarm_envelopes(p: Plant) -> DataFrame:
    """The alarm messages of breaching readings, decoded again."""
    sent = alarms.alarm_messages(alarms.breaches(p.measurements, p.thresholds))
    back = contracts.validate(sent.withColumnRenamed("value", "raw"), "telemetry")
    return back.select(
        "key", "event_id", "site_id", "asset_id", "signal_id", "quality", "ts_source", "seq", "unit", "value", "tags", "error"
    )


@query
def asset_detail(p: Plant) -> DataFrame:
    nested = registry.asset_detail(p.assets, p.signals)
    line = F.transform("signals", lambda s: F.concat_ws("|", s["signal_id"], s["unit"], s["sampling_class"]))
    return nested.withColumn("signals", F.array_join(line, ";"))


@query
def asset_signals(p: Plant) -> DataFrame:
    return registry.asset_signals(p.signals, ASSET)


@query
def site_tree(p: Plant) -> DataFrame:
    nested = registry.site_tree(p.site_health, p.assets, p.signals)
    return nested.withColumn("signals", F.array_join(F.transform("signals", lambda s: s["signal_id"]), ";"))


@query
def orphan_signals(p: Plant) -> DataFrame:
    return registry.orphan_signals(p.signals, p.assets)


@query
def owned_signals(p: Plant) -> DataFrame:
    return registry.owned_signals(p.signals, p.assets)


@query
def registry_seed(p: Plant) -> DataFrame:
    """Suppliers offered as assets: only ids the registry does not know are added."""
    offered = p.table("supplier").select(
        F.concat(F.lit("asset-"), F.col("s_suppkey") * 40).alias("asset_id"),
        F.lit("site-new").alias("site_id"),
        F.concat(F.lit("area-"), "s_nationkey").alias("area_id"),
        F.col("s_name").alias("name"),
        F.lit("mqtt").alias("protocol"),
    )
    return insert_if_absent(p.assets, offered, ["asset_id"])


@query
def model_versions(p: Plant) -> DataFrame:
    return readmodel.model_versions(p.model_registry)


# --- contracts, scalars, topics -----------------------------------------------------------


@query
def contract_telemetry(p: Plant) -> DataFrame:
    raw = p.telemetry_messages.select("offset", F.col("value").alias("raw"))
    valid = contracts.validate(raw, "telemetry").drop("raw", "value")
    return valid.withColumn("seq", F.col("seq").cast("string"))


@query
def contract_telemetry_strict(p: Plant) -> DataFrame:
    """As lenient, with tag values as text, which strict mode demands."""
    text_tags = F.regexp_replace("value", r'"k": (\d+)', r'"k":"$1"')
    raw = p.telemetry_messages.select("offset", text_tags.alias("raw"))
    return contracts.validate(raw, "telemetry", contracts.STRICT).select("offset", "reason", "error")


def _requests_raw(p: Plant) -> DataFrame:
    requests = p.command_messages.filter(F.col("topic") == "command.request")
    return requests.select("key", F.col("value").alias("raw"))


@query
def contract_command(p: Plant) -> DataFrame:
    valid = contracts.validate(_requests_raw(p), "command").drop("raw")
    return valid.withColumn("approved", F.col("approved").cast("string"))


@query
def contract_command_strict(p: Plant) -> DataFrame:
    """Without the issue time, which the strict envelope does not know, but for keys that end in 9."""
    known = F.regexp_replace("raw", r',"issuedAt":"[^"]*"', "")
    raw = _requests_raw(p).withColumn("raw", F.when(F.col("key").endswith("9"), F.col("raw")).otherwise(known))
    return contracts.validate(raw, "command", contracts.STRICT).select("key", "reason", "error")


def _map_text(name: str):
    entries = F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return F.array_join(entries, ";")


@query
def contract_device(p: Plant) -> DataFrame:
    valid = contracts.validate(p.device_messages, "device").drop("raw")
    return valid.withColumns({n: _map_text(n) for n in ("signal_map", "units", "ownership_tags")}).withColumn(
        "thresholds", F.coalesce(F.size("thresholds"), F.lit(-1))
    )


@query
def contract_device_strict(p: Plant) -> DataFrame:
    return contracts.validate(p.device_messages, "device", contracts.STRICT).select("asset_key", "reason", "error")


@query
def contract_model(p: Plant) -> DataFrame:
    return contracts.validate(p.model_messages, "model").drop("raw")


@query
def contract_model_strict(p: Plant) -> DataFrame:
    return contracts.validate(p.model_messages, "model", contracts.STRICT).select("p_partkey", "reason", "error")


@query
def numeric_coercion(p: Plant) -> DataFrame:
    payload = Payload(raw="text")
    return with_payload(p.value_cases, F.col("raw"), {"value": NUMBER}, payload).select("event_id", payload.number("value").alias("value"))


@query
def timestamp_normalise(p: Plant) -> DataFrame:
    return p.time_cases.select("event_id", "text", timestamp(F.col("text")).alias("instant"))


@query
def canonical_json(p: Plant) -> DataFrame:
    text = F.concat(
        F.lit('{ "z": '), F.col("event_id"), F.lit(', "b": {"y": true, "x": ['), F.col("user_id"),
        F.lit(', null]}, "a": "'), F.col("event_type"), F.lit('", "z": 0 }'),
    )
    return p.table("events").select("event_id", F.to_json(F.try_parse_json(text)).alias("canonical"))


@query
def dedupe_keys(p: Plant) -> DataFrame:
    sent_as = F.date_format("ts_source", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.arrivals.select("arrival", key_fn.dedupe_key(F.col("site_id"), F.col("signal_id"), sent_as, F.col("seq")).alias("dedupe_key"))


@query
def message_keys(p: Plant) -> DataFrame:
    """Keys of messages with and without an event id, by channel."""
    m = p.device_topics.withColumn("parsed", topic_fn.parse_topic(F.col("topic"))).filter(F.col("parsed.error").isNull())
    payload = Payload()
    key = key_fn.message_key(payload, F.col("parsed.channel"), F.col("parsed.site_id"), F.col("parsed.asset_id"))
    return with_payload(m, _keyed_payload(), key_fn.KEY_READS, payload).select(
        "o_orderkey", key.alias("message_key"), key_fn.key_error(F.col("parsed.channel"), key).alias("key_error")
    )


@query
def forwarded(p: Plant) -> DataFrame:
    """Device messages as log messages; every eleventh payload is not JSON."""
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.lit("no json")).otherwise(_keyed_payload())
    sent = routing.forward(p.device_topics.select("o_orderkey", "topic", raw.alias("value")))
    return sent.select("o_orderkey", "log_topic", "message_key", "error")


def _keyed_payload() -> Column:
    """Payloads per order: with an event id, with the parts of a key, and with neither."""
    order = F.col("o_orderkey")
    return (
        F.when(order % 3 == 0, F.concat(F.lit('{"eventId":"ev-'), order, F.lit('"}')))
        .when(
            order % 3 == 1,
            F.concat(
                F.lit('{"siteId":"s","signalId":"level","commandId":"cmd-'), order,
                F.lit('","ts_source":"2024-01-01T00:00:00Z","seq":'), order, F.lit("}"),
            ),
        )
        .otherwise(F.concat(F.lit('{"commandId":"cmd-'), order, F.lit('","timestamp":"t'), order, F.lit('"}')))
    )


@query
def topic_build(p: Plant) -> DataFrame:
    parts = [F.col(c) for c in ("site_id", "area_id", "asset_id", "channel")]
    return p.topic_parts.select(
        "asset_id", topic_fn.build_topic(*parts).alias("topic"), topic_fn.topic_error(*parts).alias("error")
    )


@query
def topic_parse(p: Plant) -> DataFrame:
    parsed = p.device_topics.select("o_orderkey", topic_fn.parse_topic(F.col("topic")).alias("t"))
    return parsed.select("o_orderkey", "t.*", topic_fn.log_topic(F.col("t.channel")).alias("log_topic"))


@query
def topic_filter(p: Plant) -> DataFrame:
    topic = F.col("topic")
    return p.device_topics.select(
        "o_orderkey",
        topic_fn.topic_filter(topic, DEVICE_TOPIC_FILTER).alias("device"),
        topic_fn.topic_filter(topic, f"site/{SITE}/area/+/asset/+/command/request").alias("requests"),
    )


# --- routing ------------------------------------------------------------------------------


def _routed(p: Plant, topic: str) -> DataFrame:
    return routing.route(routing.check(p.log_of(topic), [topic]), topic).drop("arrival")


@query
def route_telemetry(p: Plant) -> DataFrame:
    return _routed(p, "raw.telemetry")


@query
def route_alarms(p: Plant) -> DataFrame:
    return _routed(p, "raw.alarms")


@query
def route_events(p: Plant) -> DataFrame:
    return _routed(p, "raw.events")


@query
def route_asset_state(p: Plant) -> DataFrame:
    return _routed(p, "asset.state")


@query
def route_command_request(p: Plant) -> DataFrame:
    return _routed(p, "command.request")


@query
def route_command_ack(p: Plant) -> DataFrame:
    return _routed(p, "command.ack")


@query
def route_model_scores(p: Plant) -> DataFrame:
    return _routed(p, "analytics.inference")


@query
def quarantine(p: Plant) -> DataFrame:
    """The log judged as a whole: all topics, all rules, one pass."""
    return routing.quarantine(routing.check(p.log)).drop("raw")


def _device_log(p: Plant) -> DataFrame:
    """Device messages per order; every other payload is not JSON."""
    order = F.col("o_orderkey")
    raw = F.when(order % 2 == 0, F.concat(F.lit('{"n": '), order, F.lit("}"))).otherwise(F.concat(F.lit('say "'), order, F.lit('"')))
    return p.device_topics.withColumns(
        {"value": raw, "timestamp": F.lit(AS_OF.isoformat()).cast("timestamp") + F.make_dt_interval(secs=order % 1000)}
    )


@query
def live_feed(p: Plant) -> DataFrame:
    """Device messages as feed events."""
    return routing.live_feed(_device_log(p), DEVICE_TOPIC_FILTER)


@query
def stream_live_feed(p: Plant) -> DataFrame:
    """The live feed as a stream: four batches of device messages through the file sink."""
    out, log = new_folder(p.spark, "feed"), _device_log(p)
    feed = routing.live_feed(files.stream_files(p.spark, _staged(p, log, "device-log"), log.schema, max_files=1), DEVICE_TOPIC_FILTER)
    _finish(
        feed.writeStream.format("parquet").option("path", f"{out}/messages")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    return p.spark.read.schema(feed.schema).parquet(f"{out}/messages")


# --- commands ---------------------------------------------------------------------------


@query
def command_policy(p: Plant) -> DataFrame:
    return commands.permitted_commands(p.policy_messages, p.allowed_topics).select("command_id", "topic")


def _acked(p: Plant) -> DataFrame:
    """Acks come two minutes after the request, or after 30 seconds for every other order."""
    late = F.when(F.substring("command_id", 5, 20).cast("bigint") % 2 == 0, F.expr("INTERVAL '30' SECOND")).otherwise(
        F.expr("INTERVAL '120' SECOND")
    )
    return p.command_arrivals.withColumn("acked_at", F.when(F.col("kind") == "ack", F.col("issued_at") + late))


@query
def overdue_commands(p: Plant) -> DataFrame:
    return commands.overdue_commands(_acked(p), AS_OF)


@query
def command_reconciliation(p: Plant) -> DataFrame:
    """Purchases stand for acknowledgements, the other events for the states their assets report."""
    acks = p.table("events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("asset-"), "user_id").alias("asset_id"),
        F.concat(F.lit("cmd-"), "event_id").alias("command_id"),
        F.col("ts").alias("acked_at"),
        F.lit("completed").alias("status"),
    )
    states = p.table("events").filter(F.col("event_type") != "purchase").select(
        F.concat(F.lit("asset-"), "user_id").alias("asset_id"), F.col("ts").alias("ts_source"), F.col("event_type").alias("state")
    )
    return commands.reconcile(acks, states)


# --- delivery ----------------------------------------------------------------------------


@query
def fifo_pending(p: Plant) -> DataFrame:
    return delivery.pending(p.spool)


@query
def backlog_depth(p: Plant) -> DataFrame:
    return delivery.backlog_depth(p.spool)


@query
def delivery_log(p: Plant) -> DataFrame:
    return delivery.delivery_state(p.spool, p.delivery_attempts)


@query
def replay_stalled(p: Plant) -> DataFrame:
    return delivery.replay_stalled(p.spool, AS_OF)


@query
def backlog_trend(p: Plant) -> DataFrame:
    return delivery.backlog_trend(p.spool)


# --- windows and scores --------------------------------------------------------------------


@query
def sliding_windows(p: Plant) -> DataFrame:
    """Windows of 32 samples per asset, flattened to text for comparison."""
    found = anomaly.sliding_windows(p.measurements, ["site_id", "asset_id"])
    cents = F.transform("window", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return found.select("site_id", "asset_id", "ts_source", "seq", F.array_join(cents, ",").alias("window"))


def _vectors(p: Plant) -> DataFrame:
    return p.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("window"))


def _centroid_scores(p: Plant) -> DataFrame:
    vectors = _vectors(p)
    means = vectors.select("label", F.posexplode("window").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("at", "x")))
    centroids = means.groupBy("label").agg(F.transform(listed, lambda m: m["x"]).alias("centroid"))
    named = vectors.join(centroids, "label").select(
        F.lit("site-x").alias("site_id"),
        F.concat(F.lit("asset-"), F.col("label")).alias("asset_id"),
        F.concat(F.lit("vec-"), F.col("vec_id")).alias("signal_id"),
        "window", "centroid",
        F.when(F.col("vec_id") % 3 == 0, 0.01).alias("threshold"),
    )
    return anomaly.score(named, F.col("centroid")).drop("centroid")


@query
def window_mse(p: Plant) -> DataFrame:
    """Score against the centroid of the vector's label; a third of the rows name a threshold."""
    return rounded(_centroid_scores(p), "score")


@query
def published_scores(p: Plant) -> DataFrame:
    """Scores as inference messages, routed and folded into the score table."""
    messages = anomaly.score_messages(_centroid_scores(p).withColumn("ts_source", F.lit(AS_OF.isoformat()).cast("timestamp")))
    log = messages.select(
        "key", "value", F.lit("analytics.inference").alias("topic"), F.lit(0).alias("partition"),
        F.xxhash64("key").alias("offset"), F.lit(AS_OF.isoformat()).cast("timestamp").alias("timestamp"),
    )
    return rounded(_folded(p, "analytics.inference", log, MODEL_SCORES).drop("payload"), "score")


@query
def pca_scores(p: Plant) -> DataFrame:
    """Windows of 32 samples per asset seen through a bottleneck of 8: how many are scored, whether the mean error is the
    variance the fit leaves, and whether its directions are orthonormal. No window is stored, neither to fit nor to score."""
    keys = ["site_id", "asset_id"]
    samples = stored(p.measurements.select(*keys, "ts_source", "seq", "value"), "samples")
    fitted = anomaly.bottleneck(anomaly.window_totals(samples, keys))
    scored = anomaly.window_errors(samples, keys, fitted)
    sums = stored(scored.groupBy(*keys).agg(F.count("score").alias("windows"), F.sum("score").alias("error")), "errors")
    error, windows = sums.agg(F.sum("error"), F.sum("windows")).first()
    length, k = fitted.directions.shape
    orthonormal = bool(abs(fitted.directions.T @ fitted.directions - np.eye(k)).max() < 1e-9)
    agrees = abs(error / windows * length - fitted.residual) <= 1e-6 * max(fitted.residual, 1.0)
    return sums.select(*keys, "windows", F.lit(bool(agrees)).alias("error_is_residual"), F.lit(orthonormal).alias("orthonormal"))


@query
def window_moments(p: Plant) -> DataFrame:
    """Mean and variance of every position of the 32-sample windows per asset."""
    windows = anomaly.sliding_windows(p.measurements, ["site_id", "asset_id"])
    each = windows.select(F.posexplode("window").alias("position", "x"))
    found = each.groupBy("position").agg(F.count("x").alias("windows"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "variance")})


# --- streams -------------------------------------------------------------------------------


def _stream(p: Plant, name: str) -> DataFrame:
    path = f"{p.folder}/{name}.parquet"
    return files.stream_files(p.spark, path, p.table(name).schema)


def _finish(running) -> None:
    running.awaitTermination()


#: Where the telemetry of a month is cut into four batches, and where the whole log is.
MONTH = (datetime(2024, 1, 8), datetime(2024, 1, 16), datetime(2024, 1, 24))
YEARS = (datetime(1998, 6, 1), datetime(2024, 1, 10), datetime(2024, 1, 20))


#: Messages to a file of a feed, about: a file is read by one task, and parsing a message is most of the work.
ROWS_A_FILE = 25_000


class _Feed:
    """A log as a stream of four batches in the order of time, each written when it is asked for, so that a job can be
    stopped between two of them and started again."""

    def __init__(self, p: Plant, log: DataFrame, edges: tuple[datetime, ...], purpose: str):
        self.p, self.log, self.path = p, log, new_folder(p.spark, purpose)
        bounds = [F.col("timestamp") >= F.lit(e) for e in edges]
        self.part = sum((b.cast("int") for b in bounds), F.lit(0))
        sizes = log.select(*[F.count_if(self.part == k) for k in range(len(edges) + 1)]).first()
        # Every batch has to be as many files, none of them empty: two, or more where all batches are large.
        most = int(p.spark.conf.get("spark.sql.shuffle.partitions"))
        self.files = max(2, min(max(sizes) // ROWS_A_FILE, min(sizes) // 1000, most))

    def write(self, *parts: int) -> None:
        for k in parts:
            # Files are read in the order of their times: a batch is the files of one part.
            rows = self.log.filter(self.part == k)
            # Dealing in turn sorts every row first, dealing by hash does not; but few rows may miss a file by hash.
            dealt = rows.repartition(2) if self.files == 2 else rows.repartition(self.files, *rows.columns)
            dealt.write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return files.stream_files(self.p.spark, self.path, self.log.schema, max_files=self.files)


@query
def stream_features_1m(p: Plant) -> DataFrame:
    """One-minute means of four batches through the file sink as JSON, decoded; closed windows only. The job stops with
    windows open and goes on after its restart."""
    out, feed = new_folder(p.spark, "features"), _Feed(p, p.telemetry_messages, MONTH, "feature-log")
    for parts in ((0, 1), (2, 3)):
        feed.write(*parts)
        _finish(features.feature_job(feed.stream(), lambda m: m.writeStream.format("text").option("path", f"{out}/messages"), f"{out}/checkpoint"))
    schema = "siteId string, assetId string, signalId string, windowStart timestamp, windowEnd timestamp, avg_value double"
    decoded = p.spark.read.schema("value string").text(f"{out}/messages").select(F.from_json("value", schema).alias("m")).select("m.*")
    return decoded.select(
        F.col("siteId").alias("site_id"), F.coalesce("assetId", F.lit("-")).alias("asset_id"), F.col("signalId").alias("signal_id"),
        F.col("windowStart").alias("window_start"), F.col("windowEnd").alias("window_end"),
        F.coalesce(F.round("avg_value", 6), F.lit(-1.0)).alias("avg_value"),
    )


@query
def feature_fields(p: Plant) -> DataFrame:
    """All twelve fields the feature job parses, of messages that are JSON objects."""
    parsed = features.parsed_telemetry(p.telemetry_messages).filter(F.col("event_id").isNotNull())
    return rounded(parsed, "value")


@query
def stream_ingest(p: Plant) -> DataFrame:
    """The log of all topics streamed into its six tables in four batches with one restart, compacted and read: one row set
    per table, with the columns of all as text. The measurements are compacted first."""
    named = F.col("value").contains('"eventId"') & F.col("value").contains('"eventType":"error"')
    events = _again(p.event_messages, named, {'"site-x"': '"site-y"', '"eventType":"error"': '"eventType":"fault"'})
    failing = F.col("value").contains('"state":"error"')
    states = _again(p.state_messages, failing, {'"site-x"': '"site-y"', '"state":"error"': '"state":"fault"'})
    log = p.telemetry_messages
    for more in (p.alarm_messages, events, states, p.command_messages, p.score_messages, p.audit_messages):
        log = log.unionByName(more)
    feed, path = _Feed(p, log, YEARS, "ingest-log"), new_folder(p.spark, "ingest")
    for parts in ((0, 1), (2, 3)):
        feed.write(*parts)
        ingest = Ingest(p.spark, path)
        _finish(ingest.start(feed.stream(), availableNow=True))
    ingest.tables["measurements"].compact()
    found = None
    for name, table in ingest.tables.items():
        rows = table.read().select(F.lit(name).alias("target"), *[F.col(c).cast("string") for c in table.schema.names])
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


@query
def stream_rollups(p: Plant) -> DataFrame:
    """Rollups of three widths kept by the changes of four ingest batches."""
    path, feed = new_folder(p.spark, "rolled"), _Feed(p, p.telemetry_messages, MONTH, "rollup-log")
    kept = {name: rolled.StoredRollup(p.spark, f"{path}/rollup-{name}", policy["width"]) for name, policy in ROLLUPS.items()}
    ingest = Ingest(p.spark, path, ["measurements"], after=lambda batch: [r.refresh(ingest.tables["measurements"], batch) for r in kept.values()])
    feed.write(0, 1, 2, 3)
    _finish(ingest.start(feed.stream(), availableNow=True))
    found = [rounded(r.read(), "avg_value").withColumn("rollup", F.lit(name)) for name, r in kept.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _unique_feed(p: Plant) -> unique.UniqueFeed:
    """Telemetry with repeats: every seventh message twice in its batch, every eleventh of a batch's last half day once more
    in the next one; a restart after two batches."""
    number = F.regexp_extract("key", "[0-9]+", 0).cast("bigint")
    log = p.telemetry_messages
    again = log.filter(number % 7 == 0)
    last = [F.col("timestamp").between(F.lit(e - timedelta(hours=12)), F.lit(e - timedelta(microseconds=1))) for e in MONTH]
    carried = log.filter((number % 11 == 0) & (last[0] | last[1] | last[2])).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 12 HOUR"))
    feed = _Feed(p, log.unionByName(again).unionByName(carried), MONTH, "unique-log")
    kept = unique.UniqueFeed(p.spark, new_folder(p.spark, "unique"), ["event_id"], "ts_source", "1 day")
    for parts in ((0, 1), (2, 3)):
        feed.write(*parts)
        parsed = features.parsed_telemetry(feed.stream(), "event_id", "signal_id", "ts_source")
        kept.run(parsed.filter("event_id IS NOT NULL AND ts_source IS NOT NULL"))
    return kept


@query
def stream_unique(p: Plant) -> DataFrame:
    """Each message once, whatever the feed repeats."""
    return _unique_feed(p).rows("event_id string, signal_id string, ts_source timestamp")


@query
def delivery_counters(p: Plant) -> DataFrame:
    """Messages seen, unique, repeated and late in every batch of the same feed."""
    return _unique_feed(p).counters().drop("batch")


@query
def stream_overdue_commands(p: Plant) -> DataFrame:
    """Requests never acknowledged in time, as a stream of four batches; a last one only moves the time on."""
    at = F.when(F.col("kind") == "ack", F.col("acked_at")).otherwise(F.col("issued_at"))
    changes = _acked(p).select("kind", "command_id", *[F.col(c).cast("timestamp") for c in ("issued_at", "acked_at")], at.cast("timestamp").alias("timestamp"))
    feed = _Feed(p, changes, (datetime(1996, 9, 1), datetime(1998, 5, 1), datetime(2000, 1, 1)), "commands")
    out = new_folder(p.spark, "overdue")
    feed.write(0, 1, 2, 3)
    beat = F.lit(AS_OF.isoformat()).cast("timestamp")
    nobody = p.spark.range(2).select(F.lit("beat").alias("kind"), F.lit(None).cast("string").alias("command_id"), *[beat.alias(c) for c in ("issued_at", "acked_at", "timestamp")])
    nobody.repartition(2).write.mode("append").parquet(feed.path)
    found = commands.overdue_stream(feed.stream())
    _finish(
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    return p.spark.read.schema(found.schema).parquet(f"{out}/rows")


def _scoring_job(p: Plant) -> scoring.ScoringJob:
    """The vectors as JSON lines, each seventh without its asset and each ninth cut short, scored in four batches with a
    restart; the model is the mean of nothing: every window is rebuilt as zeros."""
    vectors = _vectors(p).select("vec_id", "label", F.slice("window", 1, 32).alias("window"))
    body = F.to_json(F.struct(
        F.concat(F.lit("vec-"), "vec_id").alias("signalId"), F.lit("site-x").alias("siteId"),
        F.when(F.col("vec_id") % 7 != 0, F.concat(F.lit("asset-"), "label")).alias("assetId"),
        "window", F.lit("2024-01-30T00:00:00Z").alias("ts_source"), F.when(F.col("vec_id") % 3 == 0, F.lit(0.01)).alias("threshold"),
    ))
    lines = vectors.select(F.when(F.col("vec_id") % 9 == 0, F.left(body, F.lit(20))).otherwise(body).alias("value"), (F.col("vec_id") % 4).alias("part"))
    source, path = new_folder(p.spark, "lines"), new_folder(p.spark, "scored")
    job = scoring.ScoringJob(p.spark, path, "zero-model", "v1", lambda w: F.transform(w, lambda x: F.lit(0.0)))
    for parts in ((0, 1), (2, 3)):
        for k in parts:
            lines.filter(F.col("part") == k).select("value").coalesce(1).write.mode("append").text(source)
        _finish(job.start(p.spark.readStream.option("maxFilesPerTrigger", 1).text(source)))
    return job


@query
def scored_lines(p: Plant) -> DataFrame:
    """Scores of windows that came as JSON lines."""
    return rounded(_scoring_job(p).scores().select("asset_id", "signal_id", "model_id", "threshold", "score", "anomalous"), "score")


@query
def scoring_manifest(p: Plant) -> DataFrame:
    """What every batch of score lines gave."""
    return _scoring_job(p).manifest().select("batch", "model_id", "version", "scored", "rejected", "anomalous")


def _live(p: Plant, view: DataFrame, keys: list[str]) -> live.LiveView:
    shown = live.LiveView(p.spark, new_folder(p.spark, "live"), keys)
    _finish(shown.start(view, availableNow=True))
    return shown


@query
def live_latest_telemetry(p: Plant) -> DataFrame:
    view = live.latest_telemetry(p.arrivals_of(_in_batches(p, "events")))
    return _live(p, view, ["asset_id"]).read("ts_source", datetime(2024, 1, 30, 23, 58), timedelta(hours=12))


@query
def live_open_alarms(p: Plant) -> DataFrame:
    opened = p.alarms_of(p.arrivals_of(_in_batches(p, "events")), "arrival")
    return _live(p, live.latest_open_alarms(opened, ["arrival"]), ["site_id"]).read()


@query
def live_command_status(p: Plant) -> DataFrame:
    """Current records from the stored command table; the stream keeps no state."""
    changes = command_changes(p.command_arrivals_of(_in_batches(p, "orders")))
    kinds = dict(changes.dtypes)
    view = live.CommandStatusView(p.spark, new_folder(p.spark, "status"), kinds["arrival"])
    _finish(view.start(changes, availableNow=True))
    return view.read()


def _staged(p: Plant, df: DataFrame, purpose: str) -> str:
    """Write a derived table as the files a stream then reads, several per run."""
    path = new_folder(p.spark, purpose)
    df.repartition(4).write.parquet(path)
    return path


def _in_batches(p: Plant, name: str) -> DataFrame:
    """A table as a stream of four batches, so that state is carried over: a file each, or more where the table is large,
    because a file is read by one task."""
    table, path = p.table(name), new_folder(p.spark, name)
    each = max(1, min(table.count() // (4 * ROWS_A_FILE), int(p.spark.conf.get("spark.sql.shuffle.partitions"))))
    # Dealing in turn sorts every row first, dealing by hash does not; but few rows may miss a file by hash.
    dealt = table.repartition(4) if each == 1 else table.repartition(4 * each, *table.columns)
    dealt.write.parquet(path)
    return files.stream_files(p.spark, path, table.schema, max_files=each)


@query
def live_site_connectivity(p: Plant) -> DataFrame:
    inputs = p.site_health.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    stream = files.stream_files(p.spark, _staged(p, inputs, "health"), SITE_HEALTH, max_files=2)
    return _live(p, live.site_connectivity(stream), ["site_id"]).read()


@query
def stream_replay(p: Plant) -> DataFrame:
    """Spooled records published in several batches, and a restart that finds nothing new."""
    source, out = _staged(p, p.spool, "spool"), new_folder(p.spark, "replay")
    for _ in range(2):
        _finish(replay.replay(p.spark, source, out, max_files=2))
    return replay.published(p.spark, out)


@query
def keyed_replay(p: Plant) -> DataFrame:
    """The spool published in four batches with a restart, every record with its place in its asset's key."""
    pending = p.spool.withColumn("message_key", F.concat(F.lit("asset-"), F.col("row_id") % 50)).withColumn("timestamp", F.col("created_at").cast("timestamp"))
    # Records are spooled in the order of their numbers: four runs of them are the batches.
    spread = pending.select("row_id").approxQuantile("row_id", [0.25, 0.5, 0.75], 0.01)
    source, job = new_folder(p.spark, "keyed-spool"), replay.KeyedReplay(p.spark, new_folder(p.spark, "keyed"))
    part = sum(((F.col("row_id") >= e).cast("int") for e in spread), F.lit(0))
    for parts in ((0, 1), (2, 3)):
        for k in parts:
            pending.filter(part == k).drop("timestamp").repartition(2).write.mode("append").parquet(source)
        _finish(job.run(source, max_files=2))
    if job.gaps().head(1):
        raise RuntimeError("published numbers have gaps")
    return job.published()
