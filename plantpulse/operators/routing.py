"""Demultiplex one message log into typed tables, with a quarantine for the rest.

The log has the columns of a Kafka read: key, value, topic, partition, offset, timestamp.
``check`` parses and validates every message once; the routes and the quarantine are
filters over its result. Each routed row carries ``arrival``, the order in which
messages of one key take effect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import KEY_READS, key_error, message_key
from ..functions.payload import NUMBER, TEXT, FlatPayload, Payload, with_payload, with_payloads
from ..functions import rules as R
from ..functions.rules import REJECTED, Rule, first_failure, rule, with_failure
from ..functions.topics import log_topic, parse_topic, topic_filter
from ..schemas import TABLES
from . import contracts as C
from .upsert import COMMAND_LOG

# What a command acknowledgement writes when no request is known yet.
ACK_PLACEHOLDER = {
    "target_signal": "",
    "requested_value": "",
    "requested_by": "system",
    "priority": "medium",
    "approved": True,
    "approval_reference": "",
}

# Where a message's own time may stand, in order.
SOURCE_TIME = ("ts_source", "timestamp")

# --- rules per topic ------------------------------------------------------------------


def _first_time(p: Payload, *names: str) -> tuple[Column, Column]:
    """Text and instant of the first of the fields that is neither absent nor empty."""
    given = [F.coalesce(p.text(n), F.lit("")) != "" for n in names]
    text, time = F.when(given[0], p.text(names[0])), F.when(given[0], p.time(names[0]))
    for name, has in zip(names[1:], given[1:]):
        text, time = text.when(has, p.text(name)), time.when(has, p.time(name))
    return text, time


def _time_rule(p: Payload, *names: str) -> Rule:
    text, time = _first_time(p, *names)
    return rule(text.isNotNull() & time.isNull(), F.concat(F.lit(R.BAD_TIME), text))


def _alarm_rules(p: Payload) -> list[Rule]:
    return C.telemetry_rules(p)


def _measurement_rules(p: Payload) -> list[Rule]:
    return C.telemetry_rules(p) + C.value_rules(p)


def _event_rules(p: Payload) -> list[Rule]:
    return C.payload_rules(p) + [_time_rule(p, *SOURCE_TIME)]


def _state_rules(p: Payload) -> list[Rule]:
    return C.payload_rules(p) + [
        _time_rule(p, *SOURCE_TIME),
        *[rule(p.text(n).isNull(), R.ABSENT.format(n)) for n in ("siteId", "assetId")],
    ]


def _request_rules(p: Payload) -> list[Rule]:
    return C.command_rules(p) + [_time_rule(p, "issuedAt")]


def _ack_rules(p: Payload) -> list[Rule]:
    return C.payload_rules(p) + [
        rule(p.text("commandId").isNull(), R.ABSENT.format("commandId")),
        _time_rule(p, "issuedAt"),
        _time_rule(p, "expiresAt"),
    ]


def _score_rules(p: Payload) -> list[Rule]:
    return C.payload_rules(p) + [
        _time_rule(p, *SOURCE_TIME),
        rule(F.coalesce(p.kind("score"), F.lit("VOID")) == "VOID", R.NO_SCORE),
        *[rule(p.text(n).isNull(), R.ABSENT.format(n)) for n in ("siteId", "assetId", "signalId")],
        rule(p.number("score").isNull(), "score is not numeric"),
    ]


# --- typed rows per topic -------------------------------------------------------------

def _time_or_sent(p: Payload, *names: str) -> Column:
    """Messages without a time take the time the log recorded, so a replay gives the same row."""
    return F.coalesce(_first_time(p, *names)[1], F.col("timestamp"))


def _measurement(p: Payload) -> dict[str, Column]:
    f = C.telemetry_fields(p)
    order = ["ts_source", "ts_ingest", "event_id", "site_id", "asset_id", "signal_id", "seq", "quality", "unit", "value", "tags", "trace_id"]
    return {name: f[name] for name in order}


def _tag(p: Payload, name: str) -> Column:
    return p.get(f"tags.{name}", "string")


def _alarm(p: Payload) -> dict[str, Column]:
    f = C.telemetry_fields(p)
    return {
        "raised_at": f["ts_source"],
        "alarm_id": f["event_id"],
        "site_id": f["site_id"],
        "asset_id": f["asset_id"],
        "severity": F.coalesce(_tag(p, "severity"), F.lit("medium")),
        "message": F.coalesce(_tag(p, "message"), F.concat(f["signal_id"], F.lit(" threshold exceeded"))),
        "state": F.lit("open"),
        "acknowledged_at": F.lit(None).cast("timestamp"),
        "payload": p.canonical(),
    }


def _event(p: Payload) -> dict[str, Column]:
    position = F.concat_ws("-", F.lit("evt"), F.col("topic"), F.col("partition"), F.col("offset"))
    return {
        "ts_source": _time_or_sent(p, *SOURCE_TIME),
        "event_id": F.coalesce(p.text("eventId"), p.text("id"), position),
        "site_id": F.coalesce(p.text("siteId"), F.lit("unknown-site")),
        "asset_id": F.coalesce(p.text("assetId"), F.lit("unknown-asset")),
        "event_type": F.coalesce(p.text("eventType"), p.text("type"), F.lit("generic-event")),
        "payload": p.canonical(),
    }


def _state(p: Payload) -> dict[str, Column]:
    return {
        "ts_source": _time_or_sent(p, *SOURCE_TIME),
        "site_id": p.text("siteId"),
        "asset_id": p.text("assetId"),
        "state": F.coalesce(p.display("state"), p.display("value"), F.lit("unknown")),
        "payload": p.canonical(),
    }


COMMAND_COLUMNS = [
    "kind", "issued_at", "command_id", "site_id", "asset_id", "target_signal", "requested_value",
    "requested_by", "priority", "approved", "approval_reference", "expires_at", "status",
]


def _request(p: Payload) -> dict[str, Column]:
    f = C.command_fields(p)
    f["kind"] = F.lit("request")
    f["issued_at"] = _time_or_sent(p, "issuedAt")
    return {name: f[name] for name in COMMAND_COLUMNS}


def _ack(p: Payload) -> dict[str, Column]:
    f = {name: F.lit(default) for name, default in ACK_PLACEHOLDER.items()}
    f.update(
        kind=F.lit("ack"),
        issued_at=_time_or_sent(p, "issuedAt"),
        command_id=p.text("commandId"),
        site_id=F.coalesce(p.text("siteId"), F.lit("unknown-site")),
        asset_id=F.coalesce(p.text("assetId"), F.lit("unknown-asset")),
        expires_at=_time_or_sent(p, "expiresAt"),
        status=F.coalesce(p.text("status"), F.lit("acknowledged")),
    )
    return {name: f[name] for name in COMMAND_COLUMNS}


def _score(p: Payload) -> dict[str, Column]:
    return {
        "ts_source": _time_or_sent(p, *SOURCE_TIME),
        "model_id": F.coalesce(p.text("modelId"), F.lit("unknown-model")),
        "site_id": p.text("siteId"),
        "asset_id": p.text("assetId"),
        "signal_id": p.text("signalId"),
        "score": p.number("score"),
        "anomalous": p.truthy("anomalous"),
        "payload": p.canonical(),
    }


@dataclass(frozen=True)
class Route:
    """How one topic becomes table rows. A caller may add routes for topics of its own."""

    table: str
    reads: dict[str, str]  # keys of the payload the rules and fields look at, and how
    rules: Callable[[Payload], list[Rule]]
    fields: Callable[[Payload], dict[str, Column]]


_WHO = ["siteId", "assetId"]

ROUTES = {
    "raw.telemetry": Route("measurements", C.TELEMETRY_READS, _measurement_rules, _measurement),
    "raw.alarms": Route("alarms", C.TELEMETRY_READS, _alarm_rules, _alarm),
    "raw.events": Route(
        "events", C.reads([*SOURCE_TIME, "eventId", "id", *_WHO, "eventType", "type"], SOURCE_TIME), _event_rules, _event
    ),
    "asset.state": Route(
        "asset_state", C.reads([*SOURCE_TIME, *_WHO, "state", "value"], SOURCE_TIME), _state_rules, _state
    ),
    "command.request": Route(
        "command_log", {**C.COMMAND_READS, **C.reads(["issuedAt"], ("issuedAt",))}, _request_rules, _request
    ),
    "command.ack": Route(
        "command_log",
        C.reads(["commandId", *_WHO, "issuedAt", "expiresAt", "status"], ("issuedAt", "expiresAt")),
        _ack_rules, _ack,
    ),
    "analytics.inference": Route(
        "model_scores",
        C.reads([*SOURCE_TIME, "modelId", *_WHO, "signalId", "score", "anomalous"], SOURCE_TIME, score=NUMBER),
        _score_rules, _score,
    ),
}


# --- operators ------------------------------------------------------------------------


def _all_reads(routes: list[Route]) -> dict[str, str]:
    """Readings of several routes. A typed reading includes the text, so it serves both."""
    merged: dict[str, str] = {}
    for r in routes:
        for name, reading in r.reads.items():
            if merged.get(name, TEXT) == TEXT:
                merged[name] = reading
    return merged


ARRIVAL_ORDER = ("timestamp", "partition", "offset")


def check(
    log: DataFrame, topics: list[str] | None = None, routes: dict[str, Route] = ROUTES, arrival: tuple[str, ...] = ARRIVAL_ORDER,
) -> DataFrame:
    """Parse each message once; add ``raw``, ``body``, its fields, ``arrival`` and the first ``failure``.

    With ``topics`` only their messages are read and only their rules are evaluated;
    without, every message of the log is judged and unknown topics fail. ``arrival`` names
    the columns that order arrivals: where a key stays in one partition and producers' times
    may run back, ``("partition", "offset")`` follows the log itself.
    """
    chosen = routes if topics is None else {t: routes[t] for t in topics}
    if topics is not None:
        log = log.filter(F.col("topic").isin(topics))
    p = Payload()
    parsed = with_payload(log, F.col("value").cast("string"), _all_reads(list(chosen.values())), p)
    checked = parsed.select(
        "key", "topic", "partition", "offset", "timestamp", "raw", "body", "fields", "typed",
        F.struct(*arrival).alias("arrival"),
    )
    return with_failure(checked, _first_failure(chosen, dict.fromkeys(chosen, p)))


def _first_failure(routes: dict[str, Route], payload: dict[str, Payload]) -> Column:
    """The first rule of its topic that a message breaks; a topic without a route is a failure."""
    unknown = F.concat(F.lit(R.NO_TABLE), F.coalesce(F.col("topic"), F.lit("")))
    failure = F.when(
        ~F.coalesce(F.col("topic").isin(*routes), F.lit(False)),
        F.struct(F.lit(REJECTED).alias("reason"), unknown.alias("error")),
    )
    for topic, r in routes.items():
        failure = failure.when(F.col("topic") == topic, first_failure(r.rules(payload[topic])))
    return failure


def route(checked: DataFrame, topic: str, routes: dict[str, Route] = ROUTES) -> DataFrame:
    """Typed rows of one topic plus ``arrival``."""
    good = checked.filter((F.col("topic") == topic) & F.col("failure").isNull())
    return good.select(*[c.alias(name) for name, c in routes[topic].fields(Payload()).items()], "arrival")


def table_rows(checked: DataFrame, table: str) -> DataFrame:
    """Typed rows of every topic that feeds a table; each topic reads its own fields from its own messages only."""
    parts = [route(checked, topic) for topic, r in ROUTES.items() if r.table == table]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def sorted_out(log: DataFrame, tables: list[str]) -> DataFrame:
    """Every message with its ``target`` (one of the tables, or ``quarantine``) and its row packed in the column of that name.

    One pass for all targets: written by target, each is a folder of its own. Rows have the columns of the stored table and
    ``arrival``; messages for other tables are left out. Messages are judged as by ``check``, but each is read for the fields
    of its own topic only, and the first failure is a plain column: rules inside a generator run uncompiled.
    """
    # Topics that read the same share what is read.
    kinds: list[tuple[FlatPayload, list[str], dict[str, str]]] = []
    for topic, r in ROUTES.items():
        same = next((topics for _, topics, reads in kinds if reads == r.reads), None)
        if same is None:
            kinds.append((FlatPayload(f"kind{len(kinds)}"), [topic], r.reads))
        else:
            same.append(topic)
    payload = {topic: p for p, topics, _ in kinds for topic in topics}
    failure = _first_failure(ROUTES, payload)
    failed = F.col("failure").isNotNull()
    target, packed = F.when(failed, "quarantine"), {}
    for topic, r in ROUTES.items():
        if r.table not in tables:
            continue
        target = target.when(F.col("topic") == topic, r.table)
        fields = r.fields(payload[topic])
        if r.table == COMMAND_LOG.table:
            # As in command_changes: only a request knows value and approval.
            fields |= {name: F.when(fields["kind"] == "request", fields[name]) for name in COMMAND_LOG.last_known}
        columns = [fields[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[r.table])]
        here = ~failed & (F.col("topic") == topic)
        row = F.struct(*columns, "arrival")
        packed[r.table] = packed[r.table].when(here, row) if r.table in packed else F.when(here, row)
    rejected = F.struct("topic", "partition", "offset", "failure.reason", "failure.error", F.col("raw").cast("string").alias("raw"))
    packed["quarantine"] = F.when(failed, rejected)
    parsed = with_payloads(log, F.col("value").cast("string"), [(p, F.col("topic").isin(topics), reads) for p, topics, reads in kinds])
    judged = parsed.withColumns({"arrival": F.struct(*ARRIVAL_ORDER), "failure": failure})
    if not {r.table for r in ROUTES.values()} <= set(tables):
        # As in ``with_failure``: a filter on a plain column would be moved below the rules and take a second copy of them along.
        judged = judged.withColumn("_target", F.explode(F.array(target))).filter(F.col("_target").isNotNull())
        target = F.col("_target")
    return judged.select(target.alias("target"), *[c.alias(name) for name, c in packed.items()])


def quarantine(checked: DataFrame) -> DataFrame:
    """Messages that no table takes, with where they came from and why."""
    return checked.filter(F.col("failure").isNotNull()).select(
        "topic", "partition", "offset", F.col("failure.reason").alias("reason"), F.col("failure.error").alias("error"), "raw"
    )


def live_feed(log: DataFrame, pattern: str, topic: str = "topic", payload: str = "value", received: str = "timestamp") -> DataFrame:
    """Messages of matching device topics as ``{topic, receivedAt, payload}`` JSON.

    A payload that is not JSON is carried as text.
    """
    text = F.col(payload).cast("string")
    carried = F.coalesce(F.try_parse_json(text), text.cast("variant"))
    shown_at = F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return log.filter(topic_filter(F.col(topic), pattern)).select(
        F.col(topic).alias("topic"),
        F.to_json(F.struct(F.col(topic).alias("topic"), shown_at.alias("receivedAt"), carried.alias("payload"))).alias("value"),
    )


def forward(messages: DataFrame, topic: str = "topic", payload: str = "value") -> DataFrame:
    """Device messages with the ``log_topic`` and ``message_key`` they are sent on under.

    Messages that cannot be sent have neither, and the reason in ``error``: topic, payload, then key.
    """
    p = Payload()
    placed = messages.withColumn("_place", parse_topic(F.col(topic)))
    channel = F.col("_place.channel")
    key = message_key(p, channel, F.col("_place.site_id"), F.col("_place.asset_id"))
    error = F.coalesce(
        F.col("_place.error"), F.when(~F.coalesce(p.is_json(), F.lit(False)), R.NOT_JSON), key_error(channel, key)
    )
    judged = with_payload(placed, F.col(payload).cast("string"), KEY_READS, p).select(
        *messages.columns, log_topic(channel).alias("log_topic"), key.alias("message_key"), error.alias("error")
    )
    sent = F.col("error").isNull()
    return judged.withColumns({name: F.when(sent, F.col(name)) for name in ("log_topic", "message_key")})
