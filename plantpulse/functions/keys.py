"""Idempotent keys of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .payload import TEXT, WHOLE, Payload

#: What ``message_key`` reads of a payload.
KEY_READS = {n: WHOLE if n == "seq" else TEXT for n in ("eventId", "siteId", "signalId", "ts_source", "timestamp", "seq", "commandId")}


def dedupe_key(site_id: Column, signal_id: Column, ts_source_text: Column, seq: Column) -> Column:
    """``site:signal:ts_source:seq`` over the timestamp text as sent; NULL when a part is missing."""
    colon = F.lit(":")
    return F.concat(site_id, colon, signal_id, colon, ts_source_text, colon, seq.cast("string"))


def message_key(p: Payload, channel: Column, site_id: Column, asset_id: Column) -> Column:
    """The event id; else the dedupe key of telemetry or the command id; else a composite.

    Site and asset come from the device topic, the rest from the payload. Incomplete telemetry
    and requests without a command id have no key: NULL, with the reason in ``key_error``.
    """
    telemetry = dedupe_key(
        p.text("siteId"), p.text("signalId"), p.text("ts_source"), p.whole_number("seq")
    )
    composite = F.concat_ws(
        ":",
        site_id,
        asset_id,
        F.coalesce(p.text("signalId"), channel),
        F.coalesce(p.text("ts_source"), p.text("timestamp"), F.lit("na")),
    )
    return (
        F.when(p.present("eventId"), p.text("eventId"))
        .when(channel == "telemetry", telemetry)
        .when(channel == "command/request", p.text("commandId"))
        .otherwise(composite)
    )


def key_error(channel: Column, key: Column) -> Column:
    """Why a message has no key; NULL when it has one."""
    lacking = F.when(channel == "telemetry", "telemetry lacks site, signal, source time or sequence").otherwise("message lacks an id")
    return F.when(key.isNull(), lacking)
