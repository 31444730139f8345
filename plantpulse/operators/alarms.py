"""Threshold alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_THRESHOLDS


def default_thresholds(spark: SparkSession) -> DataFrame:
    """The fixed limits as an in-plan relation, whose size the planner knows."""
    rows = ", ".join(f"('{signal}', {limit}D)" for signal, limit in DEFAULT_THRESHOLDS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(signal_id, limit_value)")


def device_thresholds(devices: DataFrame) -> DataFrame:
    """Limits per asset and signal from device registrations."""
    return devices.select("asset_id", F.explode("thresholds").alias("signal_id", "limit_value"))


def breaches(telemetry: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Readings above the limit of their signal (and asset, when the limits name assets).

    No side is forced to be broadcast: the planner does so only under its size threshold
    and splits hot signals of a sort-merge join otherwise.
    """
    keys = [c for c in ("asset_id", "signal_id") if c in thresholds.columns]
    return telemetry.join(thresholds, keys).filter(F.col("value") > F.col("limit_value"))


def alarm_messages(breaching: DataFrame) -> DataFrame:
    """Alarm envelopes of breaching readings."""
    message = F.concat(F.col("signal_id"), F.lit(" threshold exceeded"))
    tags = F.struct(F.lit("high").alias("severity"), message.alias("message"))
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    envelope = F.struct(
        F.concat(F.lit("alm-"), F.col("event_id")).alias("eventId"),
        F.col("site_id").alias("siteId"),
        F.col("asset_id").alias("assetId"),
        F.col("signal_id").alias("signalId"),
        F.lit("bad").alias("quality"),
        F.date_format("ts_source", iso).alias("ts_source"),
        F.date_format("ts_ingest", iso).alias("ts_ingest"),
        "seq",
        "unit",
        "value",
        tags.alias("tags"),
        F.col("trace_id").alias("traceId"),
    )
    return breaching.select(F.concat(F.lit("alm-"), F.col("event_id")).alias("key"), F.to_json(envelope).alias("value"))
