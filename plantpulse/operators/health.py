"""Operational health: assets, sites, ingest."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import literal
from .ordering import newest


def latest_telemetry(measurements: DataFrame, as_of: datetime, within: timedelta = timedelta(hours=24)) -> DataFrame:
    """Newest reading per asset in the look-back."""
    recent = measurements.filter(F.col("ts_source") >= literal(as_of - within, measurements, "ts_source"))
    return newest(
        recent, ["asset_id"], ["ts_source", "seq", "signal_id"], ["site_id", "ts_source", "quality"]
    )


def open_alarms_by_asset(alarms: DataFrame, as_of: datetime, within: timedelta = timedelta(hours=24)) -> DataFrame:
    """Open alarms per asset that had any alarm in the look-back."""
    recent = alarms.filter(F.col("raised_at") >= literal(as_of - within, alarms, "raised_at"))
    return recent.groupBy("asset_id").agg(F.count_if(F.col("state") == "open").alias("open_alarm_count"))


def asset_health(measurements: DataFrame, alarms: DataFrame, as_of: datetime, stale_after: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Attention when an alarm is open, stale when the last reading is old, else healthy."""
    latest = latest_telemetry(measurements, as_of)
    joined = latest.join(open_alarms_by_asset(alarms, as_of), "asset_id", "left")
    count = F.coalesce("open_alarm_count", F.lit(0))
    stale = F.col("ts_source") < literal(as_of - stale_after, latest, "ts_source")
    return joined.select(
        F.col("ts_source").alias("time"),
        "asset_id",
        F.when(count > 0, "attention").when(stale, "stale").otherwise("healthy").alias("health"),
        count.alias("open_alarm_count"),
        "quality",
    ).orderBy("asset_id")


def open_alarm_count(alarms: DataFrame, as_of: datetime, within: timedelta = timedelta(hours=24)) -> DataFrame:
    recent = alarms.filter(
        (F.col("state") == "open") & (F.col("raised_at") >= literal(as_of - within, alarms, "raised_at"))
    )
    return recent.agg(F.count("*").alias("open_alarm_count"))


def total_measurements(measurements: DataFrame) -> DataFrame:
    return measurements.agg(F.count("*").alias("measurements_total"))


HEALTH_COLUMNS = ["connected", "mqtt_connected", "spool_depth", "kafka_lag"]


def latest_site_health(site_health: DataFrame, site_id: str | None = None) -> DataFrame:
    """Newest health row per site."""
    if site_id is not None:
        site_health = site_health.filter(F.col("site_id") == site_id)
    return newest(site_health, ["site_id"], ["updated_at"], [*HEALTH_COLUMNS, "updated_at"])


def ingest_status(site_health: DataFrame, as_of: datetime) -> DataFrame:
    """One row over the newest health of each site."""
    latest = latest_site_health(site_health)
    degraded = ~F.col("connected") | (F.col("spool_depth") > 0)
    return latest.agg(
        F.count("*").alias("total_sites"),
        F.count_if(degraded).alias("degraded_sites"),
        F.coalesce(F.sum("spool_depth"), F.lit(0)).alias("total_spool_depth"),
        F.lit(True).alias("kafka_connected"),
        literal(as_of, site_health, "updated_at").alias("updated_at"),
    )


def latest_spool_depth(site_health: DataFrame) -> DataFrame:
    """Spool depth of the newest health row of all; 0 when there is none."""
    newest_depth = F.max_by("spool_depth", F.struct("updated_at", "site_id"))
    return site_health.agg(F.coalesce(newest_depth, F.lit(0)).alias("spool_depth"))
