"""Reads an operator's screen asks for: telemetry windows, alarm lists, lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALARM_LIST_LIMIT, TELEMETRY_LIMIT, TELEMETRY_LIMIT_MAX
from ..functions.times import literal
from .ordering import newest, top_n

POINT_COLUMNS = ["ts_source", "signal_id", "value", "quality", "unit", "tags"]


def _newest_point() -> list[Column]:
    """Newest first; sequence and signal settle ties."""
    return [F.desc("ts_source"), F.desc("seq"), F.asc("signal_id")]


def in_range(table: DataFrame, time: str, start: datetime | None, end: datetime | None, as_of: datetime) -> DataFrame:
    """Rows of an inclusive time range; by default the hour up to ``as_of``."""
    low = start or as_of - timedelta(hours=1)
    high = end or as_of
    return table.filter(F.col(time).between(literal(low, table, time), literal(high, table, time)))


def points(rows: DataFrame) -> DataFrame:
    """Telemetry points as shown: the value as text."""
    return rows.withColumn("value", F.col("value").cast("string"))


def telemetry_window(
    measurements: DataFrame, assets: DataFrame, asset_id: str, as_of: datetime,
    start: datetime | None = None, end: datetime | None = None, limit: int = TELEMETRY_LIMIT,
) -> DataFrame:
    """Newest points of one registered asset in a range, with the asset's site.

    An asset that is not registered gives no rows.
    """
    if not 1 <= limit <= TELEMETRY_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {TELEMETRY_LIMIT_MAX}")
    asset = assets.filter(F.col("asset_id") == asset_id).select("asset_id", F.col("site_id").alias("asset_site"))
    rows = in_range(measurements.filter(F.col("asset_id") == asset_id), "ts_source", start, end, as_of)
    newest_rows = rows.orderBy(*_newest_point()).limit(limit)
    return newest_rows.join(asset, "asset_id").select(
        "asset_id", F.col("asset_site").alias("site_id"), *POINT_COLUMNS
    )


def telemetry_window_all(
    measurements: DataFrame, assets: DataFrame, as_of: datetime,
    start: datetime | None = None, end: datetime | None = None, limit: int = TELEMETRY_LIMIT,
) -> DataFrame:
    """Newest points of every registered asset, ``limit`` per asset."""
    rows = in_range(measurements, "ts_source", start, end, as_of)
    best = top_n(rows, ["asset_id"], _newest_point(), limit, F.struct("ts_source", "seq"))
    sites = assets.select("asset_id", F.col("site_id").alias("asset_site"))
    return best.join(sites, "asset_id").select(
        "asset_id", F.col("asset_site").alias("site_id"), "rank", *POINT_COLUMNS
    )


def alarm_list(alarms: DataFrame, site_id: str | None = None, state: str | None = None, limit: int = ALARM_LIST_LIMIT) -> DataFrame:
    """Newest alarms; each filter applies only when given."""
    if site_id:
        alarms = alarms.filter(F.col("site_id") == site_id)
    if state:
        alarms = alarms.filter(F.col("state") == state)
    return (
        alarms.select("alarm_id", "site_id", "asset_id", "severity", "message", "state", "raised_at", "acknowledged_at")
        .orderBy(F.desc("raised_at"), F.desc("alarm_id"))
        .limit(limit)
    )


def model_versions(model_registry: DataFrame) -> DataFrame:
    """Deployed versions, newest first."""
    return model_registry.orderBy(F.desc("deployed_at"), F.asc("model_id"), F.asc("version"))


def command_by_id(command_log: DataFrame, command_id: str) -> DataFrame:
    """The newest record of one command."""
    found = command_log.filter(F.col("command_id") == command_id)
    return found.orderBy(F.desc("issued_at")).limit(1)


def latest_commands(command_log: DataFrame) -> DataFrame:
    """The newest record of every command id."""
    columns = [c for c in command_log.columns if c != "command_id"]
    return newest(command_log, ["command_id"], ["issued_at"], columns)
