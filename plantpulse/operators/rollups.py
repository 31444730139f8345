"""Time-bucket rollups and their bounded refresh."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RETENTION_MONTHS, ROLLUPS
from ..functions.times import floor_time, literal, span

SERIES = ["site_id", "asset_id", "signal_id"]


def rollup(measurements: DataFrame, width: str, quality_in: list[str] | None = None) -> DataFrame:
    """Mean, minimum and maximum per bucket and series. All qualities count unless named."""
    rows = measurements if quality_in is None else measurements.filter(F.col("quality").isin(quality_in))
    return (
        rows.groupBy(F.window("ts_source", width).alias("w"), *SERIES)
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
        .select(F.col("w.start").alias("bucket"), *SERIES, "avg_value", "min_value", "max_value")
    )


def refresh_range(width: str, start: str, end: str, as_of: datetime) -> tuple[datetime, datetime]:
    """First bucket start and exclusive end of a refresh.

    Only buckets that lie wholly between ``as_of - start`` and ``as_of - end`` are recomputed.
    """
    step = span(width)
    low, high = as_of - span(start), as_of - span(end)
    first = floor_time(low, step)
    return (first if first == low else first + step), floor_time(high, step)


def refresh(rolled: DataFrame, measurements: DataFrame, width: str, start: str, end: str, as_of: datetime) -> DataFrame:
    """The rollup with the buckets of the refresh range recomputed, the others untouched.

    The range reaches the scan of the measurements as a filter, so a refresh reads only
    its own days.
    """
    first, last = refresh_range(width, start, end, as_of)
    kept = rolled.filter(
        (F.col("bucket") < literal(first, rolled, "bucket")) | (F.col("bucket") >= literal(last, rolled, "bucket"))
    )
    in_range = measurements.filter(
        (F.col("ts_source") >= literal(first, measurements, "ts_source"))
        & (F.col("ts_source") < literal(last, measurements, "ts_source"))
    )
    return kept.unionByName(rollup(in_range, width))


def refresh_named(name: str, rolled: DataFrame, measurements: DataFrame, as_of: datetime) -> DataFrame:
    policy = ROLLUPS[name]
    return refresh(rolled, measurements, policy["width"], policy["start"], policy["end"], as_of)


def series_mean(measurements: DataFrame) -> DataFrame:
    """Mean over all history per series."""
    return measurements.groupBy(*SERIES).agg(F.avg("value").alias("avg_value"))


def time_group(
    measurements: DataFrame, asset_id: str, signal_id: str, start: datetime, end: datetime, width: str = "10 seconds"
) -> DataFrame:
    """Mean per time group of one signal in an inclusive range, in time order."""
    lo, hi = (literal(t, measurements, "ts_source") for t in (start, end))
    rows = measurements.filter(
        (F.col("asset_id") == asset_id) & (F.col("signal_id") == signal_id) & F.col("ts_source").between(lo, hi)
    )
    return (
        rows.groupBy(F.window("ts_source", width).alias("w"))
        .agg(F.avg("value").alias("value"))
        .select(F.col("w.start").alias("time"), "value")
        .orderBy("time")
    )


def retained(table: DataFrame, as_of: datetime, time: str = "ts_source", months: int = RETENTION_MONTHS) -> DataFrame:
    """Rows young enough to keep; the cut is a constant the scan can prune with."""
    return table.filter(F.col(time) >= literal(as_of, table, time) - F.expr(f"INTERVAL '{months}' MONTH"))
