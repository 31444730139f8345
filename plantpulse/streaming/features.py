"""Rolling features: one-minute means of telemetry in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.payload import Payload, with_payload
from ..operators.contracts import TELEMETRY_READS, telemetry_fields
from ..operators.rollups import series_mean


# The key on the wire that each column is read from.
WIRE = {
    "event_id": "eventId", "site_id": "siteId", "asset_id": "assetId", "signal_id": "signalId", "quality": "quality",
    "ts_source": "ts_source", "ts_ingest": "ts_ingest", "seq": "seq", "unit": "unit", "value": "value", "tags": "tags",
    "trace_id": "traceId",
}


def parsed_telemetry(log: DataFrame, *names: str) -> DataFrame:
    """Typed telemetry of a log, all twelve fields or the named ones; fields that do not parse are NULL. What is not named
    is not read.

    The row is generated, as in ``with_failure``: a later filter, window or watermark on a field would otherwise be moved
    below the parsing and parse every message again for each mention of the field.
    """
    p, chosen = Payload(), names or tuple(WIRE)
    reads = {key: reading for key, reading in TELEMETRY_READS.items() if key in {WIRE[n] for n in chosen}}
    parsed = with_payload(log.select("value"), F.col("value").cast("string"), reads, p)
    fields = telemetry_fields(p)
    return parsed.select(F.explode(F.array(F.struct(*[fields[n].alias(n) for n in chosen]))).alias("row")).select("row.*")


def rolling_means(telemetry: DataFrame, width: str = "1 minute", late_by: str = "10 minutes") -> DataFrame:
    """Mean per window and series. In append mode a window appears once it has closed.

    Readings older than the watermark are dropped.
    """
    return (
        telemetry.withWatermark("ts_source", late_by)
        .groupBy(F.window("ts_source", width).alias("w"), "site_id", "asset_id", "signal_id")
        .agg(F.avg("value").alias("avg_value"))
        .select(
            "site_id", "asset_id", "signal_id",
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_value",
        )
    )


def feature_messages(features: DataFrame) -> DataFrame:
    """Feature rows as JSON messages."""
    body = F.struct(
        F.col("site_id").alias("siteId"),
        F.col("asset_id").alias("assetId"),
        F.col("signal_id").alias("signalId"),
        F.col("window_start").alias("windowStart"),
        F.col("window_end").alias("windowEnd"),
        "avg_value",
    )
    return features.select(F.to_json(body).alias("value"))


FEATURE_FIELDS = ("ts_source", "site_id", "asset_id", "signal_id", "value")


def feature_stream(log: DataFrame) -> DataFrame:
    return feature_messages(rolling_means(parsed_telemetry(log, *FEATURE_FIELDS)))


def feature_job(source: DataFrame, sink: Callable[[DataFrame], DataStreamWriter], checkpoint: str, **trigger) -> StreamingQuery:
    """Telemetry messages in, one-minute means out: ``source`` is any stream with a ``value``, ``sink`` turns the message
    stream into a writer (files, a broker, a table). A restart on the same checkpoint goes on inside open windows."""
    writer = sink(feature_stream(source)).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def backfill_job(table: DataFrame, sink: Callable[[DataFrame], None]) -> None:
    """The mean over all history of every series of a measurement table, handed to ``sink``."""
    sink(series_mean(table))
