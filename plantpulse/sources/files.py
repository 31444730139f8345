"""File forms of the log, the spool and the score windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import NUMBER, RAW, TEXT, TIME, Payload, with_payload


def stream_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A replayable stream over Parquet files; the checkpoint remembers what was read.

    ``path`` may be a folder or a single file.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern that matches only the path itself lets a single file be a source too.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def window_lines(lines: DataFrame) -> DataFrame:
    """Score windows from JSON lines (column ``value``), batch or stream, with the line (``raw``) and what it lacks (``error``)."""
    p = Payload()
    reads = dict.fromkeys(["modelId", "siteId", "assetId", "signalId"], TEXT)
    reads |= {"ts_source": TIME, "threshold": NUMBER, "window": RAW}
    rows = with_payload(lines, F.col("value"), reads, p).select(
        p.value("window").try_cast("array<double>").alias("window"),
        p.text("modelId").alias("model_id"),
        p.text("siteId").alias("site_id"),
        p.text("assetId").alias("asset_id"),
        p.text("signalId").alias("signal_id"),
        p.time("ts_source").alias("ts_source"),
        p.number("threshold").alias("threshold"),
        F.col("value").alias("raw"),
        p.is_json().alias("json"),
    )
    error = F.when(~F.col("json"), "line is not JSON")
    for name in ("window", "asset_id", "signal_id"):
        error = error.when(F.col(name).isNull(), f"line lacks a usable {name}")
    return rows.withColumn("error", error).drop("json")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The score windows of JSON lines; lines without window, asset or signal are in ``rejected_windows``."""
    return window_lines(spark.read.text(path)).filter(F.col("error").isNull()).drop("raw", "error")


def rejected_windows(spark: SparkSession, path: str) -> DataFrame:
    """The lines that give no score window, and why: the quarantine of ``read_windows``."""
    return window_lines(spark.read.text(path)).filter(F.col("error").isNotNull()).select("raw", "error")


def write_messages(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON text rows as JSON lines."""
    messages.select("value").write.mode(mode).text(path)
