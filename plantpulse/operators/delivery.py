"""Store-and-forward state: what waits, what was tried, whether replay moves."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ERROR_TEXT_LIMIT, PENDING_LIMIT
from ..functions.times import literal


def pending(spool: DataFrame, limit: int = PENDING_LIMIT) -> DataFrame:
    """The oldest unsent records, first in first out."""
    waiting = spool.filter(F.col("status") == "pending")
    return waiting.select("row_id", "kafka_topic", "message_key", "payload").orderBy("row_id").limit(limit)


def backlog_depth(spool: DataFrame) -> DataFrame:
    """Unsent records per site; a site whose records are all sent shows 0."""
    return spool.groupBy("site_id").agg(F.count_if(F.col("status") == "pending").alias("depth"))


def delivery_state(spool: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fold delivery attempts onto the spool records.

    ``attempts`` holds row_id, attempted_at, ok, error. Every attempt counts; a failed one
    sets the error text, a good one sets the record sent.
    """
    failed_at = F.when(~F.col("ok"), F.struct("attempted_at", "error"))
    folded = attempts.groupBy("row_id").agg(
        F.count("*").alias("attempts"),
        F.max_by(F.left("error", F.lit(ERROR_TEXT_LIMIT)), failed_at).alias("last_error"),
        F.max(F.when(F.col("ok"), F.col("attempted_at"))).alias("sent_at"),
    )
    return spool.select("row_id", "kafka_topic", "message_key").join(folded, "row_id", "left").select(
        "row_id", "kafka_topic", "message_key",
        F.when(F.col("sent_at").isNotNull(), "sent").otherwise("pending").alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
        "sent_at",
    )


def replay_stalled(spool: DataFrame, as_of: datetime, after: timedelta = timedelta(minutes=15)) -> DataFrame:
    """Sites with a backlog and no delivery in the last ``after``."""
    sites = spool.groupBy("site_id").agg(
        F.count_if(F.col("status") == "pending").alias("depth"), F.max("sent_at").alias("last_sent_at")
    )
    quiet = F.coalesce(F.col("last_sent_at") < literal(as_of - after, spool, "sent_at"), F.lit(True))
    return sites.filter((F.col("depth") > 0) & quiet)


def backlog_trend(spool: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Records that came and went per time slot and site, the backlog after it and its change.

    Both kinds of change are counted per slot before anything is ordered, so the running
    sum sees one row per site and slot.
    """
    came = spool.select("site_id", F.col("created_at").alias("at"), F.lit(1).alias("came"), F.lit(0).alias("went"))
    went = spool.filter(F.col("sent_at").isNotNull()).select(
        "site_id", F.col("sent_at").alias("at"), F.lit(0).alias("came"), F.lit(1).alias("went")
    )
    slots = (
        came.unionByName(went)
        .groupBy("site_id", F.window("at", width).alias("w"))
        .agg(F.sum("came").alias("came"), F.sum("went").alias("went"))
        .select("site_id", F.col("w.start").alias("slot"), "came", "went")
    )
    order = Window.partitionBy("site_id").orderBy("slot")
    running = slots.withColumn("backlog", F.sum(F.col("came") - F.col("went")).over(order))
    return running.withColumn("change", F.col("backlog") - F.coalesce(F.lag("backlog").over(order), F.lit(0)))
