"""Store-and-forward replay: spooled records published in order, once per checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import numbered
from ..schemas import SPOOL
from ..sources.files import stream_files
from ..sources.tables import _children


def outgoing(spool: DataFrame) -> DataFrame:
    """Unsent records as (topic, key, value), keyed so that a repeated send is harmless."""
    return spool.filter(F.col("status") == "pending").select(
        "row_id", F.col("kafka_topic").alias("topic"), F.col("message_key").alias("key"), F.col("payload").alias("value")
    )


def replay(spark: SparkSession, spool_path: str, out_path: str, max_files: int = 100) -> StreamingQuery:
    """Publish what is spooled and stop; a restart goes on after the last finished batch.

    ``max_files`` bounds a batch. Inside a batch the records of a key leave in spool order.
    Each batch has its own folder, which a second try of the batch replaces.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.repartition("key").sortWithinPartitions("row_id")
        ordered.write.mode("overwrite").parquet(f"{out_path}/published/batch={batch_id}")

    spool = stream_files(spark, spool_path, SPOOL, max_files)
    return (
        outgoing(spool)
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", f"{out_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


class KeyedReplay:
    """Replay in which every record carries its place in its key, so that order per key holds beyond one batch.

    A batch is numbered from where its keys' earlier batches ended (``heads``, the newest row of each key). Numbers come
    from a distributed rank, so a key with most of a backlog is not numbered by one task. A batch that is tried again is
    numbered from the same heads and replaces what it wrote. Files of the spool are taken in the order they were written.
    ``send`` hands a batch on (a broker, a table); it may be called again with the same rows, which is what key and number
    are for.
    """

    def __init__(self, spark: SparkSession, path: str, send: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.send = spark, path.rstrip("/"), send

    def _heads(self, before: int) -> DataFrame:
        """key and the number its next record gets, from the batches before one."""
        batches = [int(n.partition("=")[2]) for n in _children(self.spark, f"{self.path}/heads") if n.startswith("batch=")]
        paths = [f"{self.path}/heads/batch={b}" for b in batches if b < before]
        if not paths:
            return self.spark.createDataFrame([], "topic string, key string, next bigint")
        found = self.spark.read.schema("topic string, key string, next bigint").parquet(*paths)
        return found.groupBy("topic", "key").agg(F.max("next").alias("next"))

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        placed = numbered(batch, ["topic", "key"], ["row_id"], "place")
        heads = self._heads(batch_id)
        same = placed["topic"].eqNullSafe(heads["topic"]) & placed["key"].eqNullSafe(heads["key"])
        rows = placed.join(heads, same, "left").select(
            placed["topic"], placed["key"], (F.coalesce("next", F.lit(0)) + F.col("place")).alias("number"), "row_id", "value"
        )
        target = f"{self.path}/published/batch={batch_id}"
        rows.repartition("key").sortWithinPartitions("key", "number").write.mode("overwrite").parquet(target)
        stored = self.spark.read.schema(rows.schema).parquet(target)
        if self.send is not None:
            self.send(stored, batch_id)
        moved = stored.groupBy("topic", "key").agg((F.max("number") + 1).alias("next"))
        moved.write.mode("overwrite").parquet(f"{self.path}/heads/batch={batch_id}")

    def run(self, spool_path: str, max_files: int = 100) -> StreamingQuery:
        """Publish what is spooled and stop; refuses to go on where published records miss a number."""
        lost = self.gaps().head(1)
        if lost:
            raise RuntimeError(f"published records of key {lost[0].key!r} are not whole")
        return (
            outgoing(stream_files(self.spark, spool_path, SPOOL, max_files))
            .writeStream.foreachBatch(self.publish)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    def published(self) -> DataFrame:
        schema = "topic string, key string, number bigint, row_id bigint, value string"
        if not _children(self.spark, f"{self.path}/published"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/published").drop("batch")

    def gaps(self) -> DataFrame:
        """Keys whose published numbers are not 0, 1, 2, ..., each once, up to where their head stands.

        A batch stopped after publishing and before its heads is no gap: it will be tried again.
        """
        heads = self._heads(1 << 62).withColumnRenamed("next", "expected")
        found = self.published().groupBy("topic", "key").agg(F.count("*").alias("records"), F.count_distinct("number").alias("numbers"), (F.max("number") + 1).alias("top"))
        same = found["topic"].eqNullSafe(heads["topic"]) & found["key"].eqNullSafe(heads["key"])
        both = found.join(heads, same, "full")
        whole = (F.col("records") == F.col("numbers")) & (F.col("numbers") == F.col("top")) & (F.col("top") >= F.coalesce("expected", F.lit(0)))
        return both.filter(~F.coalesce(whole, F.lit(False))).select(
            F.coalesce(found["topic"], heads["topic"]).alias("topic"), F.coalesce(found["key"], heads["key"]).alias("key"), "records", "expected"
        )


def published(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/published").drop("batch")
