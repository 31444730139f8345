"""Duplicate drop for append-only streams, with counters of every batch.

A feed that delivers at least once repeats messages. Where the sink only appends, a repeat has to go before it: the ids seen
are kept as keyed state until the watermark has passed them by ``late_by``, so the state holds one stretch of the feed and not
its history. A repeat that comes later than that finds its time behind the watermark and is dropped as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import _exists


def unique(stream: DataFrame, keys: list[str], time: str, late_by: str) -> DataFrame:
    """The first of the rows that agree in ``keys``; rows without a time cannot be placed: they are left out and not counted."""
    timed = stream.filter(F.col(time).isNotNull()).withWatermark(time, late_by)
    return timed.dropDuplicatesWithinWatermark(keys)


class UniqueFeed:
    """The unique rows of a stream as an append-only table under ``path``, and what each batch saw.

    Counters are observed on the rows as they pass, before and after the drop, so they cost no job. The rows of a batch and
    its counters are replaced together when the batch is tried again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str, late_by: str):
        self.spark, self.path, self.keys, self.time, self.late_by = spark, path.rstrip("/"), keys, time, late_by
        self.progress: list = []

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Take in what is there and stop."""
        # As numbers: progress reports show times to the second only.
        at = F.unix_micros(F.col(self.time).cast("timestamp"))
        seen = stream.filter(F.col(self.time).isNotNull()).observe("seen", F.count("*").alias("n"), F.min(at).alias("since"), F.max(at).alias("until"))
        kept = unique(seen, self.keys, self.time, self.late_by).observe("unique", F.count("*").alias("n"))
        # Counters are taken from the progress of the run's batches: all of them have to be kept until it ends.
        self.spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
        query = (
            kept.writeStream.format("parquet").outputMode("append").option("path", f"{self.path}/rows")
            .option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.progress = list(query.recentProgress)
        self._store()
        return query

    def _store(self) -> None:
        """Keep the counters of the finished batches; a batch that only advanced the watermark saw nothing."""
        rows = []
        for p in self.progress:
            seen = p.observedMetrics.get("seen")
            if not p.numInputRows or seen is None:
                continue
            late = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            unique_rows = p.observedMetrics["unique"].n
            rows.append((p.batchId, seen.since, seen.until, seen.n, unique_rows, seen.n - unique_rows - late, late))
        if rows:
            schema = "batch bigint, since bigint, until bigint, seen bigint, unique bigint, repeated bigint, late bigint"
            found = self.spark.createDataFrame(rows, schema)
            found = found.withColumns({c: F.timestamp_micros(c) for c in ("since", "until")})
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/counters")

    def rows(self, schema) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def counters(self) -> DataFrame:
        """since, until, seen, unique, repeated and late of every batch that saw rows."""
        schema = "since timestamp, until timestamp, seen bigint, unique bigint, repeated bigint, late bigint, batch bigint"
        if not _exists(self.spark, f"{self.path}/counters"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/counters")
