"""Scoring as a job: JSON lines of windows in; scores, a quarantine and a manifest row of every batch out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import anomaly
from ..sources.files import window_lines
from ..sources.tables import _exists


class ScoringJob:
    """Results under ``path``, one folder a batch for each of scores, rejected lines and the manifest.

    A batch is parsed once: good and bad lines are told apart in one write. Its manifest row states the model and what the
    batch gave, with a checksum over its rows that does not depend on their order, so a second try of the batch, which
    replaces all of it, can be told to have changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str, model_id: str, version: str, reconstruct: Callable[[Column], Column]):
        self.spark, self.path, self.model_id, self.version, self.reconstruct = spark, path.rstrip("/"), model_id, version, reconstruct

    def apply(self, lines: DataFrame, batch_id: int) -> None:
        parsed = window_lines(lines).withColumn("model_id", F.coalesce("model_id", F.lit(self.model_id)))
        scored = anomaly.score(parsed, F.when(F.col("error").isNull(), self.reconstruct(F.col("window"))))
        kind = F.when(F.col("error").isNull(), "scores").otherwise("rejected")
        rows = scored.withColumns({"kind": kind, "batch": F.lit(batch_id).cast("bigint")})
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(f"{self.path}/rows")
        )
        stored = self._rows(rows.schema).filter(F.col("batch") == batch_id)
        good = F.col("kind") == "scores"
        sums = stored.agg(
            F.count_if(good).alias("scored"), F.count_if(~good).alias("rejected"), F.count_if(good & F.col("anomalous")).alias("anomalous"),
            F.lower(F.hex(F.coalesce(F.bit_xor(F.xxhash64("raw")), F.lit(0)))).alias("checksum"),
        )
        manifest = sums.select(F.lit(self.model_id).alias("model_id"), F.lit(self.version).alias("version"), "scored", "rejected", "anomalous", "checksum")
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Run over a stream of text lines."""
        return (
            lines.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def _rows(self, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/rows")

    def _of(self, kind: str) -> DataFrame | None:
        return self._rows().filter(F.col("kind") == kind) if _exists(self.spark, f"{self.path}/rows") else None

    def scores(self) -> DataFrame:
        """The scored windows of all batches; an error before the first."""
        return self._rows().filter(F.col("kind") == "scores").drop("kind", "raw", "error")

    def rejected(self) -> DataFrame:
        return self._rows().filter(F.col("kind") == "rejected").select("raw", "error", "batch")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")
