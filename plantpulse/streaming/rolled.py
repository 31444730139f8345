"""Stored rollups that follow the changes of an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import span
from ..operators.rollups import rollup
from ..sources.tables import DAY, FoldedTable, _exists, on_days, swap_days, write_table

SCHEMA = "bucket timestamp, site_id string, asset_id string, signal_id string, avg_value double, min_value double, max_value double"


class StoredRollup:
    """The rollup of a measurement table at ``path``, by day, brought up to date by the batches that changed the table.

    A batch names the (bucket, series) it touched; only those are computed again, from the table's partitions of their days.
    The days are written aside with the untouched buckets and then swapped in, so a run may stop anywhere: the next one ends
    the swap first, and a batch that is refreshed again gives the same days.
    """

    def __init__(self, spark: SparkSession, path: str, width: str):
        if (span("1 day") % span(width)).total_seconds():
            raise ValueError("buckets have to lie within a day")
        self.spark, self.path, self.width = spark, path.rstrip("/"), width
        self.schema = StructType.fromDDL(f"{SCHEMA}, {DAY} date")
        self.rows_path, self.staged_path = f"{self.path}/rows", f"{self.path}/staged"

    def _stored(self) -> DataFrame:
        if not _exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.rows_path)

    def touched(self, changes: DataFrame) -> DataFrame:
        """bucket, asset, signal and day of changed rows; a map-side distinct, so a busy series is one row a bucket.

        The site is left open: the table keeps that of a reading's first arrival, which a change may not name.
        """
        bucket = F.window("ts_source", self.width)["start"].alias("bucket")
        named = changes.filter(F.col("ts_source").isNotNull()).select(bucket, "asset_id", "signal_id", F.to_date("ts_source").alias(DAY))
        return named.distinct()

    def refresh(self, table: FoldedTable, batch_id: int) -> list:
        """Bring the buckets that a batch of the table changed up to date; the days that were read."""
        swap_days(self.spark, self.staged_path, self.rows_path, self.schema, "bucket")
        touched = self.touched(table.changes(batch_id))
        days = sorted(r[0] for r in touched.select(DAY).distinct().collect())
        if not days:
            return days
        keys = ["bucket", "asset_id", "signal_id"]
        changed = touched.drop(DAY)
        renamed = changed.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        again = rollup(table.read(days), self.width).join(renamed, same, "left_semi")
        kept = self._stored().filter(on_days(days)).drop(DAY).join(renamed, same, "left_anti")
        write_table(kept.unionByName(again), self.staged_path, "bucket", only_days=False)
        swap_days(self.spark, self.staged_path, self.rows_path, self.schema, "bucket")
        return days

    def read(self) -> DataFrame:
        """The rollup as of the last refresh."""
        rows = self._stored()
        if _exists(self.spark, f"{self.staged_path}/_SUCCESS"):
            staged = self.spark.read.schema(self.schema).parquet(self.staged_path)
            rows = rows.join(staged.select(DAY).distinct(), DAY, "left_anti").unionByName(staged)
        return rows.drop(DAY)
