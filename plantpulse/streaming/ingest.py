"""Continuous ingest: one log into folded tables and a quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing
from ..operators.upsert import SPECS
from ..schemas import TABLES
from ..sources.tables import FoldedTable, _exists

ARRIVAL = "struct<timestamp:timestamp,partition:int,offset:bigint>"
QUARANTINE = "quarantine struct<topic:string,partition:int,offset:bigint,reason:string,error:string,raw:string>"


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes by partition keep up to ``most`` files open in a task instead of sorting all rows by partition first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Ingest:
    """Tables under ``path`` and the batch step that feeds them.

    A batch is parsed once and written once, partitioned by target: nothing is cached, and every table reads the folder
    of its own arrivals. Every ``compact_every`` batches the tables fold their batches into their base, so that no more
    than that many stay open. A batch that is tried again replaces what its earlier try wrote, and folds to the same rows.
    ``after`` is called with the batch number once the batch is stored.
    """

    def __init__(
        self, spark: SparkSession, path: str, tables: list[str] | None = None, compact_every: int = 16,
        after: Callable[[int], None] | None = None,
    ):
        self.spark, self.path, self.compact_every, self.after = spark, path.rstrip("/"), compact_every, after
        self.arrivals = f"{self.path}/arrivals"
        self.tables = {
            name: FoldedTable(spark, f"{self.path}/{name}", SPECS[name], TABLES[name], ARRIVAL, f"{self.arrivals}/target={name}")
            for name in (tables or list(SPECS))
        }

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Validate and store one batch: one job, whatever the number of tables."""
        rows = routing.sorted_out(batch, list(self.tables)).withColumn("batch", F.lit(batch_id))
        with _open_files(rows.sparkSession, len(self.tables) + 1):
            (
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                # Ids and payloads hardly repeat, and rows are read a few times only: dictionaries cost more than they spare.
                .option("parquet.enable.dictionary", "false")
                .partitionBy("target", "batch").parquet(self.arrivals)
            )
        if self.after is not None:
            self.after(batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            for table in self.tables.values():
                table.compact()

    def start(self, log: DataFrame, **trigger) -> StreamingQuery:
        """Run the step over a log stream; pass ``availableNow=True`` or ``processingTime=...``."""
        return (
            log.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def quarantine(self) -> DataFrame:
        path = f"{self.arrivals}/target=quarantine"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], QUARANTINE).select("quarantine.*")
        return self.spark.read.schema(QUARANTINE).parquet(path).select("quarantine.*")
