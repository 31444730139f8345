"""Live views: the newest row per key, kept up to date by a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.times import literal
from ..operators.ordering import newest
from ..operators.upsert import COMMAND_LOG, fold
from ..schemas import TABLES
from ..sources.tables import DAY, FoldedTable, _children, _exists, _remove

POLL = "5 seconds"
POINT = ["ts_source", "signal_id", "value", "quality", "unit", "tags"]


def latest_telemetry(measurements: DataFrame) -> DataFrame:
    """Newest point per asset; cut to a look-back when the view is read.

    A repeated reading is settled by when it was ingested.
    """
    return newest(measurements, ["asset_id"], ["ts_source", "seq", "signal_id", "ts_ingest"], POINT)


def latest_open_alarms(alarms: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Newest open alarm per site; ``ties`` are columns that order repeats of one alarm."""
    opened = alarms.filter(F.col("state") == "open")
    order = ["raised_at", "alarm_id", *(ties or [])]
    return newest(opened, ["site_id"], order, ["raised_at", "alarm_id", "asset_id", "severity", "message"])


def command_status(changes: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Current record per command, from requests and acknowledgements."""
    return fold(changes, COMMAND_LOG, arrival)


def site_connectivity(site_health: DataFrame) -> DataFrame:
    """Newest health per site."""
    return newest(site_health, ["site_id"], ["updated_at"], ["updated_at", "connected", "mqtt_connected", "spool_depth", "kafka_lag"])


class LiveView:
    """The changed rows of each batch under ``path``, and the newest of them per key.

    Every ``compact_every`` batches the view is written whole below ``folded`` and the batches it
    holds are dropped; a stop between the two leaves rows twice, which reads do not notice.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = 16, schema: StructType | None = None):
        """``schema`` is that of the view; a view that was started here knows it. It is what an empty view is read with."""
        self.spark, self.path, self.keys, self.compact_every, self.schema = spark, path.rstrip("/"), keys, compact_every, schema

    def apply(self, changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            old = self._parts()
            target = f"{self.path}/folded/batch={batch_id}"
            self._current().write.mode("overwrite").parquet(target)
            for part in old:
                if part != target:
                    _remove(self.spark, part)

    def _parts(self) -> list[str]:
        """Folders of rows in use: the last whole fold and the batches."""
        found = [f"{self.path}/rows/{n}" for n in _children(self.spark, f"{self.path}/rows")]
        folds = [f"{self.path}/folded/{n}" for n in _children(self.spark, f"{self.path}/folded")]
        whole = [f for f in folds if _exists(self.spark, f"{f}/_SUCCESS")]
        return found + whole

    def _current(self) -> DataFrame:
        """The newest row per key."""
        parts = self._parts()
        if not parts:
            if self.schema is None:
                raise ValueError("the view has no batch yet: name its schema to read it empty")
            return self.spark.createDataFrame([], self.schema)
        rows = [self.spark.read.parquet(part).withColumn("_batch", F.lit(int(part.rpartition("=")[2]))) for part in parts]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return newest(every, self.keys, ["_batch"], [c for c in every.columns if c not in (*self.keys, "_batch")])

    def start(self, view: DataFrame, **trigger) -> StreamingQuery:
        self.schema = view.schema
        return (
            view.writeStream.outputMode("update")
            .foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**(trigger or {"processingTime": POLL}))
            .start()
        )

    def read(self, time: str | None = None, as_of: datetime | None = None, within: timedelta | None = None) -> DataFrame:
        """Current rows; with a look-back only those whose time lies inside it."""
        current = self._current()
        if time is None:
            return current
        low, high = literal(as_of - within, current, time), literal(as_of, current, time)
        return current.filter(F.col(time).between(low, high))


class CommandStatusView:
    """The current record of every command, from the stored command table instead of streaming state.

    A batch of changes is appended to the table; its commands are read back, from the days they were issued on, and stored as
    what subscribers of that batch are sent. Nothing is kept between batches but the table, however many commands there were.
    """

    def __init__(self, spark: SparkSession, path: str, arrival_type: str, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self.table = FoldedTable(spark, f"{self.path}/table", COMMAND_LOG, TABLES["command_log"], arrival_type)

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        self.table.append(changes, batch_id)
        stored = self.table.changes(batch_id)
        days = [r[0] for r in stored.select(DAY).distinct().collect()]
        changed = stored.select(*COMMAND_LOG.keys).distinct()
        current = self.table.read(days).join(changed, COMMAND_LOG.keys, "left_semi")
        current.write.mode("overwrite").parquet(f"{self.path}/sent/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.table.compact()

    def start(self, changes: DataFrame, **trigger) -> StreamingQuery:
        return (
            changes.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**(trigger or {"processingTime": POLL}))
            .start()
        )

    def read(self) -> DataFrame:
        return self.table.read()

    def sent(self, batch_id: int) -> DataFrame:
        """The current records that a batch changed."""
        return self.spark.read.schema(self.table.schema).parquet(f"{self.path}/sent/batch={batch_id}")
