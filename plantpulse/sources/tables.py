"""Parquet tables: clustered layout, retention, and upserts by append and compaction.

Parquet has no MERGE. Rewriting a day for every micro-batch would cost far more than the
batch itself, so an upsert only appends the new arrivals, and a read folds them onto the
base. ``compact`` folds them in for good, rewriting only the days that changed.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.constants import RETENTION_MONTHS
from ..functions.times import literal
from ..operators.upsert import UpsertSpec, merge

DAY = "ts_date"
CLUSTER = ["site_id", "asset_id", "signal_id"]


# --- layout ---------------------------------------------------------------------------


def clustered(df: DataFrame, time: str = "ts_source", cluster: list[str] | None = None) -> DataFrame:
    """Rows by day, sorted by series and time inside it.

    Range partitioning on day, series and time gives equal tasks whatever the sizes of the
    days and of the series, while row groups still cover narrow ranges of series.
    """
    keys = [c for c in (CLUSTER if cluster is None else cluster) if c in df.columns]
    dated = df.withColumn(DAY, F.to_date(time))
    return dated.repartitionByRange(DAY, *keys, time).sortWithinPartitions(DAY, *keys, time)


def write_table(
    df: DataFrame, path: str, time: str = "ts_source", cluster: list[str] | None = None,
    mode: str = "overwrite", only_days: bool = True,
) -> None:
    """Write a day-partitioned table; ``overwrite`` replaces only the days that occur in ``df``.

    With ``only_days=False`` it replaces the whole table and leaves a success marker.
    """
    (
        clustered(df, time, cluster)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if only_days else "static")
        .option("compression", "zstd")
        .partitionBy(DAY)
        .parquet(path)
    )


def time_slice(table: DataFrame, start: datetime, end: datetime, time: str = "ts_source") -> DataFrame:
    """Rows of an inclusive range; the bounds also cut the day partitions."""
    rows = table.filter(F.col(time).between(literal(start, table, time), literal(end, table, time)))
    if DAY in table.columns:
        rows = rows.filter(F.col(DAY).between(F.lit(start.date()), F.lit(end.date())))
    return rows


def on_days(days: list[date]) -> Column:
    """Whether a row's day is one of ``days``: one text to parse, because literals made one by one take seconds for years of days."""
    listed = ", ".join(f"DATE'{d.isoformat()}'" for d in days if d is not None)
    return F.expr(f"{DAY} IN ({listed})") if listed else F.lit(False)


# --- folders --------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def drop_expired_days(spark: SparkSession, path: str, as_of: datetime, months: int = RETENTION_MONTHS) -> list[str]:
    """Remove the day partitions that lie wholly before the retention cut."""
    month = as_of.year * 12 + as_of.month - 1 - months
    year, month = divmod(month, 12)
    last_day = (date(year + month // 11, (month + 1) % 12 + 1, 1) - date.resolution).day
    cut = date(year, month + 1, min(as_of.day, last_day))
    gone = []
    for name in sorted(_children(spark, path)):
        key, _, value = name.partition("=")
        if key == DAY and value[:4].isdigit() and date.fromisoformat(value) < cut:
            _remove(spark, f"{path}/{name}")
            gone.append(name)
    return gone


def swap_days(spark: SparkSession, staged: str, target: str, schema: StructType, time: str) -> None:
    """Put days that were staged in full in the place of the same days of ``target``; a stopped run is finished by the next.

    Staged data without a success marker is an unfinished write and goes.
    """
    if not _exists(spark, staged):
        return
    if _exists(spark, f"{staged}/_SUCCESS"):
        write_table(spark.read.schema(schema).parquet(staged).drop(DAY), target, time)
    _remove(spark, staged)


# --- upserts --------------------------------------------------------------------------


class FoldedTable:
    """A keyed table at ``path``: a folded base plus the arrivals of recent batches.

    Replaying a batch id replaces that batch, so delivery at least once has the effect of
    exactly once. Arrivals take effect in the order of their batches, and inside a batch
    in arrival order.
    """

    def __init__(
        self, spark: SparkSession, path: str, spec: UpsertSpec, schema: str, arrival_type: str, arrivals: str | None = None
    ):
        """``arrivals`` names a folder of batches that somebody else writes (``Ingest``): the rows lie in a column named
        by the table."""
        self.spark, self.path, self.spec, self.shared = spark, path.rstrip("/"), spec, arrivals is not None
        self.schema = StructType.fromDDL(schema)
        self.change_schema = StructType.fromDDL(
            f"{schema}, arrival struct<batch_id:bigint,at:{arrival_type}>, {DAY} date"
        )
        self.base_path = f"{self.path}/base"
        self.changes_path = arrivals or f"{self.path}/changes"
        self.staged_path = f"{self.path}/staged"

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Store the arrivals of one batch (table columns plus ``arrival``).

        They are dealt by key and arrival: a batch that comes as one part is written, and later folded, by more than one task.
        """
        dealt = rows.repartition(*self.spec.keys, "arrival")
        order = F.struct(F.lit(batch_id).cast("bigint").alias("batch_id"), F.col("arrival").alias("at"))
        rows = dealt.withColumn("arrival", order).withColumn(DAY, F.to_date(self.spec.time))
        rows.select(*self.change_schema.names).write.mode("overwrite").parquet(f"{self.changes_path}/batch={batch_id}")

    def _batches(self) -> list[int]:
        names = (n.partition("=") for n in _children(self.spark, self.changes_path))
        return sorted(int(value) for key, _, value in names if key == "batch")

    def _base(self) -> DataFrame:
        schema = StructType([f for f in self.change_schema if f.name != "arrival"])
        if not _exists(self.spark, self.base_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.base_path)

    def _changes(self, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.change_schema)
        paths = [f"{self.changes_path}/batch={b}" for b in batches]
        if not self.shared:
            return self.spark.read.schema(self.change_schema).parquet(*paths)
        at = self.change_schema["arrival"].dataType["at"].dataType
        packed = StructType([*self.schema, StructField("arrival", at)])
        schema = StructType([StructField(self.spec.table, packed), StructField("batch", LongType())])
        found = self.spark.read.schema(schema).option("basePath", self.changes_path).parquet(*paths)
        rows = found.select("batch", f"{self.spec.table}.*")
        order = F.struct(F.col("batch").alias("batch_id"), F.col("arrival").alias("at"))
        return rows.withColumn("arrival", order).withColumn(DAY, F.to_date(self.spec.time)).drop("batch")

    def changes(self, batch_id: int) -> DataFrame:
        """The stored arrivals of one batch."""
        return self._changes([batch_id] if batch_id in self._batches() else [])

    def read(self, days: list[date] | None = None) -> DataFrame:
        """The table as of now: one row per key. Reading changes nothing: staged days count as soon as they are whole.

        With ``days`` only the partitions of those days are read.
        """
        batches = self._batches()
        base, changes = self._base(), self._changes(batches)
        if days is not None:
            base, changes = (rows.filter(on_days(days)) for rows in (base, changes))
        if _exists(self.spark, f"{self.staged_path}/_SUCCESS"):
            staged = self.spark.read.schema(base.schema).parquet(self.staged_path)
            staged = staged if days is None else staged.filter(on_days(days))
            base = base.join(staged.select(DAY).distinct(), DAY, "left_anti").unionByName(staged)
        if not batches:
            return base.select(*self.schema.names)  # folded already
        return merge(base, changes, self.spec).select(*self.schema.names)

    def compact(self) -> None:
        """Fold the stored batches into the base and drop them.

        The days that change are written aside in full before the base is touched, and the
        batches are dropped oldest first; wherever a run stops, the next one completes it
        with the same result.
        """
        self._finish_swap()
        batches = self._batches()
        if not batches:
            return
        changes = self._changes(batches)
        # The join on the partition column prunes the scan of the base to the days that change.
        touched = self._base().join(changes.select(DAY).distinct(), DAY, "left_semi")
        folded = merge(touched, changes, self.spec).select(*self.schema.names)
        write_table(folded, self.staged_path, self.spec.time, only_days=False)
        self._finish_swap()
        for batch in batches:
            _remove(self.spark, f"{self.changes_path}/batch={batch}")

    def _finish_swap(self) -> None:
        schema = StructType([f for f in self.change_schema if f.name != "arrival"])
        swap_days(self.spark, self.staged_path, self.base_path, schema, self.spec.time)
