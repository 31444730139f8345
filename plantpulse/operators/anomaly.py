"""Sliding feature windows and anomaly scores by reconstruction error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.constants import BOTTLENECK, DEFAULT_MODEL_ID, DEFAULT_SCORE_THRESHOLD, WINDOW_LENGTH
from .ordering import with_position


def _blocks(
    samples: DataFrame, keys: list[str], length: int, time: str, order: tuple[str, ...], value: str, block: int, chunk: str,
) -> DataFrame:
    """Samples numbered within their key and cut into blocks; the last ``length - 1`` samples of a block are also given to
    the next one. So a series of any length is handled by many tasks, each holding at most ``block + length - 1`` samples."""
    if block < length:
        raise ValueError("block must be at least as long as a window")
    columns = [F.col(c) for c in order]
    placed = with_position(
        samples.select(*dict.fromkeys([*keys, time, *order, value])), keys, F.date_trunc(chunk, F.col(time)), columns
    )
    own = F.floor(F.col("position") / F.lit(block))
    reaches_next = F.pmod(F.col("position"), F.lit(block)) > block - length
    return placed.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(reaches_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )


def sliding_windows(
    samples: DataFrame, keys: list[str], length: int = WINDOW_LENGTH, time: str = "ts_source",
    order: tuple[str, ...] = ("ts_source", "seq"), value: str = "value", block: int = 4096, chunk: str = "hour",
) -> DataFrame:
    """Every run of ``length`` consecutive samples per key, stride 1, at its last sample."""
    spread = _blocks(samples, keys, length, time, order, value, block, chunk)
    frame = Window.partitionBy(*keys, "_block").orderBy("position").rowsBetween(1 - length, 0)
    return (
        spread.withColumn("window", F.collect_list(F.col(value).cast("double")).over(frame))
        .filter((F.size("window") == length) & (F.col("_own") == F.col("_block")))
        .drop("_own", "_block", "position", value)
    )


# --- windows that are never built -----------------------------------------------------


def _windows_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of ``length`` samples in sorted batches (run, own, block, position, value, ...): the batch, the rows that end a
    window of their own block, and the windows as a view on the samples. The end of a batch is carried into the next."""
    tail = np.zeros((4, 0)), np.zeros(0)
    for batch in batches:
        places = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
        places = np.concatenate([tail[0].astype(np.int64), places], axis=1)
        values = np.concatenate([tail[1], batch.column(4).to_numpy(zero_copy_only=False)])
        kept = len(values) - batch.num_rows
        tail = places[:, len(values) - length + 1 :], values[len(values) - length + 1 :]
        if len(values) < length:
            tail = places, values
            continue
        run, own, block, position = places
        ends = np.arange(max(length - 1, kept), len(values))
        first = ends - length + 1
        whole = (run[first] == run[ends]) & (block[first] == block[ends]) & (position[ends] - position[first] == length - 1) & (own[ends] == block[ends])
        ends = ends[whole]
        yield batch, ends - kept, np.lib.stride_tricks.sliding_window_view(values, length)[ends - length + 1]


def _sorted_blocks(samples: DataFrame, keys: list[str], carried: list[str], length: int, block: int, chunk: str, **columns) -> DataFrame:
    """run, own, block, position, value and what is carried, each block of a key whole in one task and sorted."""
    names = {"time": "ts_source", "order": ("ts_source", "seq"), "value": "value"} | columns
    spread = _blocks(samples, keys, length, names["time"], names["order"], names["value"], block, chunk)
    run = F.xxhash64(*[F.col(k) for k in keys])
    rows = spread.select(
        run.alias("_run"), F.col("_own").cast("bigint"), F.col("_block").cast("bigint"), F.col("position").cast("bigint").alias("_position"),
        F.col(names["value"]).cast("double").alias("_value"), *[F.col(c) for c in carried],
    )
    return rows.repartition("_run", "_block").sortWithinPartitions("_run", *[k for k in keys if k in carried], "_block", "_position")


@dataclass(frozen=True)
class WindowMoments:
    """How many windows, their mean, and the sums of products around it."""

    count: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray) -> WindowMoments:
        mean = windows.mean(axis=0)
        return cls(len(windows), mean, (windows - mean).T @ (windows - mean))

    def __add__(self, other: WindowMoments) -> WindowMoments:
        count = self.count + other.count
        if not count:
            return self
        apart, share = other.mean - self.mean, other.count / count
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * self.count * share
        return WindowMoments(count, self.mean + apart * share, scatter)

    def flat(self) -> list[float]:
        return [self.count, *self.mean, *self.scatter.ravel()]

    @classmethod
    def unflat(cls, values, length: int) -> WindowMoments:
        values = np.asarray(values, float)
        return cls(values[0], values[1 : length + 1], values[length + 1 :].reshape(length, length))


def window_totals(
    samples: DataFrame, keys: list[str], length: int = WINDOW_LENGTH, block: int = 4096, chunk: str = "hour", salts: int = 32,
) -> WindowMoments:
    """The moments of all sliding windows without building one: windows are views on a task's samples.

    Each task gives one count, one mean and one matrix, which are added in two steps; the driver sees ``salts`` of them.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = WindowMoments(0.0, np.zeros(length), np.zeros((length, length))), 0
        for batch, ends, windows in _windows_of(batches, length):
            salt = int(batch.column(0)[0].as_py() % salts)
            for start in range(0, len(ends), 8192):
                total += WindowMoments.of(windows[start : start + 8192])
        yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([total.flat()], pa.list_(pa.float64()))], names=["salt", "m"])

    def add(group: pa.Table) -> pa.Table:
        found = [WindowMoments.unflat(m, length) for m in group.column("m").to_pylist()]
        total = found[0]
        for more in found[1:]:
            total += more
        return pa.table({"salt": group.column("salt")[:1], "m": pa.array([total.flat()], pa.list_(pa.float64()))})

    schema = "salt int, m array<double>"
    rows = _sorted_blocks(samples, keys, [], length, block, chunk).mapInArrow(part, schema)
    totals = [WindowMoments.unflat(r.m, length) for r in sorted(rows.groupBy("salt").applyInArrow(add, schema).collect())]
    total = WindowMoments(0.0, np.zeros(length), np.zeros((length, length)))
    for more in totals:
        total += more
    return total


def window_errors(
    samples: DataFrame, keys: list[str], model: LinearReconstruction, length: int = WINDOW_LENGTH, time: str = "ts_source",
    block: int = 4096, chunk: str = "hour",
) -> DataFrame:
    """keys, time, seq and ``score``, the mean squared reconstruction error of the window that ends at each sample."""
    carried = [*keys, time, "seq"]
    rows = _sorted_blocks(samples, keys, carried, length, block, chunk, time=time)
    mean, directions = model.mean, model.directions

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ends, windows in _windows_of(batches, length):
            centred = windows - mean
            error = ((centred - centred @ directions @ directions.T) ** 2).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(ends)) for c in batch.columns[5:]], pa.array(error)], names=[*carried, "score"])

    schema = StructType([*[rows.schema[c] for c in carried], StructField("score", DoubleType())])
    return rows.mapInArrow(part, schema)


def mean_squared_error(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x) / F.size(a)


@dataclass(frozen=True)
class LinearReconstruction:
    """A fitted bottleneck: the mean window, ``k`` orthonormal directions (length x k), and the
    variance per window that they leave."""

    mean: np.ndarray
    directions: np.ndarray
    residual: float = 0.0

    def reconstruct(self, window: Column) -> Column:
        """The window as seen through the bottleneck, in Arrow batches of windows."""
        mean, directions = self.mean, self.directions

        @F.pandas_udf("array<double>")
        def through(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if batch.empty:
                    yield batch
                    continue
                centred = np.stack(batch.to_numpy()) - mean
                yield pd.Series(list(centred @ directions @ directions.T + mean))

        return through(window)


def bottleneck(moments: WindowMoments, k: int = BOTTLENECK) -> LinearReconstruction:
    """The best ``k`` directions for windows with these moments, and the variance per window that they leave."""
    if not moments.count:
        raise ValueError("there are no windows to fit")
    values, vectors = np.linalg.eigh(moments.scatter / moments.count)
    return LinearReconstruction(moments.mean, vectors[:, ::-1][:, :k], float(np.maximum(values[:-k], 0).sum()))


def fit(windows: DataFrame, k: int = BOTTLENECK, window: str = "window") -> LinearReconstruction:
    """Fit the bottleneck on stored windows; ``bottleneck`` of ``window_totals`` needs none.

    Sums are made by the executors; only matrices of the window length reach the driver.
    """
    vectors = windows.select(array_to_vector(F.col(window)).alias("x"))
    found = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("x")).alias("s")).first().s
    model = PCA(k=k, inputCol="x", outputCol="p").fit(vectors)
    spread = float(found.variance.toArray().sum()) * (found["count"] - 1) / found["count"]
    left = spread * (1 - float(model.explainedVariance.toArray().sum()))
    return LinearReconstruction(np.asarray(found.mean.toArray()), np.asarray(model.pc.toArray()), left)


def score(windows: DataFrame, reconstruction: Column, window: str = "window") -> DataFrame:
    """Score rows by reconstruction error against the row's threshold.

    ``model_id`` and ``threshold`` columns are optional and may hold NULL: defaults apply.
    Every other column is carried through, site and time included.
    """
    def optional(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in windows.columns else F.lit(default)

    carried = [c for c in windows.columns if c not in (window, "model_id", "threshold")]
    scored = windows.select(
        *carried,
        optional("model_id", DEFAULT_MODEL_ID).alias("model_id"),
        optional("threshold", DEFAULT_SCORE_THRESHOLD).alias("threshold"),
        mean_squared_error(F.col(window), reconstruction).alias("score"),
    )
    return scored.withColumn("anomalous", F.col("score") > F.col("threshold"))


def score_messages(scored: DataFrame, time: str = "ts_source") -> DataFrame:
    """Scores as messages for the inference topic."""
    body = F.struct(
        F.col("model_id").alias("modelId"),
        F.col("site_id").alias("siteId"),
        F.col("asset_id").alias("assetId"),
        F.col("signal_id").alias("signalId"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_source"),
        "score", "threshold", "anomalous",
    )
    key = F.concat_ws(":", "site_id", "asset_id", "signal_id", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return scored.select(key.alias("key"), F.to_json(body).alias("value"))


def manifest(
    spark: SparkSession, model_id: str, version: str, checksum: str, target_scope: str, generated_at: datetime,
    input_schema: str = "telemetry-envelope-v1", approval_state: str = "draft", rollback_version: str = "",
) -> DataFrame:
    """One deployment message describing a fitted model, ready for the model contract."""
    fields = {
        "modelId": model_id, "version": version, "checksum": checksum, "inputSchema": input_schema,
        "approvalState": approval_state, "targetScope": target_scope, "rollbackVersion": rollback_version,
        "generatedAt": generated_at.isoformat(),
    }
    return spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])).alias("raw"))
