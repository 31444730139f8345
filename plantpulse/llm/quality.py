"""Quality scores: random Fourier features over document statistics, ridge from summed normal equations, isotonic calibration.

Statistics of a whole text (``STATISTICS``, none of them knows a language) are worked out once in NumPy over slices of whole
documents and stored. Standardised by the learned rows' means and deviations they are mapped to ``features`` cosines of random
projections, whose inner products approximate a Gaussian kernel. Each task adds up its rows' normal equations, Spark sums
them over the tasks, and the driver solves one system whose size is the number of features. The ridge values of the learned
rows, each corrected to what a fit without that row gives (exact, from the same matrix), are summed in ``BINS`` bins and
pooled to rising label shares; a score is read from that curve. All labelled rows are learned from; nothing is sampled.

Labels repeated for an id count as their mean; null labels and ids are ignored. Documents that share an id are each learned
with its label. Null text is an empty one; empty texts are scored too. Without any label the score is 0.5. Ids, labels and
other columns never enter a score. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType

from .scratch import saved
from .text import NOT_BLANK, hashes, slices, words

FEATURES = 256
#: Kernel width as a multiple of the square root of the number of statistics.
WIDTH = 1.0
RIDGE = 1e-3
BINS = 4096
#: Tasks add up their matrices in so many groups first.
SALTS = 16
#: Ridge values outside are calibrated as the nearest end.
LOW, HIGH = -1.0, 2.0

# Kinds of bytes, by what a reader takes them for.
KINDS = ["other", "lower", "upper", "digit", "space", "line", "sentence", "mark", "symbol", "beyond"]
KIND = np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 9
KIND[[32, 9]], KIND[[10, 13]] = 4, 5
KIND[list(b".,")], KIND[list(b"!?;:'\"()-")], KIND[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 6, 7, 8
LETTER = (KIND == 1) | (KIND == 2) | (KIND == 9)

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "log_longest_word", "words_per_line", *[f"share_{k}" for k in KINDS],
    "same_as_before", "distinct_words", "top_word", "capital_words", "upper_words", "no_letter_words", "symbol_ends", "distinct_lines", "same_byte",
]
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; ``first`` has the number of each row's first value, and the total."""
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its most frequent one occurs."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    begins = np.ones(len(h), bool)
    begins[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(begins)
    most = np.zeros(rows)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(h))))
    return np.bincount(row[at], minlength=rows).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text; shares of an empty text are 0."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    share = lambda part, whole: part / np.maximum(whole, 1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kind = np.bincount(row * len(KINDS) + KIND[data], minlength=rows * len(KINDS)).reshape(rows, len(KINDS))
    starts, ends, first = words(data, offsets, NOT_BLANK)
    n, length = np.diff(first).astype(float), ends - starts
    h = hashes(data, starts, ends)
    before = np.zeros(len(h), bool)
    before[1:] = h[1:] == h[:-1]
    before[first[:-1][first[:-1] < len(h)]] = False
    distinct, top = _repeats(h, first)
    longest = np.zeros(rows)
    np.maximum.at(longest, np.repeat(np.arange(rows), np.diff(first)), length)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, uppers = (c[ends] - c[starts] for c in (count(LETTER[data]), count(KIND[data] == 2)))
    head, tail = (KIND[data[starts]], KIND[data[ends - 1]]) if len(starts) else (np.zeros(0), np.zeros(0))
    line_starts, line_ends, line_first = words(data, offsets, _LINE)
    lines = np.diff(line_first).astype(float)
    distinct_lines, _ = _repeats(hashes(data, line_starts, line_ends), line_first)
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    columns = [
        np.log1p(size), np.log1p(n), share(_per_row(length, first), n), np.log1p(longest), np.log1p(share(n, lines)),
        *(share(kind[:, k], size) for k in range(len(KINDS))),
        share(_per_row(before, first), n), share(distinct, n), share(top, n), share(_per_row(head == 2, first), n),
        share(_per_row((uppers == letters) & (letters > 1), first), n), share(_per_row(letters == 0, first), n),
        share(_per_row(tail == 8, first), n), share(distinct_lines, lines), share(_per_row(same, offsets), size),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of the text (column ``statistics``) in its place."""
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def work(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, len(STATISTICS)), np.float32)
            for part in slices(batch.column(len(kept))):
                found[part.first : part.last] = statistics(part.data, part.offsets)
            values = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], values], names=[*[f.name for f in kept], "statistics"])

    schema = StructType([*kept]).add("statistics", ArrayType(FloatType()))
    return docs.select(*[f.name for f in kept], text_col).mapInArrow(work, schema)


class Model(NamedTuple):
    mean: np.ndarray
    deviation: np.ndarray
    projection: np.ndarray  # statistics x features
    phase: np.ndarray
    weights: np.ndarray  # of the features, and the constant
    curve: tuple[np.ndarray, np.ndarray]  # ridge values and the label shares there


def fourier(model: Model, found: np.ndarray) -> np.ndarray:
    """Features of rows of statistics, and a constant."""
    z = np.cos(((found - model.mean) / model.deviation) @ model.projection + model.phase) * np.sqrt(2 / len(model.phase))
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS)).astype(float)


def _summed(labelled: DataFrame, part) -> np.ndarray:
    """The sum over all tasks of the matrix that ``part`` makes of a task's batches, added up row by row in two steps."""

    def work(batches):
        total = part(batches)
        values = pa.array(list(total), pa.list_(pa.float64()))
        salt = np.full(len(total), np.random.default_rng().integers(SALTS), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(salt), values], names=["i", "salt", "v"])

    def add(group: pa.Table) -> pa.Table:
        v = group.column("v").combine_chunks()
        total = v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)
        return pa.table({"i": group.column("i")[:1], "salt": group.column("salt")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    schema = "i int, salt int, v array<double>"
    rows = labelled.select("statistics", "label").mapInArrow(work, schema).groupBy("i", "salt").applyInArrow(add, schema)
    return np.array([r.v for r in sorted(rows.groupBy("i").applyInArrow(add, schema).collect(), key=lambda r: r.i)])


def _moments(labelled: DataFrame) -> np.ndarray:
    """Rows, sums and sums of squares of the statistics."""

    def part(batches):
        total = np.zeros((3, len(STATISTICS)))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += [np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        return total

    return _summed(labelled, part)


def _equations(labelled: DataFrame, model: Model) -> np.ndarray:
    """Sums of z z' | z y over all rows, one small matrix a task."""
    size = len(model.phase) + 1

    def part(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(model, _matrix(batch.column(0)))
            total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        return total

    return _summed(labelled, part)


def pooled(x: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: means of x and of the share of each pool, both rising."""
    pools: list[list[float]] = []
    for a, s, w in zip(x, share, weight, strict=True):
        pools.append([a * w, s * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by elimination, which needs no pivots there. The matrix is small, and the threads
    of a linear algebra library were seen to stall in a driver that had started its JVM."""
    size = len(matrix)
    both = np.concatenate([matrix, np.eye(size)], axis=1)
    for k in range(size):
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, size:]


def _curve(labelled: DataFrame, model: Model, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration: label shares over the values that a fit without the row gives."""

    def work(batches):
        total = np.zeros((3, BINS))
        for batch in batches:
            z, y = fourier(model, _matrix(batch.column(0))), batch.column(1).to_numpy()
            pull = np.minimum(np.einsum("ij,jk,ik->i", z, inverse, z, optimize=True), 0.999)
            value = np.clip((z @ model.weights - pull * y) / (1 - pull), LOW, HIGH)
            at = np.minimum(((value - LOW) / (HIGH - LOW) * BINS).astype(np.int64), BINS - 1)
            total += [np.bincount(at, w, BINS) for w in (np.ones(len(y)), value, y)]
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(t[at]) for t in total]], names=["bin", "n", "value", "label"])

    rows = labelled.select("statistics", "label").mapInArrow(work, "bin int, n double, value double, label double")
    bins = rows.groupBy("bin").agg(F.sum("n"), F.sum("value"), F.sum("label")).collect()
    _, n, value, label = np.array(sorted(map(tuple, bins))).T
    return pooled(value / n, label / n, n)


def fit(measured_rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES, seed: int = 17) -> Model | None:
    """The model of ``measured_rows`` (id and statistics) that have a label; None where none has."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
    labelled = measured_rows.select(F.col(id_col).alias("id"), "statistics").join(marks, "id").select("statistics", F.col("label").cast("double").alias("label"))
    labelled = saved(labelled, "labelled")
    rows, sums, squares = _moments(labelled)
    n = int(rows[0])
    if not n:
        return None
    mean = sums / n
    deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    random = np.random.default_rng(seed)
    projection = random.normal(size=(len(STATISTICS), features)) / (WIDTH * np.sqrt(len(STATISTICS)))
    model = Model(mean, np.where(deviation > 1e-6, deviation, 1.0), projection, random.uniform(0, 2 * np.pi, features), np.zeros(0), (np.zeros(0),) * 2)
    sums = _equations(labelled, model)
    penalty = np.full(features + 1, RIDGE * n)
    penalty[-1] = RIDGE  # next to none for the constant
    inverse = inverted(sums[:, :-1] + np.diag(penalty))
    model = model._replace(weights=(inverse * sums[:, -1]).sum(axis=1))
    return model._replace(curve=_curve(labelled, model, inverse))


def scored(measured_rows: DataFrame, model: Model | None) -> DataFrame:
    """``measured_rows`` with score and predicted in the place of the statistics."""
    kept = [f for f in measured_rows.schema.fields if f.name != "statistics"]

    def work(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model and batch.num_rows:
                score = np.interp(fourier(model, _matrix(batch.column(len(kept)))) @ model.weights, *model.curve)
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score), predicted], names=[*[f.name for f in kept], "score", "predicted"])

    schema = StructType([*kept]).add("score", DoubleType()).add("predicted", IntegerType())
    return measured_rows.select(*[f.name for f in kept], "statistics").mapInArrow(work, schema)


def quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of ``carry``, score and predicted of every row; learned from the labels of rows where ``learn`` holds."""
    named = {k: c.alias(k) for k, c in (carry or {}).items()}
    rows = docs.select(F.col(id_col), *named.values(), learn.alias("_learn"), F.col(text_col))
    rows = saved(measured(rows, text_col), "statistics")
    model = fit(rows.filter("_learn"), labels, id_col, label_col)
    return scored(rows.drop("_learn"), model)
