"""Exact deduplication over content-defined chunk recipes.

1. Each text, lower-cased A-Z, is cut where a rolling hash of the last 32 bytes hits a mask, so equal texts get
   equal cuts. Its recipe is the ordered list of the SHA-256 digests of its chunks.
2. The bytes of each chunk move once, as grouping key next to the digest; copies shrink before the shuffle. A digest
   with exactly one content is verified and gets a number; a second content stops the job.
3. Recipes become ordered lists of chunk numbers, and documents with equal lists are copies. Documents themselves
   never move.

Null text counts as empty; empty texts are equal to each other. Null ids are kept: the largest id of a group is the
largest that is not null, and null if there is none. Rows repeated with one id each count, and one of them stays.
An empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .scratch import saved
from .text import LOWER, slices

LEAST, MOST, MASK = 1 << 10, 1 << 16, (1 << 12) - 1
_GEAR = np.random.default_rng(20240608).integers(0, 2**32, 256, dtype=np.uint32)


def cut_marks(data: np.ndarray) -> np.ndarray:
    """Positions after which a cut may lie: the gear hash of the 32 bytes up to there hits the mask."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1


def chunks(text: bytes, data: np.ndarray) -> list[bytes]:
    """The chunks of one text, from ``LEAST`` to ``MOST`` bytes but for the last."""
    if len(text) <= LEAST:
        return [text] if text else []
    marks, out, at = cut_marks(data), [], 0
    while at < len(text):
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else len(text), at + MOST, len(text))
        out.append(text[at:end])
        at = end
    return out


def _chunked(column: pa.Array) -> Iterator[tuple[int, bytes, list[bytes]]]:
    for part in slices(column):
        lower = LOWER[part.data]
        whole = lower.tobytes()
        for k in range(part.last - part.first):
            a, b = int(part.offsets[k]), int(part.offsets[k + 1])
            yield part.first + k, whole[a:b], chunks(whole[a:b], lower[a:b])


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, text_sha256 and the ordered chunk digests of every row."""
    schema = StructType([
        StructField("id", docs.schema[id_col].dataType), StructField("n_bytes", LongType()),
        StructField("text_sha256", StringType()), StructField("recipe", ArrayType(BinaryType())),
    ])

    def work(batches):
        for batch in batches:
            digests, sizes, lists = [], [], []
            for _, text, parts in _chunked(batch.column(1)):
                digests.append(hashlib.sha256(text).hexdigest())
                sizes.append(len(text))
                lists.append([hashlib.sha256(x).digest() for x in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.binary()))],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest and bytes of every distinct chunk; a digest with two contents would stand in two rows."""

    def work(batches):
        for batch in batches:
            sent: dict[bytes, bytes] = {}
            for _, _, parts in _chunked(batch.column(0)):
                for x in parts:
                    digest = hashlib.sha256(x).digest()
                    if sent.get(digest) == x:
                        continue
                    if digest in sent:
                        yield _pairs({digest: x})  # another content under the same digest
                    sent.setdefault(digest, x)
                if len(sent) >= 4096:
                    yield _pairs(sent)
                    sent = {}
            if sent:
                yield _pairs(sent)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "digest binary, chunk binary")
    return rows.groupBy("digest", "chunk").agg(F.count("*").alias("n"))


def _pairs(rows: dict[bytes, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.binary())], names=["digest", "chunk"]
    )


def identifiers(store: DataFrame) -> DataFrame:
    """digest and number of every verified chunk, written once so that the numbers stay."""
    counted = store.groupBy("digest").agg(F.count("*").alias("contents"))
    checked = F.when(F.col("contents") == 1, F.col("digest")).otherwise(F.raise_error(F.lit("two chunks share a digest")))
    return saved(counted.select(checked.alias("digest"), F.monotonically_increasing_id().alias("chunk_id")), "chunk-ids")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks."""
    rows = recipes(docs, id_col, text_col).groupBy("id", "n_bytes", "text_sha256", "recipe").agg(F.count("*").alias("times"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    ids = identifiers(chunk_store(docs, text_col))
    listed = (
        rows.select("row", F.posexplode("recipe").alias("at", "digest")).join(ids, "digest")
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))).alias("found"))
        .select("row", F.col("found.chunk_id").alias("ids"))
    )
    listed = saved(
        rows.drop("recipe").join(listed, "row", "left")
        .withColumn("ids", F.coalesce("ids", F.expr("array()").cast("array<bigint>"))),
        "recipe-ids",
    )
    groups = saved(listed.groupBy("ids").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size")), "copy-groups")
    return (
        listed.join(groups, "ids")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
        .withColumn("stays", F.col("id").eqNullSafe(F.col("keep_id")))
        .select(
            F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
            "text_sha256", "n_bytes", F.size("ids").cast("bigint").alias("n_chunks"),
        )
    )
