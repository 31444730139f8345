"""Benchmark decontamination over a distributed positional inverted index.

1. ``build_index`` stores the postings of every training token: per shard (a slice of whole documents) the sorted term
   hashes, how often each occurs, and its positions. Shards are written as Parquet; none is shuffled, so a frequent
   term is spread over all shards.
2. ``matches`` sends the benchmark's word windows over the shards in blocks of bounded size. In a shard the rarest
   term of a window gives the candidates; the lists of the other terms, moved by their offsets, are intersected from
   rare to frequent. What remains are exact phrases. Proximity matches are windows whose terms all lie within
   ``slack`` words of a posting of the rarest one, in any order.

Positions leave gaps between documents, so no match crosses them. Null or empty texts have no words; an item without
words has no window; an item with a null id still marks words but is not listed. Repeated items or rows count as
themselves. Empty tables give no rows (documents) or no hits (benchmark). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .scratch import saved
from .text import LOWER, TERM, hashes, runs, slices, words

WINDOW = 10
GAP = 64
BLOCK_WORDS = 200_000  # words of the benchmark that are sent over the shards at once
STEP = 1 << 20  # candidates looked at together


# --- index ----------------------------------------------------------------------------


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: ids and first positions of its documents, and the postings of its terms."""
    schema = StructType([
        StructField("shard", LongType()), StructField("ids", ArrayType(docs.schema[id_col].dataType)),
        StructField("n_words", ArrayType(IntegerType())), StructField("terms", BinaryType()),
        StructField("counts", BinaryType()), StructField("gaps", BinaryType()),
    ])

    def work(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                data = LOWER[part.data]
                starts, ends, first = words(data, part.offsets, TERM)
                terms, counts, positions = postings(hashes(data, starts, ends), first)
                # Positions of a term as differences, which compress; the first counts from zero.
                gaps = np.diff(positions, prepend=np.uint32(0))
                heads = np.cumsum(counts) - counts
                gaps[heads] = positions[heads]
                row_ids = ids.slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids),
                        pa.array([np.diff(first).astype(np.int32)], pa.list_(pa.int32())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype(np.uint32), gaps)),
                    ],
                    names=schema.names,
                )
                shard += 1

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def postings(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, their counts, and their positions (term by term, ascending), with gaps between documents."""
    place = np.arange(len(h)) + GAP * np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h, kind="stable")
    terms, counts = np.unique(h, return_counts=True)
    return terms, counts, place[order].astype(np.uint32)


class Shard(NamedTuple):
    terms: np.ndarray
    counts: np.ndarray
    heads: np.ndarray  # where the postings of each term begin
    keys: np.ndarray  # all postings as term number * 2**32 + position, ascending
    n_words: np.ndarray

    @classmethod
    def load(cls, terms: bytes, counts: bytes, gaps: bytes, n_words: np.ndarray) -> Shard:
        terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
        gaps = np.frombuffer(gaps, np.uint32).astype(np.int64)
        heads = np.cumsum(counts) - counts
        total = np.cumsum(gaps)
        base = total[heads] - gaps[heads] if len(heads) else heads
        number = np.repeat(np.arange(len(terms)), counts)
        keys = (number << 32) + total - base[number] if len(terms) else gaps
        return cls(terms, counts, heads, keys, n_words)

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = (number << 32) + position
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def near(self, number: np.ndarray, position: np.ndarray, slack: int) -> np.ndarray:
        """Whether the term has a posting within ``slack`` positions."""
        at = np.searchsorted(self.keys, (number << 32) + np.maximum(position - slack, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (found <= (number << 32) + position + slack)


# --- test windows ---------------------------------------------------------------------


class Block(NamedTuple):
    """Windows of one length: distinct rows of term hashes, and the items each belongs to (numbers into ``items``)."""

    length: int
    rows: np.ndarray
    heads: np.ndarray
    members: np.ndarray


def item_windows(texts: list[str | None], window: int = WINDOW) -> list[Block]:
    data = pa.array([t or "" for t in texts], pa.string())
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for part in slices(data):
        lower = LOWER[part.data]
        starts, ends, first = words(lower, part.offsets, TERM)
        h = hashes(lower, starts, ends)
        for k in range(part.last - part.first):
            own = h[first[k] : first[k + 1]]
            if len(own):
                rows = np.lib.stride_tricks.sliding_window_view(own, min(len(own), window))
                parts.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), part.first + k)))
    out = []
    for length, found in sorted(parts.items()):
        rows, items = np.concatenate([r for r, _ in found]), np.concatenate([i for _, i in found])
        name = runs(rows.ravel(), length)[::length]
        order = np.lexsort((items, name))
        rows, items, name = rows[order], items[order], name[order]
        heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        out.append(Block(length, rows[heads], np.append(heads, len(name)), items))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple[list, list[Block]]]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text or "") // 5 + 1
        if size >= BLOCK_WORDS:
            yield ids, item_windows(texts, window)
            ids, texts, size = [], [], 0
    yield ids, item_windows(texts, window)


# --- matching -------------------------------------------------------------------------


def search(shard: Shard, block: Block, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact phrases, and (window, position) of proximity matches."""
    none = np.zeros(0, np.int64)
    if not len(shard.terms):
        return none, none, none, none
    number = np.searchsorted(shard.terms, block.rows)
    number = np.minimum(number, len(shard.terms) - 1)
    alive = np.flatnonzero((shard.terms[number] == block.rows).all(axis=1))
    if not len(alive):
        return none, none, none, none
    number = number[alive]
    order = np.argsort(shard.counts[number], axis=1, kind="stable")
    rarest = np.take_along_axis(number, order[:, :1], 1)[:, 0]
    size = shard.counts[rarest]
    upto = np.cumsum(size)
    exact, close = [], []
    at = 0
    while at < len(alive):
        # Windows whose candidates fill one step; a single window may exceed it by its own postings in this shard.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        w = np.repeat(np.arange(at, end), size[at:end])
        head = np.repeat(shard.heads[rarest[at:end]], size[at:end])
        within = np.arange(len(w)) - np.repeat(np.cumsum(size[at:end]) - size[at:end], size[at:end])
        position = shard.keys[head + within] & 0xFFFFFFFF
        start = position - order[w, 0]
        fits, loose = start >= 0, np.ones(len(w), bool)
        for k in range(1, block.length):
            column = order[w, k]
            terms = number[w, column]
            loose[loose] = shard.near(terms[loose], position[loose], slack)
            fits &= loose  # a phrase is no longer than the slack
            fits[fits] = shard.has(terms[fits], start[fits] + column[fits])
            if not loose.any():
                break
        exact.append((alive[w[fits]], start[fits]))
        close.append((alive[w[loose]], position[loose]))
        at = end
    join = lambda x, i: np.concatenate([y[i] for y in x])
    return join(exact, 0), join(exact, 1), join(close, 0), join(close, 1)


def _pairs(block: Block, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct (document, item) pairs of matches."""
    pair = np.unique(np.stack([doc, window], 1), axis=0)
    n = block.heads[pair[:, 1] + 1] - block.heads[pair[:, 1]]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    items = block.members[np.repeat(block.heads[pair[:, 1]], n) + within]
    return np.unique(np.stack([np.repeat(pair[:, 0], n), items], 1), axis=0)


def matches(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slack: int = 20) -> DataFrame:
    """Per document with a match: shard, ordinal, hit word numbers, items (exact), near_items (proximity).

    A document has one row for each block of the benchmark that matches it.
    """
    if not window <= slack < GAP:
        raise ValueError(f"window <= slack < {GAP} is needed")
    spark = index.sparkSession
    item = benchmark.schema[id_col].dataType
    schema = StructType([
        StructField("shard", LongType()), StructField("ordinal", IntegerType()), StructField("hits", ArrayType(IntegerType())),
        StructField("items", ArrayType(item)), StructField("near_items", ArrayType(item)),
    ])
    out = None
    for ids, blocks in benchmark_blocks(benchmark, id_col, text_col, window):
        shared = spark.sparkContext.broadcast((ids, blocks))

        def work(batches, shared=shared):
            ids, blocks = shared.value
            for batch in batches:
                cells = [batch.column(k) for k in range(5)]
                for r in range(batch.num_rows):
                    n_words = np.asarray(cells[1][r].values, np.int64)
                    shard = Shard.load(*(cells[k][r].as_py() for k in (2, 3, 4)), n_words)
                    rows = list(_found(shard, blocks, ids, slack))
                    if rows:
                        names = ("ordinal", "hits", "items", "near_items")
                        listed = {"shard": [cells[0][r].as_py()] * len(rows)} | {n: [x[k] for x in rows] for k, n in enumerate(names)}
                        yield from pa.Table.from_pydict(listed, schema=_arrow(schema)).to_batches()

        found = index.select("shard", "n_words", "terms", "counts", "gaps").mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _found(shard: Shard, blocks: list[Block], ids: list, slack: int) -> Iterator[tuple]:
    """(ordinal, hit words, items, near items) of each document of a shard with a match."""
    if not shard.n_words.sum():
        return
    first = np.cumsum(shard.n_words) - shard.n_words + GAP * np.arange(len(shard.n_words))
    marks, pairs, near = [], [], []
    for block in blocks:
        w, start, v, position = search(shard, block, slack)
        if len(w):
            doc = np.searchsorted(first, start, "right") - 1
            marks.append((start[:, None] + np.arange(block.length)).ravel())
            pairs.append(_pairs(block, w, doc))
        if len(v):
            near.append(_pairs(block, v, np.searchsorted(first, position, "right") - 1))
    if not pairs and not near:
        return
    empty = np.zeros((0, 2), np.int64)
    hit = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    owner = np.searchsorted(first, hit, "right") - 1
    pair = np.unique(np.concatenate([empty, *pairs]), axis=0)
    close = np.unique(np.concatenate([empty, *near]), axis=0)
    for d in np.unique(np.concatenate([pair[:, 0], close[:, 0]])):
        names = [[ids[i] for i in x[x[:, 0] == d][:, 1] if ids[i] is not None] for x in (pair, close)]
        yield int(d), (hit[owner == d] - first[d]).tolist(), *names


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slack: int = 20,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items and near_items (sorted as strings), contaminated."""
    index = saved(build_index(docs, id_col, text_col), "index")
    found = matches(index, benchmark, item_col, item_text_col, window, slack)
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    named = lambda c: F.array_sort(F.array_distinct(F.transform(gathered(c), lambda x: x.cast("string"))))
    found = found.groupBy("shard", "ordinal").agg(
        F.size(gathered("hits")).cast("bigint").alias("n_hit"), named("items").alias("items"), named("near_items").alias("near_items")
    )
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "doc"))
    none = F.expr("array()").cast("array<string>")
    return rows.join(found, ["shard", "ordinal"], "left").select(
        F.col("doc.ids").alias("doc_id"), F.col("doc.n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
