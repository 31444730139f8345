"""Language-model scores: an interpolated modified Kneser-Ney model of order two, counted in Spark.

1. Tokens are words between blanks, lower-cased A-Z, and one end per text, which is also the context of a first word.
   Training tokens are counted per word; their sum, number and the words that hold at least a shard's share follow.
2. Pairs are counted per batch and sent, as packed runs, to the shard of their first word (a frequent first word is
   spread by the second). A task adds up one shard at a time, writes it as sorted hash arrays to the shared folder, and
   returns what smoothing needs: per context the pairs seen once, twice, ..., per word the contexts it follows.
3. Words with count, back-off weight and lower-order probability are written as sorted arrays in the same way.
4. Scoring tasks memory-map the arrays (a store without paths is read shard by shard) and look up the distinct words
   and pairs of a slice of texts, sorted, shard after shard.

A pair is known by 48 bits in its shard, a word in the counts by 64 bits. Null text is empty: one end token. Rows
repeated with one id each count and are each scored. Without training rows every probability is that of the unknown
word, 1. An empty table gives an empty result; columns other than id, text and the training mark are not read.
"""

from __future__ import annotations

import math
import os
import uuid
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder, saved
from .text import LOWER, NOT_BLANK, hashes, mixed, slices, words

SHARD_TOKENS = 2_000_000
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_SHIFT = np.uint64(16)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_FLUSH = 1_500_000  # tokens that are counted together


# --- tokens ---------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and where each row's begin (and the total)."""
    lower = LOWER[data]
    starts, ends, first = words(lower, offsets, NOT_BLANK)
    h = hashes(lower, starts, ends)
    edges = first + np.arange(len(first))
    out = np.full(edges[-1], END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = h
    return out, edges


def contexts(h: np.ndarray) -> np.ndarray:
    """The token before each; the first of a row has the END of the row before, which says the same."""
    return np.concatenate([[END], h[:-1]]) if len(h) else h


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(u * _PAIR + v)


def tallied(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.unique(h, return_counts=True)
    return values, n.astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash) and n over all tokens of one text column."""

    def work(batches):
        for batch in batches:
            held, size = [], 0
            for part in slices(batch.column(0)):
                h, _ = tokens(part.data, part.offsets)
                held.append(h)
                size += len(h)
                if size >= _FLUSH:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    def counted(held):
        values, n = tallied(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(work, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- pairs ----------------------------------------------------------------------------


class Plan(NamedTuple):
    bits: int  # of the shard number
    heavy: np.ndarray  # sorted 48-bit words that are spread over all shards; at most 2**bits

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Shard of each pair of 48-bit words."""
        spread = np.isin(u, self.heavy) if len(self.heavy) else np.zeros(len(u), bool)
        top = np.uint64(48 - self.bits)
        return np.where(spread, (pair_key(u, v) >> _SHIFT) >> top, u >> top).astype(np.int64)


def six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def packed_pairs(texts: DataFrame, plan: Plan) -> DataFrame:
    """Per batch and shard: distinct first words, how many pairs each has, the second words, and the counts; and an empty
    row for every shard, so that each gets its file."""

    def work(batches):
        for batch in batches:
            held, size = [], 0
            for part in slices(batch.column(0)):
                h, _ = tokens(part.data, part.offsets)
                held.append(np.stack([contexts(h), h]) >> _SHIFT)
                size += len(h)
                if size >= _FLUSH:
                    yield packed(held)
                    held, size = [], 0
            if held:
                yield packed(held)

    def packed(held):
        u, v = np.concatenate(held, axis=1)
        _, at, n = np.unique(pair_key(u, v), return_index=True, return_counts=True)
        u, v = u[at], v[at]
        shard = plan.shard(u, v)
        order = np.lexsort((u, shard))
        u, v, n, shard = u[order], v[order], n[order].astype(np.uint32), shard[order]
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            heads = np.flatnonzero(np.concatenate([[True], u[a + 1 : b] != u[a : b - 1]]))
            length = np.diff(np.append(heads, b - a)).astype(np.uint32)
            rows.append((int(shard[a]), six_bytes(u[a:b][heads]), length.tobytes(), six_bytes(v[a:b]), n[a:b].tobytes()))
        names = ["shard", "u", "length", "v", "n"]
        kinds = [pa.int64()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    none = F.lit(b"").cast("binary")
    every = texts.sparkSession.range(1 << plan.bits).select(F.col("id").alias("shard"), *[none.alias(c) for c in ("u", "length", "v", "n")])
    return texts.mapInArrow(work, "shard bigint, u binary, length binary, v binary, n binary").unionAll(every)


def merged_shards(packed: DataFrame, where: str, parts: int) -> DataFrame:
    """Writes every shard's sorted arrays below ``where``; returns word, n1 ... n5 (followers seen once, twice, three
    times, four times, more often) and follows (distinct contexts), in parts to be added up."""
    schema = "word bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, n5 bigint, follows bigint"

    def work(batches):
        at, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column(0)[r].as_py()
                if shard != at and held:
                    yield from one(at, held)
                    held = []
                at = shard
                u, length, v, n = (batch.column(k)[r].as_py() for k in range(1, 5))
                held.append((np.repeat(from_six_bytes(u), np.frombuffer(length, np.uint32)), from_six_bytes(v), np.frombuffer(n, np.uint32)))
        if held:
            yield from one(at, held)

    def one(shard, held):
        u, v, n = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(u):
            write_shard(f"{where}/pairs-{shard}", np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return
        key = pair_key(u, v)
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        u, v, n = u[order][heads], v[order][heads], np.add.reduceat(n[order].astype(np.int64), heads)
        write_shard(f"{where}/pairs-{shard}", key[heads], n)
        order = np.argsort(u)
        heads = np.flatnonzero(np.concatenate([[True], u[order][1:] != u[order][:-1]]))
        seen = [np.add.reduceat((np.minimum(n, 5) == k)[order].astype(np.int64), heads) for k in range(1, 6)]
        word, follows = tallied(v)
        zero = np.zeros(len(word), np.int64)
        for columns in ([u[order][heads].astype(np.int64), *seen, np.zeros(len(heads), np.int64)], [word.astype(np.int64), *[zero] * 5, follows]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "n1", "n2", "n3", "n4", "n5", "follows"])

    rows = packed.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(work, schema)
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "n5", "follows")])


# --- files ----------------------------------------------------------------------------


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would resolve it by, so that every worker means the same store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def store(uri: str, arrays: list[np.ndarray]) -> None:
    """One file: the lengths of the arrays in bytes, then the arrays. It appears whole or not at all."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    data = [np.array([len(x) for x in raw], np.int64).tobytes(), *raw]
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(path) as out:
            for x in data:
                out.write(x)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for x in data:
            out.write(x)
    os.replace(part, path)


def load(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped where the store has paths. Every shard has a file: one that is missing is an error."""
    path = _local(uri)
    if path is not None:
        data = np.memmap(path, np.uint8, "r")
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    head = 8 * len(kinds)
    ends = head + np.cumsum(data[:head].view(np.int64))
    return [data[e - n : e].view(k) for e, n, k in zip(ends, np.diff(ends, prepend=head), kinds, strict=True)]


def write_shard(uri: str, key: np.ndarray, n: np.ndarray) -> None:
    """Pairs by the upper 48 bits of their sorted keys: a table of the first 16, the other 32, and codes of counts."""
    values, code = np.unique(n, return_inverse=True)
    kind = np.uint16 if len(values) < 1 << 16 else np.uint32
    index = np.searchsorted(key >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)
    rest = ((key >> _SHIFT) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    store(uri, [index, rest, code.astype(kind).view(np.uint8), values.astype(np.int64)])


def pair_counts(uri: str, key: np.ndarray) -> np.ndarray:
    """Counts of pairs in one shard; 0 where the pair was not seen."""
    index, rest, code, values = load(uri, ["<u4", "<u4", "u1", "<i8"])
    out = np.zeros(len(key), np.int64)
    if not len(rest):
        return out
    code = code.view(np.uint16 if len(code) == 2 * len(rest) else np.uint32)
    bucket, wanted = (key >> np.uint64(48)).astype(np.int64), ((key >> _SHIFT) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low, high = index[bucket].astype(np.int64), index[bucket + 1].astype(np.int64)
    end = high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        less = open_ & (rest[np.minimum(mid, len(rest) - 1)] < wanted)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    at = np.minimum(low, len(rest) - 1)
    hit = (low < end) & (rest[at] == wanted)
    out[hit] = values[code[at[hit]]]
    return out


# --- model ----------------------------------------------------------------------------


def discounts(t: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more, from how many events have count 1, 2, 3, 4.

    Where the estimate is not above 0 and up to the count, half the count is taken: no event may get probability 0.
    """
    t1, t2, t3, t4 = (float(x or 0) for x in t)
    y = t1 / (t1 + 2 * t2) if t1 else 0.5
    out = [0.0]
    for k, a, b in ((1, t1, t2), (2, t2, t3), (3, t3, t4)):
        estimate = k - (k + 1) * y * b / a if a else 0.0
        out.append(estimate if 0 < estimate <= k else k / 2)
    return np.array(out)


class Model(NamedTuple):
    where: str
    plan: Plan
    tokens: int
    vocabulary: int
    pair_discounts: np.ndarray
    unknown: float  # probability of an unknown word

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, back-off weight and lower-order probability of sorted word hashes."""
        n, back, low = np.zeros(len(h), np.int64), np.ones(len(h)), np.full(len(h), self.unknown)
        for shard, a, b in shard_runs((h >> np.uint64(64 - self.plan.bits)).astype(np.int64) if self.plan.bits else np.zeros(len(h), np.int64)):
            found = load(f"{self.where}/words-{shard}", ["<u8", "<i8", "<f8", "<f8"])
            if not len(found[0]):
                continue
            at = np.minimum(np.searchsorted(found[0], h[a:b]), len(found[0]) - 1)
            hit = found[0][at] == h[a:b]
            for out, values in zip((n, back, low), found[1:], strict=True):
                out[a:b][hit] = values[at[hit]]
        return n, back, low


def shard_runs(shard: np.ndarray):
    """(shard, first, end) of the runs of a sorted array of shard numbers."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[a]), int(a), int(b)


def fit(texts: DataFrame) -> Model:
    """Counts the training texts (one text column) and writes the model below the shared folder."""
    spark = texts.sparkSession
    where = qualified(spark, folder(spark, "kneser-ney"))
    counted = saved(word_counts(texts), "word-counts")
    total, vocabulary = counted.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    bits = max(0, math.ceil(math.log2(max(total, 1) / SHARD_TOKENS)))
    frequent = counted.filter(F.col("n") >= total / 2**bits).select("word").toArrow().column("word").to_numpy() if bits else []
    plan = Plan(bits, np.unique(np.asarray(frequent, np.int64).view(np.uint64) >> _SHIFT))
    parts = max(2**bits, 1)
    stats = saved(merged_shards(packed_pairs(texts, plan), where, parts), "pair-counts")
    sums = stats.agg(
        *[F.sum(f"n{k}").cast("bigint") for k in range(1, 5)],
        *[F.count_if(F.col("follows") == k) for k in range(1, 5)],
        F.sum("follows").cast("bigint"), F.count_if(F.col("follows") >= 3),
    ).first()
    d2, d1 = discounts(sums[:4]), discounts(sums[4:8])
    kinds = float(sums[8] or 0)
    # Lower order: discounted shares of distinct contexts, the rest spread evenly over all words and the unknown one.
    rest = (d1[1] * sums[4] + d1[2] * sums[5] + d1[3] * (sums[9] or 0)) / kinds / (vocabulary + 1) if kinds else 1.0
    three = F.col("n3") + F.col("n4") + F.col("n5")
    back = (d2[1] * F.col("n1") + d2[2] * F.col("n2") + d2[3] * three) / F.col("n")
    cut = F.when(F.col("follows") >= 3, float(d1[3])).when(F.col("follows") == 2, float(d1[2])).when(F.col("follows") == 1, float(d1[1])).otherwise(0.0)
    low = (F.col("follows") - cut) / max(kinds, 1.0) + rest
    full = counted.join(stats.withColumnRenamed("word", "short"), F.shiftrightunsigned(counted["word"], 16) == F.col("short"))
    shard = F.shiftrightunsigned("word", 64 - bits) if bits else F.lit(0).cast("bigint")
    full = full.select(shard.alias("shard"), "word", "n", back.alias("back"), low.alias("low"))

    def work(batches):
        at, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            for shard, a, b in shard_runs(own):
                if shard != at and held:
                    yield write(at, held)
                    held = []
                at = shard
                held.append([batch.column(k).slice(a, b - a).to_numpy() for k in range(1, 5)])
        if held:
            yield write(at, held)

    def write(shard, held):
        word, n, back, low = (np.concatenate(x) for x in zip(*held, strict=True))
        real = n > 0
        word, n, back, low = word[real].astype(np.int64).view(np.uint64), n[real].astype(np.int64), back[real], low[real]
        order = np.argsort(word)
        store(f"{where}/words-{shard}", [word[order], n[order], back[order], low[order]])
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(word)])], names=["shard", "n"])

    every = spark.range(1 << bits).select(F.col("id").alias("shard"), *[F.lit(0).cast(t) for t in ("bigint", "bigint", "double", "double")])
    full = full.unionAll(every)
    done = full.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(work, "shard bigint, n bigint")
    done.agg(F.sum("n")).collect()
    return Model(where, plan, total, vocabulary, d2, rest)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score and score (log10), perplexity."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"

    def work(batches):
        for batch in batches:
            for part in slices(batch.column(1), 4 << 20):
                h, edges = tokens(part.data, part.offsets)
                columns = score_slice(model, h, edges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.last - part.first), *map(pa.array, columns)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def score_slice(model: Model, h: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    word, at = np.unique(h, return_inverse=True)
    n, back, low = model.words(word)
    before = np.concatenate([[np.searchsorted(word, END)], at[:-1]])
    short = word >> _SHIFT
    # Distinct pairs, by shard and key.
    pair, place = np.unique(before.astype(np.int64) * len(word) + at, return_inverse=True)
    first, second = np.divmod(pair, len(word))
    shard, key = model.plan.shard(short[first], short[second]), pair_key(short[first], short[second])
    order = np.lexsort((key, shard))
    count = np.zeros(len(pair), np.int64)
    for s, a, b in shard_runs(shard[order]):
        count[order[a:b]] = pair_counts(f"{model.where}/pairs-{s}", key[order[a:b]])
    total = np.maximum(n[first], 1)
    p = np.maximum(count - model.pair_discounts[np.minimum(count, 3)], 0) / total + np.where(n[first] > 0, back[first], 1.0) * low[second]
    per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
    exact = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  every row has its END
    size = np.diff(edges)
    score = exact(np.log10(p)[place])
    base = exact(np.log10((n + 1) / (model.tokens + model.vocabulary + 1))[at])
    return [size.astype(np.int64), per_row((n > 0)[at].astype(np.int64)), base, score, 10 ** (-score / size)]


def train_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all rows with the model of those where ``train`` holds; train_tokens is its number of tokens."""
    model = fit(docs.filter(train).select(text_col))
    return scored(docs, model, id_col, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
