"""Language identification by prediction by partial matching over bytes.

Training counts, per language, how often each byte follows each context of up to ``ORDER`` bytes; the counts come from
at most ``per_language`` labelled rows of each language, those with the smallest hash of id and text, read in full. The
context trees are then frozen. The code length of a byte is that of PPM with escape method C, without exclusions: in
the longest context seen, a follower seen c times of n with d distinct followers costs log2((n+d)/c) bits; another
byte costs the escape log2((n+d)/d) and is coded in the next shorter context, at last as one of 256. As the
statistics are frozen, all code lengths are worked out once, into hash tables with a column per language, and scoring
a text is a sum of table entries over its bytes.

The language with the shortest code wins; ties go to the smaller name. Its score is its share of the probability,
2**-bits over the sum for all languages. Null text, or text without a letter, is ``und`` with score 0; so is every
text when there is nothing to learn from. Rows with null text or language are not learned from; null ids are, and
rows that repeat id and text are learned once. Rows repeated with one id get equal results. An empty table gives an empty result. Columns other than id, text and language are not read, and
id and language never enter a prediction.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import saved
from .text import slices

ORDER = 4
PER_LANGUAGE = 400
BLOCK = 1 << 16  # bytes looked up together
UNKNOWN = "und"
_EMPTY = np.uint64(2**64 - 1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Table(NamedTuple):
    """Open addressing: ``keys`` of 2**bits slots, and the row of each in ``rows`` (bits per language)."""

    bits: int
    keys: np.ndarray
    slots: np.ndarray
    rows: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, rows: np.ndarray) -> Table:
        bits = max(4, int(len(keys) * 3).bit_length())
        table, slots = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        at, left = cls._slot(keys, bits), np.arange(len(keys))
        while len(left):
            free = table[at] == _EMPTY
            # Of the keys that meet in one free slot, the last written gets it; the others go on to the next.
            slots[at[free]] = left[free]
            table[at[free]] = keys[left[free]]
            rest = slots[at] != left
            at, left = (at[rest] + 1) & ((1 << bits) - 1), left[rest]
        return cls(bits, table, slots, rows)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _PRIME) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is not there."""
        at = self._slot(keys, self.bits)
        seen = self.keys[at]
        out = np.where(seen == keys, self.slots[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        at, keys = at[left], keys[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys
            out[left[hit]] = self.slots[at[hit]]
            more = ~hit & (seen != _EMPTY)
            left, at, keys = left[more], at[more], keys[more]
        return out


class Model(NamedTuple):
    languages: list[str]
    codes: list[Table]  # by context length k: context and byte -> code length in every language, all escapes included
    escapes: list[Table]  # by context length k: context -> escape cost in every language (0 where it was not seen)


def grams(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``length`` bytes inside a row as an integer, and the position of its last byte."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(length):
        key <<= np.uint64(8)
        key |= data[k : k + n]
    inside = np.ones(len(data) + length, bool)
    for k in range(1, length):
        inside[offsets[:-1] + k - 1] = False  # the run would begin in an earlier row
    last = np.arange(length - 1, len(data))
    keep = inside[last]
    return key[keep], last[keep]


def counts(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, length, gram and count of every byte run of up to ORDER + 1 bytes in the sample."""

    def work(batches):
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), object)
            for part in slices(batch.column(0)):
                own = names[part.first : part.last]
                for name in sorted(set(own)):
                    rows = np.flatnonzero(own == name)
                    pieces = [part.data[part.offsets[r] : part.offsets[r + 1]] for r in rows]
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                    for length in range(1, ORDER + 2):
                        key, n = np.unique(grams(np.concatenate(pieces), ends, length)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), length), pa.int32()),
                             pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))],
                            names=["lang", "length", "gram", "n"],
                        )

    rows = sample.select(F.col(text), F.col(lang)).mapInArrow(work, "lang string, length int, gram bigint, n bigint")
    return rows.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def bounded_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """language and key of at most ``per_language`` different rows of each language, by the smallest hash of id and text."""
    from pyspark.sql.window import Window

    keys = docs.select(F.col(lang_col).alias("lang"), sample_key(id_col, text_col).alias("key")).distinct()
    salted = Window.partitionBy("lang", F.pmod("key", F.lit(64))).orderBy("key")
    few = keys.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= per_language)
    final = Window.partitionBy("lang").orderBy("key")
    return few.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= per_language).drop("place")


def sample_key(id_col: str, text_col: str) -> Column:
    """Hash of id and text, whatever is null: rows that share an id are told apart, repeated rows count once."""
    return F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The frozen model. What reaches the driver are the counts of the bounded sample."""
    usable = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    # The keys are few and stored; texts move only once they are chosen.
    chosen = saved(bounded_sample(usable, id_col, text_col, lang_col, per_language), "sample")
    named = usable.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), sample_key(id_col, text_col).alias("key"))
    sample = named.join(chosen, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])
    table = counts(sample, "text", "lang").toArrow()
    length, gram, n = (table.column(c).to_numpy() for c in ("length", "gram", "n"))
    # By number: a name for every count would be millions of small objects on the driver.
    coded = table.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    lang = np.array([languages.index(x) for x in names], int)[coded.indices.to_numpy()]
    return build(languages, lang, length, gram.astype(np.uint64), n)


def build(languages: list[str], lang: np.ndarray, length: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    codes: list[Table] = []
    escapes: list[Table] = []
    for k in range(ORDER + 1):
        own = length == k + 1
        keys, at = np.unique(gram[own], return_inverse=True)
        seen = np.zeros((len(keys), len(languages)))
        seen[at, lang[own]] = n[own]
        contexts, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, parent, seen)
        np.add.at(distinct, parent, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            own_code = np.log2((total + distinct)[parent] / seen)
        shorter = lookup(Model(languages, codes, escapes), keys, k) if k else np.full(seen.shape, 8.0)
        rows = np.where(seen > 0, own_code, escape[parent] + shorter)
        codes.append(Table.build(keys, rows.astype(np.float32)))
        escapes.append(Table.build(contexts, escape.astype(np.float32)))
    return Model(languages, codes, escapes)


def lookup(model: Model, gram: np.ndarray, length: int) -> np.ndarray:
    """Code length, in every language, of the last byte of each gram given up to ``length - 1`` bytes before it."""
    out = np.zeros((len(gram), len(model.languages)), np.float32)
    left = np.arange(len(gram))
    for k in range(length - 1, -1, -1):
        mask = np.uint64(256 ** (k + 1) - 1)
        key = gram[left] & mask
        row = model.codes[k].find(key)
        hit = row >= 0
        out[left[hit]] += model.codes[k].rows[row[hit]]
        left, key = left[~hit], key[~hit]
        if not len(left):
            return out
        # No language has seen the byte here: each escapes from this context, if it knows the context.
        row = model.escapes[k].find(key >> np.uint64(8))
        known = row >= 0
        out[left[known]] += model.escapes[k].rows[row[known]]
    out[left] += 8.0
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every row in every language; the first bytes of a row have shorter contexts."""
    bits = np.zeros((len(offsets) - 1, len(model.languages)))
    for length in range(1, ORDER + 2):
        key, last = grams(data, offsets, length)
        if length <= ORDER:  # only the byte with exactly length - 1 bytes before it
            starts = offsets[:-1][np.diff(offsets) >= length] + length - 1
            at = np.searchsorted(last, starts)
            key, last = key[at], last[at]
        # A block at a time, so that the arrays per byte and language stay small however long the rows are.
        edges = np.searchsorted(last, offsets)
        sums = np.zeros((len(edges), len(model.languages)))
        before = np.zeros(len(model.languages))
        for low in range(0, len(key), BLOCK):
            cost = lookup(model, key[low : low + BLOCK], length)
            total = np.cumsum(np.concatenate([before[None], cost]), axis=0)
            i, j = np.searchsorted(edges, low), np.searchsorted(edges, low + len(cost), "right")
            sums[i:j] = total[edges[i:j] - low]
            before = total[-1]
        bits += sums[1:] - sums[:-1]
    return bits


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and bits_per_byte (null where undetermined) after them."""
    added = {"lang_pred": StringType(), "score": DoubleType(), "bits_per_byte": DoubleType()}
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = StructType(kept + [StructField(n, t) for n, t in added.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    at = [f.name for f in kept].index(text_col)

    def work(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            names, scores, rates = [], [], []
            for part in slices(texts, 1 << 20):
                n = part.last - part.first
                letters = [any(map(str.isalpha, t or "")) for t in texts.slice(part.first, n).to_pylist()]
                if not model.languages:
                    letters = [False] * n
                bits = code_lengths(model, part.data, part.offsets) if any(letters) else np.zeros((n, 1))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                rate = bits.min(axis=1) / np.maximum(np.diff(part.offsets), 1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(share, letters, strict=True)]
                rates += [float(r) if ok else None for r, ok in zip(rate, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                names=schema.names,
            )

    return docs.select(*[f.name for f in kept]).mapInArrow(work, schema)


def recognised(scored: DataFrame, text_col: str = "text", lang_col: str = "lang", margin: float = 1.25, least: int = 100) -> Column:
    """Whether a row of ``predict`` is text of a learned language: it has letters, and its code is not far longer than usual.

    Usual is the most bits a byte of any row whose language was predicted as labelled, among texts of about the same size
    (powers of two), so that no such row is ever rejected; beyond ``margin`` times that a text is. Sizes with fewer than
    ``least`` such rows have no bound. The bounds, one a size, are worked out here; ``scored`` should be stored.
    """
    size = F.floor(F.log2(F.octet_length(text_col) + 1)).cast("int")
    agreed = scored.filter(F.col("lang_pred") == F.col(lang_col))
    usual = agreed.groupBy(size.alias("size")).agg(F.max("bits_per_byte").alias("usual"), F.count("*").alias("n"))
    bounds = [x for r in usual.collect() if r.n >= least for x in (F.lit(r["size"]), F.lit(r.usual * margin))]
    known = F.col("lang_pred") != UNKNOWN
    if not bounds:
        return known
    return known & F.coalesce(F.col("bits_per_byte") <= F.create_map(*bounds)[size], F.lit(True))
