"""Removal of repeated passages, by column-wise construction of a transform with common prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a row with a smaller id, or earlier in
the same row. All strings are judged on the input.

1. Anchors: of each string the leftmost ``GRAM``-byte run with the least hash. Equal strings have equal anchors at equal
   offsets, so only strings around equal anchors need comparing. Anchors are counted; only those that occur twice or
   more go on, held in a filter of fixed size whose false hits cost work only.
2. Segments, the bytes of all strings that have such an anchor, are sent packed to the bucket of the anchor; copies
   within a batch shrink to the first. An anchor with more than ``MOST`` occurrences sends single strings by their own hash.
3. A task takes its segments as a collection of short texts, aligned at their anchors, and builds the transform from
   the last column to the first: each round inserts one symbol of each text, sorts the texts by (symbol, order so far)
   and updates the lengths of the common prefixes of neighbours. Neighbours with ``LENGTH`` common bytes hold equal
   strings; all but the earliest are marked.
4. Marked strings return to their documents as intervals of starts; the covered bytes are cut.

Rounds cost time in proportion to the texts, not to the transform so far: only suffixes that begin in one column can
hold equal strings, so columns are kept apart, and a column is dropped when the next one is done.

Null text is empty. Rows with null ids come last. Rows that share an id are ordered by a hash of their texts; of rows
with equal id and text, all but one count as repeated. Ids are integers. An empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import saved
from .text import _VALUE, flat, mixed, powers, slices

LENGTH, GRAM = 100, 20
REACH = LENGTH - GRAM  # an anchor lies at most so many bytes into its string
WIDTH = REACH + LENGTH
PIECE = 1 << 20
MOST = 200_000
BATCH = 1 << 15  # segments in one collection, more only for one anchor
FLUSH = 1 << 15  # segments that are packed together,
FLUSH_BYTES = 6 << 20  # and their bytes
STEP = 1 << 14  # single strings of frequent anchors that are cut out at a time
BUCKET = 150_000  # segments, before copies shrink, that are sent to one task
_FILTER_BITS = 27
_LAST = np.iinfo(np.int64).max


# --- anchors --------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash and position of each anchor, and the first and last start of the strings inside rows that have it."""
    for a in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        piece = data[a : a + PIECE + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * up[: len(piece)], out=total[1:])
        grams = len(piece) - GRAM + 1
        h = mixed((total[GRAM:] - total[:-GRAM]) * down[:grams])
        # The least of each window of REACH + 1 grams: the hash in front, the place behind, so that the leftmost wins.
        least = (h & ~np.uint64(2**21 - 1)) | np.arange(grams, dtype=np.uint64)
        size = 1
        while size * 2 <= REACH + 1:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[REACH + 1 - size :][:n])
        place = (least & np.uint64(2**21 - 1)).astype(np.int64)
        # Strings that begin less than LENGTH bytes before the end of their row reach into the next one.
        starts = np.arange(a, a + n)
        row_end = offsets[np.searchsorted(offsets, starts, "right")]
        inside = starts + LENGTH <= row_end
        place, starts = place[inside], starts[inside]
        if len(place):
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            tails = np.append(heads[1:], len(place)) - 1
            yield h[place[heads]], place[heads] + a, starts[heads], starts[tails]


class Filter:
    """A bitmap of fixed size over hashes."""

    def __init__(self, hashes: DataFrame):
        marks = hashes.select(F.shiftrightunsigned("h", 64 - _FILTER_BITS).alias("slot"))
        marks = marks.selectExpr("slot >> 6 AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
        marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
        self.bits[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - _FILTER_BITS)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def anchor_counts(texts: DataFrame) -> DataFrame:
    """h and n, the number of anchors with that hash."""

    def work(batches):
        for batch in batches:
            found = [h for part in slices(batch.column(0)) for h, *_ in anchors(part.data, part.offsets)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


# --- segments -------------------------------------------------------------------------


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    n = int(size.sum())
    kind = np.int32 if max(n, len(data)) < 2**31 else np.int64  # half the memory where it is enough
    at = np.repeat((begin - np.cumsum(size) + size).astype(kind), size)
    at += np.arange(n, dtype=kind)
    return data[at]


def in_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the keys, without rows whose keys all repeat: the same segment of rows with equal id and text."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order[new]


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each range."""
    at = np.arange(int(size.sum()), dtype=np.int32)
    at -= np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    return at


def running(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums, from the first byte on, of hashes of each byte and its place in its segment (``edge`` has where these begin)."""
    total = np.zeros(len(data) + 1, np.uint64)
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        place = np.arange(a, b)
        place -= edge[np.searchsorted(edge, place, "right") - 1]
        np.cumsum(mixed(_VALUE[data[a:b]] + place.astype(np.uint64)), out=total[a + 1 : b + 1])
        total[a + 1 : b + 1] += total[a]
    return total


_KINDS = (("at", np.uint64), ("left", np.uint8), ("size", np.uint8), ("doc", np.int64), ("tie", np.int64), ("pos", np.int64))


def pack(columns: list[np.ndarray], data: np.ndarray) -> bytes:
    raw = b"".join([np.int64(len(columns[0])).tobytes(), *(c.astype(t).tobytes() for c, (_, t) in zip(columns, _KINDS, strict=True)), data.tobytes()])
    return zstandard.compress(raw, 3)


def unpack(payload: bytes) -> list[np.ndarray]:
    """at, left, size, doc, tie, pos as 64-bit numbers, and the bytes."""
    raw = zstandard.decompress(payload)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _, t in _KINDS:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n, at).astype(np.uint64 if t is np.uint64 else np.int64))
        at += size
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def segments(keyed: DataFrame, repeated, frequent, buckets: int) -> DataFrame:
    """Rows of two kinds, from rows (doc, tie, text): packed segments of a bucket of anchors, and, for copies inside a
    batch, intervals of marked starts (doc, tie, first, last)."""
    schema = "bucket bigint, payload binary, doc bigint, tie bigint, first bigint, last bigint"
    names = ["bucket", "payload", "doc", "tie", "first", "last"]

    def work(batches):
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held = []
            for part in slices(batch.column(2)):
                for piece in cut(part):
                    held.append(piece)
                    if sum(len(x[0]) for x in held) >= FLUSH or sum(len(x[3]) for x in held) >= FLUSH_BYTES:
                        yield from sent(held, doc, tie)
                        held = []
            if held:
                yield from sent(held, doc, tie)

    def cut(part):
        """Segments of a slice of rows, a bounded number of bytes at a time."""
        for h, pos, first, last in anchors(part.data, part.offsets):
            keep = repeated.value.has(h)
            h, pos, first, last = (x[keep] for x in (h, pos, first, last))
            many = frequent.value.has(h)
            if many.any():
                yield from single(part, first[many], last[many])
                h, pos, first, last = (x[~many] for x in (h, pos, first, last))
            for a in range(0, len(h), STEP):
                yield cut_out(part, *(x[a : a + STEP] for x in (h, pos, first, last)))

    def single(part, first, last):
        """Single strings, by their own hash."""
        up, down = powers(len(part.data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[part.data] * up[: len(part.data)])])
        upto = np.cumsum(last - first + 1)
        for a in range(0, int(upto[-1]), STEP):
            # The a-th string and those after it: which range each is of, and its place there.
            k = np.arange(a, min(a + STEP, int(upto[-1])))
            of = np.searchsorted(upto, k, "right")
            start = last[of] - (upto[of] - 1 - k)
            own = mixed((total[start + LENGTH] - total[start]) * down[start] + np.uint64(LENGTH))
            yield cut_out(part, own, start, start, start)

    def cut_out(part, h, pos, first, last):
        row = np.searchsorted(part.offsets, pos, "right") - 1
        size = last - first + LENGTH
        return h, pos - first, size, gathered(part.data, first, size), row + part.first, pos - part.offsets[row]

    def sent(held, doc, tie):
        at, left, size, data, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(at):
            return
        order = in_order(doc[row], tie[row], pos, left)
        edge = (np.cumsum(size) - size)[order]
        at, left, size, row, pos = (x[order] for x in (at, left, size, row, pos))
        data = gathered(data, edge, size)
        edge = np.cumsum(size) - size
        # Copies of a segment: same anchor, same place of it, same bytes. The first in order stands for them.
        total = running(data, edge)
        name = mixed(total[edge + size] - total[edge]) ^ mixed(at + left.astype(np.uint64) * np.uint64(512) + size.astype(np.uint64))
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        chief = first[which]
        copy = (chief != np.arange(len(at))) & (size[chief] == size) & (left[chief] == left) & (at[chief] == at)
        c = np.flatnonzero(copy)
        if len(c):
            same = gathered(data, edge[c], size[c]) == gathered(data, edge[chief[c]], size[c])
            copy[c] = np.logical_and.reduceat(same, np.cumsum(size[c]) - size[c])
        bucket = (at % np.uint64(buckets)).astype(np.int64)
        keep = np.flatnonzero(~copy)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[keep][1:] != bucket[keep][:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = keep[a:b]
            packed = pack([at[k], left[k], size[k], doc[row[k]], tie[row[k]], pos[k]], gathered(data, edge[k], size[k]))
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([bucket[k[0]]]), pa.array([packed], pa.binary()), none, none, none, none], names=names)
        c = np.flatnonzero(copy)
        begin = pos[c] - left[c]
        for r, a, b in merged(row[c], begin, begin + size[c] - LENGTH):
            yield pa.RecordBatch.from_arrays(
                [pa.array(mixed(doc[r].astype(np.uint64)).view(np.int64) % buckets), pa.nulls(len(r), pa.binary()),
                 pa.array(doc[r]), pa.array(tie[r]), pa.array(a), pa.array(b)],
                names=names,
            )

    return keyed.select("doc", "tie", "text").mapInArrow(work, schema)


def merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals of starts, joined where they touch in one row; nothing if there is none."""
    if not len(row):
        return
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    big = int(last.max()) + 2
    reach = np.maximum.accumulate(last + row * big)  # a row's values lie above those of the rows before
    new = np.concatenate([[True], first[1:] + row[1:] * big > reach[:-1] + 1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(row)) - 1
    yield row[heads], first[heads], reach[ends] - row[heads] * big


# --- transform ------------------------------------------------------------------------


def repeated_windows(columns: np.ndarray) -> np.ndarray:
    """Which strings repeat an earlier text's: (text, offset) over texts in order of precedence.

    ``columns`` has a row per column and a text per column entry: symbol + 1, or 0 where the text has none.
    """
    width, m = columns.shape
    marked = np.zeros((m, width - LENGTH + 1), bool)
    order = np.arange(m)
    common = np.zeros(m, np.uint8)  # with the neighbour before, in the order of the column done last
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]
        moved = np.argsort(symbol, kind="stable")
        symbol = symbol[moved]
        # Least common prefix between neighbours of one symbol, over the texts that stood between them.
        low, high = moved[:-1] + 1, moved[1:]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
        fresh = np.zeros(m, np.uint8)
        if len(same):
            fresh[same + 1] = np.minimum(range_least(common, low[same], high[same]) + 1, LENGTH)
        order, common = order[moved], fresh
        if c <= width - LENGTH:
            equal = common >= LENGTH
            if equal.any():
                heads = np.flatnonzero(~equal)
                first = np.minimum.reduceat(order, heads)
                owner = np.repeat(first, np.diff(np.append(heads, m)))
                marked[order, c] = owner != order
    return marked


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low .. high], both inclusive, for many ranges."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(level.max())):
        above = table[-1].copy()
        above[: len(above) - (1 << k)] = np.minimum(table[-1][: len(above) - (1 << k)], table[-1][1 << k :])
        table.append(above)
    table = np.stack(table)
    return np.minimum(table[level, low], table[level, high + 1 - (1 << level)]).astype(np.int64)


def marked_intervals(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc, tie, first, last): starts of strings that also start earlier."""

    def work(batches):
        now, held = None, []
        for batch in batches:
            is_mark = np.asarray(batch.column(1).is_null())
            if is_mark.any():
                yield batch.filter(pa.array(is_mark)).select(["doc", "tie", "first", "last"])
                batch = batch.filter(pa.array(~is_mark))
            for r in range(batch.num_rows):
                bucket = batch.column(0)[r].as_py()
                if bucket != now and held:
                    yield from bucket_marks(held)
                    held = []
                now = bucket
                held.append(unpack(batch.column(1)[r].as_py()))
        if held:
            yield from bucket_marks(held)

    def bucket_marks(held):
        """Collections of a bucket: whole anchors, together about BATCH segments."""
        at, left, size, doc, tie, pos, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        edge = np.cumsum(size) - size
        order = in_order(at.view(np.int64), doc, tie, pos, left)
        heads = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        # An anchor with one segment repeats nothing.
        alone = np.diff(np.append(heads, len(order))) == 1
        order = np.delete(order, heads[alone])
        heads = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]])) if len(order) else order
        first = 0
        while first < len(order):
            k = int(np.searchsorted(heads, first + BATCH, "right"))
            last = len(order) if k >= len(heads) and len(order) - first <= BATCH else int(heads[k - 1])
            if last <= first:
                last = int(heads[k]) if k < len(heads) else len(order)
            part = order[first:last]
            part = part[np.lexsort((pos[part], tie[part], doc[part]))]
            yield from judged(left[part], size[part], doc[part], tie[part], pos[part], gathered(data, edge[part], size[part]))
            first = last

    def judged(left, size, doc, tie, pos, data):
        columns = np.zeros((WIDTH, len(doc)), np.uint16)
        text = np.repeat(np.arange(len(doc), dtype=np.int32), size)
        columns[within(size) + np.repeat((REACH - left).astype(np.int32), size), text] = data.astype(np.uint16) + 1
        text, column = np.nonzero(repeated_windows(columns))
        start = pos[text] - REACH + column
        for t, a, b in merged(text, start, start):
            yield pa.RecordBatch.from_arrays([pa.array(doc[t]), pa.array(tie[t]), pa.array(a), pa.array(b)], names=["doc", "tie", "first", "last"])

    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "doc bigint, tie bigint, first bigint, last bigint")


# --- cutting --------------------------------------------------------------------------


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    context = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_LAST))).alias("doc"), F.xxhash64(text).alias("tie"),
        F.col(id_col).isNull().alias("unnamed"), text.alias("text"),
    )
    counted = saved(anchor_counts(keyed.select("text")).filter("n > 1"), "anchors")
    repeated = context.broadcast(Filter(counted.select("h")))
    frequent = context.broadcast(Filter(counted.filter(F.col("n") > most).select("h")))
    buckets = max(1, (counted.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    marks = marked_intervals(segments(keyed, repeated, frequent, buckets), buckets)
    spans = saved(marks.groupBy("doc", "tie").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "repeats")

    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            spans, at = batch.column(3), batch.column(3).offsets.to_numpy()
            first, last = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            known = np.asarray(spans.is_valid())
            removed, runs, digests, kept = [], [], [], []
            for r in range(batch.num_rows):
                body = data[offsets[r] : offsets[r + 1]]
                gone, n = np.zeros(len(body) + 1, np.int32), 0
                if known[r]:
                    np.add.at(gone, first[at[r] : at[r + 1]], 1)
                    np.add.at(gone, last[at[r] : at[r + 1]] + LENGTH, -1)
                    cut = np.cumsum(gone)[:-1] > 0
                    n = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                    rest = body[~cut].tobytes()
                else:
                    rest = body.tobytes()
                removed.append(len(body) - len(rest))
                runs.append(n)
                kept.append(rest)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["doc", "unnamed", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # Rows with equal id and text meet here: the first is cut like any other, the rest repeat it in full.
    rows = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("doc", "tie").orderBy("doc")))
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), (F.octet_length("text") - LENGTH).cast("bigint").alias("last")))
    whole = F.when((F.col("copy") > 1) & (F.octet_length("text") >= LENGTH), everything)
    cut = rows.join(spans, ["doc", "tie"], "left").select("doc", "unnamed", "text", F.coalesce(whole, "spans").alias("spans"))
    cut = cut.mapInArrow(work, "doc bigint, unnamed boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return cut.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
