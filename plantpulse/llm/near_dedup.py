"""Near-duplicate documents by a chosen-path set similarity join.

1. A document's set holds its distinct runs of five words. Each set is sketched by ``COORDINATES`` minwise tokens;
   documents with equal sets form one class, and only classes are joined.
2. Trees: at a node, a document branches by one of its minwise tokens, which the node chooses, and now and then by a
   second, so that a pair at the threshold shares one child on average. Nodes of at most ``SMALL`` classes are compared
   exhaustively by sketch. A larger node compares a pivot with all its members and branches again without the pivot.
   Where the members agree with the pivot so much that branching would not part them, and after the last level, the
   node is a crowd. ``TREES`` independent trees give the recall.
3. Pairs whose sketches agree enough are confirmed on their full sets: first one partner for each class, then every
   pair whose ends are not connected yet. Pairs left out join classes that are already in one component.
4. In a crowd, all members that are not connected yet are compared on their full sets, part by part; of what is linked
   in two parts, only a spanning forest is handed on.
5. Components of the confirmed links; of each the smallest id stays.

A text with fewer than five words is one run of all its words. Null text or text without words has an empty set, is
linked with nothing and kept. Null ids never name a component that has another id. Rows repeated with one id get equal
results. An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import saved
from .text import LOWER, NOT_BLANK, hashes, mixed, runs, slices, words

RUN = 5
COORDINATES = 64
# With independent coordinates a pair at the threshold stays together for all levels of one of the trees with chance
# 0.995 (80 percent) or 0.998 (85 percent); above SMALL a node is never cut, so SMALL does not bear on recall.
TREES = 10
LEVELS = 8
SMALL = 32
CLOSE = 0.7  # of the threshold: mean agreement with the pivot from which a node is a crowd
PART, PART_SHINGLES = 512, 1 << 19  # members of a crowd compared together, and shingles of these
_RANDOM = np.random.default_rng(20240609)
_XOR = _RANDOM.integers(0, 2**64 - 1, COORDINATES, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**64 - 1, COORDINATES, dtype=np.uint64) | np.uint64(1)
_FILTER_BITS = 26  # of the fixed-size filter of wanted sets


# --- sets and sketches ----------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (48 bits) of every row, ascending inside a row, and where each row's begin (and the total)."""
    lower = LOWER[data]
    starts, ends, first = words(lower, offsets, NOT_BLANK)
    h = hashes(lower, starts, ends)
    n = np.diff(first)
    out = runs(h, RUN)
    row = np.repeat(np.arange(len(n)), n)
    full = row[: len(out)] == row[RUN - 1 :]
    out, row = out[full], row[: len(full)][full]
    short = np.flatnonzero((n > 0) & (n < RUN))
    if len(short):
        whole = [mixed(np.uint64(n[r]) + runs(h[first[r] : first[r + 1]], int(n[r]))) for r in short]
        out, row = np.concatenate([out, *whole]), np.concatenate([row, short])
    # One sort for all rows: 16 bits of row, 48 bits of hash.
    packed = np.sort((row.astype(np.uint64) << np.uint64(48)) | (out >> np.uint64(16)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    edges = np.searchsorted(packed, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(48))
    return packed & np.uint64(2**48 - 1), edges


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the whole set), n_shingles and sketch of every row; key and sketch are null for empty sets."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key bigint, n_shingles bigint, sketch binary"

    def work(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                values, edges = shingles(part.data, part.offsets)
                n = np.diff(edges)
                full = np.flatnonzero(n)
                keys = np.zeros(len(n), np.uint64)
                cells = np.zeros((COORDINATES, len(full)), np.uint32)
                if len(full):
                    heads = edges[:-1][full]
                    keys[full] = set_keys(values, heads, n[full])
                    spread = mixed(values)
                    for c in range(COORDINATES):
                        cells[c] = np.minimum.reduceat((spread ^ _XOR[c]) * _ODD[c], heads) >> np.uint64(32)
                cells = np.ascontiguousarray(cells.T)
                sketches = [None] * len(n)
                for k, r in enumerate(full):
                    sketches[r] = cells[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.last - part.first), pa.array(keys.view(np.int64), mask=n == 0),
                     pa.array(n.astype(np.int64)), pa.array(sketches, pa.binary())],
                    names=["id", "key", "n_shingles", "sketch"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def set_keys(values: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed(np.add.reduceat(mixed(values ^ np.uint64(0x5BD1E995)), heads) + n.astype(np.uint64))


# --- trees ----------------------------------------------------------------------------


def children(at: np.ndarray, level: int, tree: np.ndarray | None, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, child node) of the members at their nodes; ``tree`` is given at the roots."""
    if tree is not None:
        one, two = tree % COORDINATES, (tree + TREES) % COORDINATES
    else:
        one = (mixed(at ^ np.uint64(1)) % np.uint64(COORDINATES)).astype(int)
        two = (mixed(at ^ np.uint64(2)) % np.uint64(COORDINATES)).astype(int)
    coin = mixed(at ^ np.uint64(3)) / 2.0**64
    again = np.flatnonzero((coin < 1 / threshold - 1) & (one != two))
    member = np.concatenate([np.arange(len(at)), again])
    place = np.concatenate([one, two[again]])
    token = sketch[member, place].astype(np.uint64)
    return member, mixed(mixed(at[member] + np.uint64(level)) ^ mixed(token << np.uint64(8) | place.astype(np.uint64)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches of a batch as rows."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, COORDINATES), np.uint32)
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint32, COORDINATES * len(column), int(start)).reshape(len(column), -1)


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def grow(members: DataFrame, threshold: float) -> DataFrame:
    """(key, at) below the roots of all trees, of members (key, sketch)."""

    def work(batches):
        for batch in batches:
            keys, sketch = _ints(batch.column(0)), _matrix(batch.column(1))
            for t in range(TREES):
                at = mixed(np.full(len(keys), t + 1, np.uint64))
                member, child = children(at, 0, np.full(len(keys), t), sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys[member]), pa.array(child.view(np.int64))], names=["key", "at"])

    return members.select("key", "sketch").mapInArrow(work, "key bigint, at bigint")


def least_agreement(threshold: float) -> int:
    """Sketch coordinates that must agree: four standard deviations below the threshold."""
    return math.floor(COORDINATES * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)))


def met_pivots(rows: DataFrame, level: int, threshold: float) -> DataFrame:
    """(key, at, pivot, agree, one, two) of rows (key, at, sketch, pivot, sp): how many coordinates agree with the pivot's, and
    the children the member has at ``level`` (``two`` is null where it has one), so that no sketch is looked up for them."""

    def work(batches):
        for batch in batches:
            sketch = _matrix(batch.column(2))
            agree = (sketch == _matrix(batch.column(4))).sum(axis=1)
            member, child = children(_ints(batch.column(1)).view(np.uint64), level, None, sketch, threshold)
            n = len(agree)  # every member comes once, then some a second time
            two, alone = np.zeros(n, np.int64), np.ones(n, bool)
            two[member[n:]], alone[member[n:]] = child[n:].view(np.int64), False
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (0, 1, 3)), pa.array(agree.astype(np.int32)), pa.array(child[:n].view(np.int64)), pa.array(two, mask=alone)],
                names=["key", "at", "pivot", "agree", "one", "two"],
            )

    schema = "key bigint, at bigint, pivot bigint, agree int, one bigint, two bigint"
    return rows.select("key", "at", "sketch", "pivot", "sp").mapInArrow(work, schema)


def exhaustive_pairs(rows: DataFrame, least: int) -> DataFrame:
    """(a, b) for all members of the same small node (at) whose sketches agree in ``least`` coordinates."""

    def compare(at, key, sketch):
        for k in range(1, len(at)):
            i = np.flatnonzero(at[k:] == at[:-k])
            if not len(i):
                return
            for j in range(0, len(i), 1 << 15):
                p = i[j : j + (1 << 15)]
                p = p[(sketch[p] == sketch[p + k]).sum(axis=1) >= least]
                a, b = key[p], key[p + k]
                keep = a != b
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    def work(batches):
        at, key, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint32)
        for batch in batches:
            at = np.concatenate([at, _ints(batch.column(0))])
            key = np.concatenate([key, _ints(batch.column(1))])
            sketch = np.concatenate([sketch, _matrix(batch.column(2))])
            if not len(at):
                continue
            whole = int(np.searchsorted(at, at[-1]))  # the last node may go on in the next batch
            yield from compare(at[:whole], key[:whole], sketch[:whole])
            at, key, sketch = at[whole:], key[whole:], sketch[whole:]
        yield from compare(at, key, sketch)

    return rows.select("at", "key", "sketch").repartition("at").sortWithinPartitions("at").mapInArrow(work, "a bigint, b bigint")


def candidates(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of classes (key, sketch) that meet in a tree and whose sketches agree enough, and the
    members (key, at) of crowds."""
    least = least_agreement(threshold)
    sketches = classes.select("key", "sketch")
    pivot_sketches = sketches.withColumnsRenamed({"key": "pivot", "sketch": "sp"})
    grown, small, found, crowds = grow(sketches, threshold), [], [], []
    for level in range(LEVELS):
        rows = saved(grown, "tree-rows")
        pivot = F.min(F.struct(F.xxhash64("key", "at").alias("h"), "key"))["key"].alias("pivot")
        nodes = saved(rows.groupBy("at").agg(F.count("*").alias("n"), pivot).filter("n > 1"), "tree-nodes")
        small.append(rows.join(nodes.filter(F.col("n") <= SMALL).select("at"), "at").select("key", "at"))
        # The pivots' sketches are found for the nodes, of which there are few, and not for their members.
        large = saved(nodes.filter(F.col("n") > SMALL).join(pivot_sketches, "pivot").select("at", "pivot", "sp"), "large-nodes")
        if large.isEmpty():
            break
        # Narrow rows first: where they are few, Spark sends them to the sketches instead of dealing all sketches by key again.
        held = saved(rows.join(large.select("at"), "at", "left_semi").select("key", "at"), "held")
        met = saved(met_pivots(held.join(sketches, "key").join(large, "at"), level + 1, threshold), "pivots")
        pairs = met.filter((F.col("agree") >= least) & (F.col("key") != F.col("pivot")))
        found.append(pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")))
        going = met.filter(F.col("key") != F.col("pivot"))  # the pivot has met all members
        # A level takes the pairs of a node times its mean agreement over the threshold, and its rows times up to 1 / threshold.
        bound = CLOSE * threshold * COORDINATES if level < LEVELS - 1 else 0
        crowded = saved(met.groupBy("at").agg(F.avg("agree").alias("mean")).filter(F.col("mean") >= bound).select("at"), "crowded")
        crowds.append(going.join(crowded, "at", "left_semi").select("key", "at"))
        on = going.join(crowded, "at", "left_anti")
        grown = on.select("key", F.explode(F.filter(F.array("one", "two"), lambda x: x.isNotNull())).alias("at"))
    out = exhaustive_pairs(reduce(DataFrame.unionAll, small).join(sketches, "key"), least)
    pairs = saved(reduce(DataFrame.unionAll, found, out).distinct(), "candidates")
    return pairs, saved(reduce(DataFrame.unionAll, crowds, rows.select("key", "at").limit(0)), "crowds")


# --- confirmation ---------------------------------------------------------------------


def wanted_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, shingles) for the classes in ``wanted`` (key, id), read from one text of each.

    A filter of fixed size keeps the sets of other texts from being shuffled; what it lets through is removed by a join.
    """
    spark = docs.sparkSession
    slot = F.shiftrightunsigned(F.xxhash64("key", "id"), 64 - _FILTER_BITS)
    marks = wanted.select(slot.alias("slot")).selectExpr("slot >> 6 AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    bits[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key bigint, shingles binary"

    def sets(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                values, edges = shingles(part.data, part.offsets)
                n = np.diff(edges)
                keys = np.zeros(len(n), np.uint64)
                full = n > 0
                if full.any():
                    keys[full] = set_keys(values, edges[:-1][full], n[full])
                listed = [values[edges[r] : edges[r + 1]].tobytes() if n[r] else None for r in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.last - part.first), pa.array(keys.view(np.int64), mask=~full), pa.array(listed, pa.binary())],
                    names=["id", "key", "shingles"],
                )

    def sift(batches):
        bits = shared.value
        for batch in batches:
            slot = _ints(batch.column(3))
            ok = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["id", "key", "shingles"]).filter(pa.array(ok))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sets, schema)
    rows = rows.filter("key is not null").select("id", "key", "shingles", slot.alias("slot")).mapInArrow(sift, schema)
    same = rows["key"].eqNullSafe(wanted["key"]) & rows["id"].eqNullSafe(wanted["id"])
    return rows.join(wanted, same, "left_semi").select("key", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def work(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[r].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(work, "a bigint, b bigint")


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each of the sets ``a`` shares with each of the sets ``b``: products of incidence matrices."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    row, column = row[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)))
    for low in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[i:j], column[i:j] - low] = 1
        both += held[a] @ held[b].T
    return both


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, another) so that what ``linked`` connects stays connected; ``a`` and ``b`` name its rows and columns."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while (rows := linked.any(axis=1)).any():
        rows = np.arange(len(a)) == rows.argmax()
        while True:
            columns = linked[rows].any(axis=0)
            more = linked[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        ends = np.unique(np.concatenate([a[rows], b[columns]]))
        one.append(np.full(len(ends) - 1, ends[0]))
        two.append(ends[1:])
        linked[rows] = False
    return np.concatenate(one), np.concatenate(two)


def crowd_links(crowds: DataFrame, classes: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect what is linked in a crowd; ``roots`` are the components so far, inside which nothing is compared."""
    named = crowds.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    marks = named.groupBy("at").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    once = marks.filter("low <> high").groupBy("n", "x", "y").agg(F.min("at").alias("at")).select("at")  # equal crowds count once
    named = saved(named.join(once, "at").join(classes.select("key", "n_shingles"), "key"), "crowds")
    # A component with many members in a crowd has parts of its own, which are not compared with one another.
    count = [F.sum("n").alias("n"), F.sum("w").alias("w")]
    by = named.groupBy("at", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    by = saved(by.withColumn("own", F.when(F.col("n") >= PART, F.col("root"))), "crowd-components")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("w") / PART_SHINGLES)).cast("int")
    sides = saved(by.groupBy("at", "own").agg(*count).withColumn("parts", parts).drop("n", "w"), "crowd-sides")
    part = lambda k: F.xxhash64("own", k)
    placed = named.join(by.select("at", "root", "own"), ["at", "root"]).withColumnsRenamed({"at": "crowd", "own": "of"})
    placed = placed.join(sides, (F.col("crowd") == F.col("at")) & F.col("of").eqNullSafe(F.col("own")))
    placed = saved(placed.select("at", "key", "root", part(F.pmod(F.xxhash64("key", "at"), F.col("parts")).cast("int")).alias("part")), "crowd-parts")
    listed = sides.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("at", "own", part(F.col("k")).alias("part"))
    other = listed.withColumnsRenamed({"own": "own2", "part": "part2"})
    tiles = listed.join(other, "at").filter("part <= part2 and (own is null or own2 is null or own <> own2)")
    tiles = saved(tiles.select("at", "part", "part2", F.xxhash64("at", "part", "part2").alias("tile")), "crowd-tiles")
    ones = placed.join(tiles.select("at", "part", "tile"), ["at", "part"])
    twos = placed.join(tiles.filter("part <> part2").select("at", F.col("part2").alias("part"), "tile"), ["at", "part"])
    ones, twos = (x.select("tile", F.lit(k).alias("side"), "key", "root") for k, x in enumerate((ones, twos)))

    def compare(held):
        table = pa.Table.from_batches(held)
        side, key, root = (table.column(k).to_numpy() for k in (1, 2, 3))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(4)]
        n = np.array([len(x) for x in full])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b if len(b) else a
        both = intersections(full, a, b)
        linked = 100 * both >= percent * (n[a][:, None] + n[b] - both)
        linked &= root[a][:, None] != root[b]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(linked, key[a], key[b])], names=["a", "b"])

    def work(batches):
        held: list[pa.RecordBatch] = []  # of the tile at hand, which may go on in the next batch
        last = None
        for batch in batches:
            tile = _ints(batch.column(0))
            for i, j in pairwise([0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1), len(tile)]):
                if held and tile[i] != last:
                    yield compare(held)
                    held = []
                if i < j:
                    held.append(batch.slice(i, j - i))
                    last = tile[i]
        if held:
            yield compare(held)

    rows = ones.unionAll(twos).join(sets, "key").select("tile", "side", "key", "root", "shingles")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(work, "a bigint, b bigint")


def links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, crowds: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root): the components of the confirmed pairs and of the links in crowds."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionAll(crowds.select("key")).distinct()
    wanted = saved(classes.select("key", "id").join(ends, "key", "left_semi"), "wanted")
    sets = saved(wanted_sets(docs, wanted, id_col, text_col).dropDuplicates(["key"]), "sets")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    roots = components(confirmed(first, sets, percent))
    # The other pairs: those inside a component can change nothing.
    ra, rb = (roots.withColumnsRenamed({"node": x, "root": f"r{x}"}) for x in "ab")
    rest = pairs.join(first, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    rest = saved(rest.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), "other-pairs")
    if not rest.isEmpty():
        roots = components(_edges(roots).unionAll(confirmed(rest, sets, percent)))
    if not crowds.isEmpty():
        roots = components(_edges(roots).unionAll(crowd_links(crowds, classes, roots, sets, percent)))
    return roots


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = saved(sketched(docs, id_col, text_col), "sketches")
    whole = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("sketch").alias("sketch"), F.max("n_shingles").alias("n_shingles"))
    classes = saved(whole, "classes")
    pairs, crowds = candidates(classes, percent / 100)
    roots = saved(links(docs, classes, pairs, crowds, percent, id_col, text_col), "roots")
    names = classes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left")
    names = saved(names.withColumn("root", F.coalesce("root", "key")), "names")
    least = names.groupBy("root").agg(F.min("id").alias("component_id"))
    named = saved(names.join(least, "root").select("key", "component_id"), "components")
    empty = F.col("key").isNull()
    return (
        rows.select("id", "key", "n_shingles").join(named, "key", "left")
        .withColumn("component_id", F.when(empty, F.col("id")).otherwise(F.col("component_id")))
        .select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
