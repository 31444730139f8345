"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: sources share ``share`` times all words by weight; a target stops at ``most`` times its source's words and
   the excess is shared again by weight, by rounds of sums over the table of sources, until none is above.
2. Schedule: slot i lies at the point frac(i * golden ratio), in exact integer arithmetic; the source whose interval of
   the cumulative weights holds the point gets the slot. Intervals are widened by a few slots, as many as the
   discrepancy of the sequence can take away, so that each source surely gets its blocks; surplus slots stay empty.
3. The slots of a source are ranked in order, and the r-th takes the r-th block of the source's shuffled word stream,
   which runs through the source's documents again after its end. The last block ends at the target.

Null text has size 0; null is a source of its own, sorted last. Rows repeated with one id are taken as rows of their
own. Sources without words have target 0. An empty table gives an empty mix. The order of documents depends on ids and
the seed only, so reruns agree. Columns other than id, text and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 40  # resolution of the points
_STEP = round(2**_BITS * (math.sqrt(5) - 1) / 2) | 1  # golden ratio, odd: a permutation of all points
_CELLS = 12  # bits of the cells that slots and intervals meet in
_RANK_BLOCK = 1 << 16  # slots ranked in one task
_SHUFFLE_BITS = 10  # parts of a source's shuffled stream


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size in words and a shuffle key for every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rank, weight, source_size and target; sources may be many, only sums reach the driver."""
    spark = sized.sparkSession
    totals = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = totals.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id())
    ordered = saved(ordered.withColumn("part", F.shiftright("place", 33)), "sources-sorted")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = counts.select("part", "least", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    state = ordered.join(before, "part").select(
        "source", "source_size", (F.col("before") + F.col("place") - F.col("least")).alias("rank")
    )
    state = state.withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")))
    state = saved(state.withColumn("cap", F.col("source_size") * most).withColumn("target", F.lit(None).cast("double")), "targets")
    left = share * float(state.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        # One round: what is left, shared by weight among the open sources; those above their cap close at it.
        open_weight = state.filter("target is null").agg(F.sum("weight")).first()[0]
        if not open_weight:
            return state.drop("cap")
        offer = F.col("weight") * F.lit(left) / F.lit(open_weight)
        closing = state.filter("target is null").filter(offer >= F.col("cap"))
        used, n = closing.agg(F.sum("cap"), F.count("*")).first()
        if not n:
            return state.withColumn("target", F.coalesce("target", offer)).drop("cap")
        closed = F.col("target").isNull() & (offer >= F.col("cap"))
        state = saved(state.withColumn("target", F.when(closed, F.col("cap")).otherwise(F.col("target"))), "targets")
        left -= used


def point(i: Column) -> Column:
    """frac(i * golden ratio) as an integer below 2**40; the product is taken in two halves so that none overflows."""
    half = 1 << (_BITS // 2)
    low, high = _STEP % half, _STEP // half
    return ((i % (1 << _BITS)) * low + ((i % half) * high % half) * half) % (1 << _BITS)


def schedule(goal: DataFrame, block_words: int = 256) -> DataFrame:
    """slot, source (as its rank among the sources) and turn, one row per block of the mix, in the order of the slots.

    ``goal`` has rank and words (the whole number of words to take).
    """
    spark = goal.sparkSession
    need = goal.filter("words > 0").withColumn("blocks", F.ceil(F.col("words") / block_words).cast("bigint"))
    blocks, sources = need.agg(F.sum("blocks"), F.count("*")).first()
    if not sources:
        return spark.createDataFrame([], "slot bigint, rank bigint, turn bigint, words bigint")
    # A prefix of the sequence misses an interval's share by less than this many slots.
    slack = 4 + math.ceil(math.log2(blocks + sources + 1))
    slots = blocks + sources * slack
    wide = need.withColumn("wide", F.col("blocks") + slack)
    # Cumulative widths by rank: sums of parts of the ranks, then inside each part.
    part = F.shiftright("rank", 12)
    parts = wide.groupBy(part.alias("part")).agg(F.sum("wide").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumn("part", part).join(parts, "part").withColumn("upto", F.col("base") + F.sum("wide").over(inside))
    scale = float(1 << _BITS) / slots
    edge = lambda c: F.floor(c * F.lit(scale)).cast("bigint")
    intervals = wide.select(
        "rank", "blocks", "words", edge(F.col("upto") - F.col("wide")).alias("low"),
        F.when(F.col("upto") == slots, F.lit(1 << _BITS)).otherwise(edge(F.col("upto"))).alias("high"),
    )
    shift = _BITS - _CELLS
    cells = intervals.withColumn(
        "cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift)))
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("at"))
    points = points.withColumn("cell", F.shiftright("at", shift))
    dealt = points.join(cells, "cell").filter("at >= low and at < high")
    dealt = dealt.select("slot", "rank", "blocks", F.col("words").alias("goal"), F.floor(F.col("slot") / _RANK_BLOCK).alias("run"))
    # Rank per source: counts of earlier runs of slots, then the place inside the run.
    counts = dealt.groupBy("rank", "run").agg(F.count("*").alias("n"))
    earlier = counts.select(
        "rank", "run", (F.sum("n").over(Window.partitionBy("rank").orderBy("run")) - F.col("n")).alias("earlier")
    )
    place = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("place", place).join(earlier, ["rank", "run"])
    ranked = ranked.withColumn("turn", (F.col("earlier") + F.col("place")).cast("bigint")).filter("turn < blocks")
    words = F.least(F.lit(block_words).cast("bigint"), F.col("goal") - F.col("turn") * block_words)
    return ranked.select("slot", "rank", "turn", words.alias("words"))


def streams(sized: DataFrame, goal: DataFrame, seed: int = 7) -> DataFrame:
    """Every row with words and its place in its source's shuffled stream: row columns, rank, source_size, start."""
    join_on = sized["source"].eqNullSafe(goal["source"])
    rows = sized.join(goal.select("source", "rank", "source_size", "target", "words"), join_on, "left").drop(goal["source"])
    key = F.xxhash64(F.lit(seed), F.col("id"))
    rows = rows.withColumn("key", key).withColumn("part", F.shiftrightunsigned("key", 64 - _SHUFFLE_BITS))
    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("all"))
    parts = parts.select(
        "rank", "part", (F.sum("all").over(Window.partitionBy("rank").orderBy("part")) - F.col("all")).alias("base")
    )
    upto = F.sum("size").over(Window.partitionBy("rank", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(parts, ["rank", "part"])
    return rows.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("upto", "base", "part", "key")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_words: int = 256, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): every row with its source's size and target and a row number, and the mix itself as
    slot, row, first word and number of words, one row per document and block."""
    sized = saved(sizes(docs, id_col, text_col, source_col), "sizes")
    goal = saved(targets(sized, weights, share, most).withColumn("words", F.round("target").cast("bigint")), "targets")
    rows = saved(streams(sized, goal, seed).withColumn("row", F.monotonically_increasing_id()), "streams")
    epochs = F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))
    spans = (
        rows.filter("size > 0").withColumn("epoch", F.explode(epochs))
        .withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).filter(F.col("from") < F.col("words"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
        .withColumn("turn", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))))
        .select("row", "rank", "turn", "from", "to")
    )
    slots = schedule(goal, block_words)
    low, high = F.col("turn") * block_words, F.col("turn") * block_words + F.col("words")
    # Both sides have a row per block of the mix. The planner takes spans for as large as the stored file of ``rows``, packed and
    # before the explodes, and would send all of them through the driver: they are dealt out whatever it reckons.
    pieces = slots.join(spans.hint("merge"), ["rank", "turn"]).select(
        "slot", "row", (F.greatest("from", low) - F.col("from")).alias("first"),
        (F.least("to", high) - F.greatest("from", low)).alias("words"),
    )
    return rows, pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words in the mix) of every row."""
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )
