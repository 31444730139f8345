"""Merkle manifest of a dataset by slot pivots: a root over all rows, and for every row the siblings that prove it.

Every row is a leaf. The leaves of a group, in the order of their ids, are the bottom of the group's tree; while a level
has several nodes, every ``fanout`` consecutive ones (the last run may be shorter, even one) become the hash of their
concatenation. The remaining node is the group's subroot, and the subroots, by group, are the leaves of the last tree.

A level would cost a shuffle, so one shuffle serves as many levels as fit into ``COLUMNS`` slots: conditional aggregates
spread the nodes of a block into a column for each slot, levels are hashes of concatenated neighbouring columns, and the
top column is a node of the next round, a table ``COLUMNS`` times smaller. Proofs go down the same tables: a block joins the
path of its top (one row a block), then gives every slot its siblings, the columns of its run but its own. Places come from
a distributed rank, so a group that holds most rows is numbered, hashed and proved by many tasks, and no text is shuffled.

Null group is a group of its own, first in order. Rows with null ids come first in their group; rows that share an id are
ordered by their leaf, and equal rows are leaves each. Null fields are encoded as ``-``, so an empty text differs from a
null one. An empty table has an empty manifest. Other columns are not hashed; what is to travel along is named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .scratch import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = 16
#: The siblings of one level, those left and right of the own slot, as concatenated digests.
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the text of the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; null parts are absent."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    return digest(*[encoded(c) for c in fields])


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path in one text, level by level, left to right."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))))


def _levels(fanout: int) -> int:
    """Levels that one round of columns holds."""
    levels = 1
    while fanout ** (levels + 1) <= COLUMNS:
        levels += 1
    return levels


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per block of nodes (tree, idx, n, hash, more): its levels of hashes, and what its nodes carry."""
    steps = _levels(fanout)
    width = fanout**steps
    node = F.struct("hash", "more")
    slots = [F.max(F.when(F.col("idx") % width == s, node)).alias(f"slot{s}") for s in range(width)]
    wide = nodes.groupBy("tree", F.expr(f"idx div {width}").alias("idx")).agg(F.max("n").alias("n"), *slots)
    wide = wide.withColumns({f"h0_{s}": F.col(f"slot{s}.hash") for s in range(width)})
    for step in range(1, steps + 1):
        above = {}
        for parent in range(width // fanout**step):
            children = [F.col(f"h{step - 1}_{parent * fanout + k}") for k in range(fanout)]
            # A level above the single node left is that node; runs are filled from the left.
            many = F.col("n") > fanout ** (step - 1)
            above[f"h{step}_{parent}"] = F.when(children[0].isNotNull(), F.when(many, digest(*children)).otherwise(children[0]))
        wide = wide.withColumns(above)
    levels = [F.array(*[f"h{step}_{k}" for k in range(width // fanout**step)]).alias(f"level{step}") for step in range(steps + 1)]
    return wide.select("tree", "idx", "n", *levels, F.array(*[f"slot{s}.more" for s in range(width)]).alias("more"))


def grow(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The stored rounds of the trees in ``nodes`` (tree, idx from 0, n nodes of the tree, hash, more), from the leaves up."""
    width = fanout ** _levels(fanout)
    most, rounds = nodes.agg(F.max("n")).first()[0] or 0, []
    while not rounds or most > 1:
        rounds.append(saved(_pivot(nodes, fanout), "tree"))
        top = F.element_at(f"level{_levels(fanout)}", 1).alias("hash")
        nodes = rounds[-1].select("tree", "idx", F.expr(f"(n + {width - 1}) div {width}").alias("n"), top, F.lit(None).cast("int").alias("more"))
        most = -(-most // width)
    return rounds


def tops(rounds: list[DataFrame], fanout: int) -> DataFrame:
    """tree and the hash left at its top."""
    return rounds[-1].select("tree", F.element_at(f"level{_levels(fanout)}", 1).alias("hash"))


def proved(rounds: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """hash, more, path and the columns of ``above`` (tree, path, others) for every leaf of the trees, from the top down."""
    steps = _levels(fanout)
    width = fanout**steps
    others = [c for c in above.columns if c not in ("tree", "idx", "path")]
    above = above.withColumn("idx", F.lit(0).cast("bigint"))
    for blocks in reversed(rounds):
        spread = blocks.join(above.select("tree", "idx", "path", *others), ["tree", "idx"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        spread = spread.withColumn("hash", F.element_at("level0", F.col("slot") + 1)).filter("hash is not null")
        own = []
        for step in range(steps):
            level, at = F.col(f"level{step}"), F.expr(f"slot div {fanout**step}")
            first = F.expr(f"slot div {fanout ** (step + 1)}") * fanout
            left = F.concat_ws("", F.slice(level, first + 1, at - first))
            right = F.concat_ws("", F.slice(level, at + 2, first + fanout - at - 1))
            own.append(F.struct(left.alias("left"), right.alias("right")))
        hashed = sum((F.col("n") > fanout**step).cast("int") for step in range(steps))
        path = F.concat(F.slice(F.array(*own), F.lit(1), hashed), F.col("path"))
        more = F.element_at("more", F.col("slot") + 1).alias("more")
        above = spread.select("tree", (F.col("idx") * width + F.col("slot")).cast("bigint").alias("idx"), "hash", more, path.alias("path"), *others)
    return above


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """id, the columns of ``carry`` (expressions over ``docs``), leaf, path, subroot and root of every row of ``docs``."""
    if fanout < 2:
        raise ValueError("a tree needs a fanout of two at least")
    carry = carry or {}
    # Order of trees: null first, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    named = [F.col(id_col).alias("id"), *[c.alias(f"carry{k}") for k, c in enumerate(carry.values())]]
    leaves = saved(docs.select(tree.alias("tree"), leaf([F.col(c) for c in fields]).alias("hash"), *named), "leaves")
    placed = numbered(leaves, ["tree"], ["id", "hash"], "idx", "n")
    more = F.struct("id", *[f"carry{k}" for k in range(len(carry))]).alias("more")
    groups = grow(placed.select("tree", "idx", "n", "hash", more), fanout)
    subroots = tops(groups, fanout)
    whole = numbered(subroots, [], ["tree"], "idx", "n").select(F.lit("").alias("tree"), "idx", "n", "hash", F.col("tree").alias("more"))
    trees = grow(whole, fanout)
    none = F.array().cast(PATH)
    ends = proved(trees, tops(trees, fanout).select("tree", none.alias("path"), F.col("hash").alias("root")), fanout)
    ends = ends.select(F.col("more").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    found = proved(groups, ends, fanout)
    return found.select(
        F.col("more.id").alias(id_col), *[F.col(f"more.carry{k}").alias(c) for k, c in enumerate(carry)],
        F.col("hash").alias("leaf"), "path", "subroot", "root",
    )
