"""Newest-per-key, top-n per key and row positions that hold when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def newest(table: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; map tasks send one row per key."""
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def top_n(table: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    Ranked twice: first within (key, salt), so that a hot key is cut down by many tasks,
    then over at most ``salts * n`` survivors per key. Both ranks prune before their
    shuffle. The result is exact, since a row among the first n of its key is also
    among the first n of its salt.
    """
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    for part in ([*keys, "_salt"], keys):
        ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
        salted = ranked.filter(F.col("_rank") <= n)
    return salted.drop("_salt").withColumnRenamed("_rank", "rank")


def with_position(table: DataFrame, keys: list[str], chunk: Column, order: list[Column]) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... of each row within its key.

    ``chunk`` is a coarse value that rises with ``order`` (an hour, a first letter). Rows
    are numbered within (key, chunk) and shifted by the rows of the chunks before, so a
    hot key is numbered by as many tasks as it has chunks.
    """
    chunked = table.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_rows")
    shifts = sizes.select(*keys, "_chunk", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        chunked.withColumn("_within", within)
        .join(shifts, [*keys, "_chunk"])
        .withColumn("position", F.col("_before") + F.col("_within") - 1)
        .drop("_chunk", "_within", "_before")
    )


def numbered(table: DataFrame, keys: list[str], order: list[str], name: str = "position", total: str | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... of each row within its key, by ``order`` ascending, nulls first; ``total`` adds the rows of the key.

    A distributed rank that needs no hint about the values: rows are dealt out by ranges of (key, order) and stored with
    the number of their range, each range counts its rows per key, and the rows of the ranges before are added. A hot
    key, or a table without keys, is numbered by as many tasks as it has ranges; one task sees one row per range of a
    key at most. Null keys are a key of their own. Rows equal in key and order share a range and are numbered in any order.
    """
    ranged = stored(table.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    ranged = ranged.withColumn("_key", F.struct("_range", *keys))
    sizes = ranged.groupBy("_key").agg(F.count("*").alias("_rows"))
    of_key = Window.partitionBy(*[f"_key.{k}" for k in keys])
    before = F.sum("_rows").over(of_key.orderBy("_key._range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    shifts = sizes.select("_key", before.alias("_before"), F.sum("_rows").over(of_key).alias("_total"))
    within = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    placed = ranged.withColumn("_within", within).join(shifts, "_key")
    added = {name: F.col("_before") + F.col("_within") - 1} | ({total: F.col("_total")} if total else {})
    return placed.withColumns(added).drop("_range", "_key", "_within", "_before", "_total")


def nest_pages(table: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, page_size: int = 1000) -> DataFrame:
    """Rows of each key as ordered arrays of structs, at most ``page_size`` per output row.

    Almost every key fits on page 0. A key with more rows gets more pages, so no array
    grows with the data.
    """
    placed = numbered(table, keys, order)
    paged = placed.withColumn("page", F.floor(F.col("position") / F.lit(page_size)).cast("int"))
    nested = paged.groupBy(*keys, "page").agg(
        F.array_sort(F.collect_list(F.struct("position", *columns))).alias("_rows")
    )
    fields = F.transform("_rows", lambda r: F.struct(*[r.getField(c).alias(c) for c in columns]))
    return nested.select(*keys, "page", fields.alias(name))
