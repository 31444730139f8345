"""Distributed numbering against a sequential count."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plantpulse.operators.ordering import numbered


def test_numbers_of_hot_null_and_small_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k % 997 if k % 50 else None, k) for k in range(6_000)]
    table = spark.createDataFrame(rows, "k string, x int, id int").repartition(5)
    got = numbered(table, ["k"], ["x", "id"], total="n").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {}
    for key, members in groups.items():
        members.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (place, len(members)) for place, r in enumerate(members)}
    assert {r.id: (r.position, r.n) for r in got} == want


def test_numbers_of_a_whole_table_and_of_none(spark):
    table = spark.range(3_000).select((F.col("id") * 7919 % 3_000).alias("id"))
    assert all(r.id == r.place for r in numbered(table, [], ["id"], "place").collect())
    assert numbered(table.limit(0), ["id"], ["id"], total="n").count() == 0


def test_one_prefix_is_numbered_by_many_tasks(spark):
    # Adaptive execution would merge ranges this small; at scale each is merged up to the advisory size only.
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_one_prefix(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def check_one_prefix(spark):
    table = spark.range(100_000).select(F.lit("one").alias("k"), F.format_string("signal%06d", "id").alias("s"))
    placed = numbered(table, ["k"], ["s"]).withColumn("task", F.spark_partition_id())
    assert placed.filter("position <> int(substring(s, 7))").count() == 0
    # All rows share the key, so what one task numbers is one range of them.
    shares = Counter({r.task: r["count"] for r in placed.groupBy("task").count().collect()})
    assert max(shares.values()) < 60_000
