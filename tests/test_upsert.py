"""The upsert fold against a sequential simulation."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantpulse.operators.upsert import COMMAND_LOG, UpsertSpec, command_changes, fold, insert_if_absent, merge

SPEC = UpsertSpec("t", keys=["k"], first=["a"], last=["b"], time="k", last_known={"c": "none"})
arrivals = st.lists(
    st.tuples(st.integers(0, 3), st.sampled_from("xyz"), st.sampled_from("uvw"), st.one_of(st.none(), st.sampled_from("pq"))),
    min_size=1, max_size=25,
)


def simulate(rows, table=None):
    table = {} if table is None else table
    for k, a, b, c in rows:
        if k not in table:
            table[k] = [a, b, c if c is not None else "none"]
        else:
            table[k][1] = b
            if c is not None:
                table[k][2] = c
    return table


def as_dict(df):
    return {r.k: [r.a, r.b, r.c] for r in df.collect()}


def frame(spark, rows, start=0):
    numbered = [(*r, start + i) for i, r in enumerate(rows)]
    random.Random(7).shuffle(numbered)
    return spark.createDataFrame(numbered, "k int, a string, b string, c string, arrival bigint")


COMMON = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**COMMON)
@given(arrivals)
def test_fold_equals_sequential_upserts(spark, rows):
    df = frame(spark, rows)
    assert as_dict(fold(df, SPEC)) == simulate(rows)
    assert as_dict(fold(df.unionByName(df), SPEC)) == simulate(rows)


@settings(**COMMON)
@given(arrivals, arrivals)
def test_merge_equals_one_after_the_other(spark, before, after):
    stored = fold(frame(spark, before), SPEC)
    assert as_dict(merge(stored, frame(spark, after), SPEC)) == simulate(after, simulate(before))


def test_hot_key(spark):
    """A third of all rows are copies of one key."""
    rows = [(0 if i % 3 == 0 else i, "x", str(i), None) for i in range(3000)]
    assert as_dict(fold(frame(spark, rows), SPEC)) == simulate(rows)


def test_ack_before_request(spark):
    columns = "kind string, issued_at int, command_id string, site_id string, asset_id string, target_signal string, requested_value string, requested_by string, priority string, approved boolean, approval_reference string, expires_at int, status string, arrival int"
    ack = ("ack", 1, "c", "s", "a", "", "", "system", "medium", True, "", 9, "done", 0)
    request = ("request", 1, "c", "s", "a", "speed", "7", "op", "high", False, "", 5, "pending-approval", 1)
    both = fold(command_changes(spark.createDataFrame([ack, request], columns)), COMMAND_LOG).first()
    assert (both.target_signal, both.requested_by, both.requested_value, both.approved, both.status) == ("", "system", "7", False, "pending-approval")
    alone = fold(command_changes(spark.createDataFrame([ack], columns)), COMMAND_LOG).first()
    assert (alone.requested_value, alone.approved, alone.status) == ("", True, "done")


def test_insert_if_absent_takes_each_new_key_once(spark):
    have = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert [tuple(r) for r in insert_if_absent(have, new, ["k"]).collect()] == [(2, "a")]
    assert insert_if_absent(have, new.select("k"), ["k"]).collect()[0].k == 2


def test_refresh_of_everything_is_a_recompute(spark):
    from datetime import datetime, timedelta

    from plantpulse.operators import rollups

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), "s", f"a{i % 3}", "x", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts_source timestamp, site_id string, asset_id string, signal_id string, value double")
    df = df.withColumn("ts_source", F.col("ts_source").cast("timestamp_ntz"))
    stale = rollups.rollup(df.withColumn("value", F.lit(0.0)), "15 minutes")
    full = rollups.rollup(df, "15 minutes")
    fresh = rollups.refresh(stale, df, "15 minutes", "14 days", "15 minutes", datetime(2024, 1, 10))
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, full.collect()))


def test_refresh_range_takes_whole_buckets_only():
    from datetime import datetime

    from plantpulse.operators.rollups import refresh_range

    assert refresh_range("1 hour", "2 hours", "1 minute", datetime(2024, 1, 1, 12, 30)) == (
        datetime(2024, 1, 1, 11), datetime(2024, 1, 1, 12),
    )


def test_first_and_last_columns_of_repeated_events_states_and_requests(spark):
    from plantpulse.operators.upsert import ASSET_STATE, COMMAND_REQUESTS, EVENTS

    for spec in (EVENTS, ASSET_STATE, COMMAND_REQUESTS):
        names = [*spec.keys, *spec.first, *spec.last]
        arrivals = [tuple("k" if n in spec.keys else f"{n}{turn}" for n in names) + (turn,) for turn in (2, 0, 1)]
        df = spark.createDataFrame(arrivals, ", ".join(f"{n} string" for n in names) + ", arrival int")
        (row,) = fold(df, spec).collect()
        assert row.asDict() == {n: "k" if n in spec.keys else f"{n}{0 if n in spec.first else 2}" for n in names}
