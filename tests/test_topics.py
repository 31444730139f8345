from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantpulse.functions import topics
from plantpulse.functions.constants import CHANNEL_TOPICS

part = st.text(alphabet="ab-_. +", min_size=1, max_size=6)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(part, part, part, st.sampled_from(sorted(CHANNEL_TOPICS))), min_size=1, max_size=30))
def test_build_then_parse(spark, rows):
    df = spark.createDataFrame(rows, "s string, a string, x string, c string")
    built = df.withColumn("t", topics.build_topic(*[F.col(n) for n in "saxc"]))
    back = built.select("s", "a", "x", "c", topics.parse_topic(F.col("t")).alias("p")).collect()
    for r in back:
        assert (r.p.site_id, r.p.area_id, r.p.asset_id, r.p.channel, r.p.error) == (r.s, r.a, r.x, r.c, None)


@pytest.mark.parametrize(
    "topic,error",
    [
        ("site/s/area/a/asset/x/command/request", None),
        ("site/s/area/a/asset/x/write", "channel is not in use: write"),
        ("site/s/area/a/asset/x", "text is no device topic: site/s/area/a/asset/x"),
        ("plant/s/area/a/asset/x/event", "text is no device topic: plant/s/area/a/asset/x/event"),
        ("", "text is no device topic: "),
        (None, "text is no device topic: "),
    ],
)
def test_parse_errors(spark, topic, error):
    df = spark.createDataFrame([(topic,)], "t string").select(topics.parse_topic(F.col("t")).alias("p"))
    assert df.first().p.error == error


@pytest.mark.parametrize(
    "pattern,topic,matches",
    [
        ("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d/c", False), ("a/#", "a", True), ("a/#", "a/b/c", True), ("a/#", "ab", False),
        ("#", "x/y", True), ("a/+", "a/", True), ("a.b", "axb", False), ("+/b", "a/b", True),
    ],
)
def test_filter(spark, pattern, topic, matches):
    df = spark.createDataFrame([(topic,)], "t string").select(topics.topic_filter(F.col("t"), pattern).alias("m"))
    assert df.first().m is matches


def test_bad_filter_is_refused():
    with pytest.raises(ValueError):
        topics.topic_filter(None, "a/#/b")
