"""Device topics ``site/{site}/area/{area}/asset/{asset}/{channel}`` as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .constants import CHANNEL_TOPICS


def build_topic(site: Column, area: Column, asset: Column, channel: Column) -> Column:
    """The topic text, or NULL where ``topic_error`` is set."""
    built = F.concat_ws("/", F.lit("site"), site, F.lit("area"), area, F.lit("asset"), asset, channel)
    return F.when(topic_error(site, area, asset, channel).isNull(), built)


def topic_error(site: Column, area: Column, asset: Column, channel: Column) -> Column:
    """Why a topic cannot be built: NULL when it can."""
    known = F.coalesce(channel.isin(*CHANNEL_TOPICS), F.lit(False))
    checks = [F.when(~known, F.concat(F.lit(R.NO_CHANNEL), F.coalesce(channel, F.lit(""))))]
    for name, part in (("site_id", site), ("area_id", area), ("asset_id", asset)):
        bad = part.isNull() | (part == "") | part.contains("/")
        checks.append(F.when(bad, F.lit(R.BAD_PART.format(name))))
    return F.coalesce(*checks)


def parse_topic(topic: Column) -> Column:
    """Struct (site_id, area_id, asset_id, channel, error); the parts are NULL when error is set."""
    parts = F.split(topic, "/", -1)
    size = F.size(parts)
    shaped = (
        (size >= 7) & (F.get(parts, F.lit(0)) == "site") & (F.get(parts, F.lit(2)) == "area")
        & (F.get(parts, F.lit(4)) == "asset")
    )
    shaped = F.coalesce(shaped, F.lit(False))
    channel = F.when(shaped, F.array_join(F.slice(parts, F.lit(7), F.greatest(size - 6, F.lit(0))), "/"))
    known = channel.isin(*CHANNEL_TOPICS)
    error = F.when(~shaped, F.concat(F.lit(R.NOT_A_TOPIC), F.coalesce(topic, F.lit("")))).when(
        ~known, F.concat(F.lit(R.NO_CHANNEL), channel)
    )

    def part(index: int) -> Column:
        return F.when(shaped & known, F.get(parts, F.lit(index)))

    return F.struct(
        part(1).alias("site_id"),
        part(3).alias("area_id"),
        part(5).alias("asset_id"),
        F.when(known, channel).alias("channel"),
        error.alias("error"),
    )


def log_topic(channel: Column) -> Column:
    """The log topic a channel is forwarded to; NULL for an unknown channel."""
    pairs = [F.lit(x) for pair in CHANNEL_TOPICS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), channel)


def topic_filter(topic: Column, pattern: str) -> Column:
    """Subscription match: ``+`` is one level, a last ``#`` is the parent level and all below it."""
    levels = pattern.split("/")
    if "#" in levels[:-1] or any(len(x) > 1 and ("+" in x or "#" in x) for x in levels):
        raise ValueError(f"not a topic filter: {pattern}")
    tail = levels[-1] == "#"
    fixed = levels[:-1] if tail else levels
    body = "/".join("[^/]*" if x == "+" else re.escape(x) for x in fixed)
    if tail:
        body = f"{body}(/.*)?" if fixed else ".*"
    return topic.rlike(f"^{body}$")
