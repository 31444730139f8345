"""URL filters: an as-of join of captures with dated list entries.

1. ``validity``: additions and removals of a key become intervals during which the key is listed; of changes at one
   instant, an addition wins.
2. ``keys``: a capture is judged by its host, the host's parent domains, and the host with its first path segment.
3. ``judged``: captures and intervals meet by key and stretch of time, intervals in each stretch they cover, and the
   interval that holds the instant of the fetch decides. A host with very many captures is split by stretches and, as
   nothing but the join follows its exchange, by Spark's skew handling.

Keys are lower case. A null or unparsable url, or a null fetch time, matches nothing and is kept as not blocked; entries
with a null key or date are ignored. Rows repeated with one id are judged one by one. Empty lists block nothing; empty
captures give an empty result. Of the captures only id, url and fetch time are read. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import saved

STRETCH = 7 * 86400


def host(url: Column) -> Column:
    """Host of an absolute url in lower case, without user and port; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*+://([^/?#]*+)", 1)
    return F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*+$", "")


def keys(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and the host with the first path segment."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda k: (k == 1) | (k < F.size(labels))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    segment = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*+://[^/?#]*+/([^/?#]++)", 1)
    with_path = F.when(segment != "", F.array(F.concat(name, F.lit("/"), segment))).otherwise(F.expr("array()").cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(parents, with_path))).otherwise(F.expr("array()").cast("array<string>"))


def validity(changes: DataFrame, key: str = "key", at: str = "at", listed: str = "listed") -> DataFrame:
    """key, since, until (null: still listed) from changes (key, instant, listed or not)."""
    usable = changes.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    states = usable.groupBy(F.lower(key).alias("key"), F.col(at).alias("since")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("on"))
    states = states.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))
    return states.filter("on").select("key", "since", "until")


def judged(
    captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", stretch: int = STRETCH,
) -> DataFrame:
    """Per capture: id, url, fetched_at, blocked, matched_key (the longest) and listed_since."""
    base = captures.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"), F.monotonically_increasing_id().alias("row")
    )
    base = saved(base, "captures")
    cell = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / stretch)
    low, high = base.agg(F.min(cell("fetched_at")), F.max(cell("fetched_at"))).first()
    wanted = base.select("row", "fetched_at", F.explode(keys(F.col("url"))).alias("key"), cell("fetched_at").alias("cell"))
    # An interval stands in each stretch it covers between the first and the last fetch.
    first, last = F.greatest(cell("since"), F.lit(low or 0)), F.least(F.coalesce(cell("until"), F.lit(high or 0)), F.lit(high or 0))
    spans = validity(changes).withColumn("first", first).withColumn("last", last).filter("first <= last")
    spans = spans.withColumn("cell", F.explode(F.sequence("first", "last"))).drop("first", "last")
    hits = wanted.join(spans, ["key", "cell"]).filter("fetched_at >= since AND (until IS NULL OR fetched_at < until)")
    best = hits.groupBy("row").agg(F.max(F.struct(F.char_length("key").alias("size"), "key", "since")).alias("best"))
    return base.join(best, "row", "left").select(
        F.col("id").alias(id_col), "url", "fetched_at", F.col("best").isNotNull().alias("blocked"),
        F.col("best.key").alias("matched_key"), F.col("best.since").alias("listed_since"),
    )
