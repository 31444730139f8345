"""Connected components of a link table by alternating large and small stars.

Each step takes minima per node and joins them back, so a node with very many links is combined on the map side and
split by the join; no list of neighbours is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots themselves; the root is the smallest node."""
    state = saved(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below, above = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), below.alias("below"), above.alias("above"))
        least = saved(least, "nodes")
        # Done when every node has either one smaller neighbour, its root, or only larger ones: another step would change nothing.
        if least.filter("below > 1 or below = 1 and above > 0").isEmpty():
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = saved(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
