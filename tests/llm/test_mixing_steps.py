"""Steps of the mix: what goes through the driver."""

from __future__ import annotations

import re

from plantpulse.llm import mixing


def test_documents_are_not_broadcast_to_the_blocks(spark, docs):
    """The planner knows the packed size of the stored rows, not how many blocks they are exploded into."""
    _, pieces = mixing.mix(docs, block_words=64)
    assert pieces.count()
    plan = pieces._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"Join \[rank#\w+, turn#\w+\]", line)]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
