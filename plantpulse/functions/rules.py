"""First-failing-rule validation as one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error texts of contracts, topics and routing, in the words of this library.
NOT_JSON = "payload is not valid JSON"
NOT_OBJECT = "payload is not an object"
ABSENT = "{} is missing"
EMPTY = "{} may not be empty"
UNKNOWN_VALUE = "{} has a value outside its list"
BAD_TIME = "no full date and time: "
BELOW_ZERO = "{} is below zero"
VALUE_KIND = "value is neither number nor text nor flag"
VALUE_TEXT = "value does not read as a number: "
LOOSE_REFERENCE = "approval_reference stands without an approval"
NO_SCORE = "message carries no score"
NO_TABLE = "no table takes messages of topic "
NO_CHANNEL = "channel is not in use: "
BAD_PART = "{} is empty or holds a slash"
NOT_A_TOPIC = "text is no device topic: "

REJECTED = "rejected"
MALFORMED = "malformed"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true when the row fails; NULL counts as not broken."""

    broken: Column
    message: Column
    reason: str = REJECTED


def rule(broken: Column, message: str | Column, reason: str = REJECTED) -> Rule:
    return Rule(broken, F.lit(message) if isinstance(message, str) else message, reason)


def first_failure(rules: list[Rule]) -> Column:
    """Struct (reason, error) of the first broken rule, NULL when every rule holds."""
    def failure(r: Rule) -> Column:
        return F.struct(F.lit(r.reason).alias("reason"), r.message.alias("error"))

    never = F.when(F.lit(False), failure(rule(F.lit(False), "")))
    return F.coalesce(*[F.when(r.broken, failure(r)) for r in rules], never)


def with_failure(df: DataFrame, failure: Column) -> DataFrame:
    """Add the ``failure`` column so that it is worked out once per row.

    A filter on a plain column is moved below the projection and takes a second copy of the
    whole rule list along. A filter on a generated column stays above, so the column is
    generated, as the one element of an array.
    """
    return df.withColumn("failure", F.explode(F.array(failure)))
