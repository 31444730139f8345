"""Time literals and spans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def span(text: str) -> timedelta:
    """``"15 minutes"`` as a timedelta."""
    count, unit = text.split()
    return timedelta(**{unit if unit.endswith("s") else unit + "s": int(count)})


def floor_time(moment: datetime, width: timedelta) -> datetime:
    """Start of the bucket a naive UTC moment falls into."""
    return EPOCH + (moment - EPOCH) // width * width


def literal(moment: datetime, df: DataFrame, column: str) -> Column:
    """A naive UTC moment as a literal of the column's own timestamp type.

    Equal types keep the comparison free of casts, so it can be pushed into the scan.
    """
    kind = "TIMESTAMP_NTZ" if df.schema[column].dataType.typeName() == "timestamp_ntz" else "TIMESTAMP"
    return F.expr(f"{kind} '{moment.isoformat(sep=' ')}'")
