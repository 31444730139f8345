"""JDBC table scan and overwrite sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def table_reader(
    spark: SparkSession, url: str, table: str, user: str, password: str, start: datetime, end: datetime, partitions: int,
    time: str = "ts_source", fetch_size: int = 10_000,
) -> DataFrameReader:
    """A reader that splits the scan into ``partitions`` equal time spans.

    Filters and column choice reach the database; rows outside the bounds are still read,
    by the first and last partition.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("user", user)
        .option("password", password)
        .option("fetchsize", fetch_size)
        .option("partitionColumn", time)
        .option("lowerBound", start.isoformat(sep=" "))
        .option("upperBound", end.isoformat(sep=" "))
        .option("numPartitions", partitions)
    )


def overwrite_table(
    df: DataFrame, url: str, table: str, user: str, password: str, connections: int = 8, batch_size: int = 10_000
) -> None:
    """Replace the contents of a table, keeping the table itself."""
    (
        df.write.mode("overwrite")
        .format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("user", user)
        .option("password", password)
        .option("truncate", "true")
        .option("batchsize", batch_size)
        .option("numPartitions", connections)
        .save()
    )
