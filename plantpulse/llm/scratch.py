"""Tables and files a job keeps in the shared folder between its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import new_folder

_made: dict[str, list[str]] = {}


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, remembered until ``release``."""
    path = new_folder(spark, purpose)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read from there: cuts lineage and is never computed twice."""
    path = folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what this application has kept; results that were not written yet become unreadable."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
