"""Session settings the operators rely on, and where jobs may keep durable scratch data."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings, safe to set on a session somebody else built.
SQL_SETTINGS = {
    # Naive device timestamps are UTC; every instant is shown in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of voiding the payload.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Top-n per key prunes on the map side up to the largest page an asset query may ask for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # The JVM never compiles a method of more than 8000 bytes of bytecode: long lists of rules and fields would be interpreted
    # row by row. Above this size Spark cuts them into small methods instead of fusing them into one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session and return it."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plantpulse")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # The test tables are single small files: read them with all cores.
        .config("spark.sql.files.minPartitionNum", str(max(shuffle_partitions, 8)))
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python line of every expression costs more than building long rule lists.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting: it gets a temporary folder,
    remembered in the session. A cluster without the setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="plantpulse-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run under the shared folder."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the shared folder and read from there: never computed twice, and safe from lost executors."""
    path = new_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
