"""A training corpus from ``documents``: language, exact copies, near copies, benchmark passages, source mix.

Each stage works on all rows its predecessor kept. A document id stands for its rows: near copies and contaminated
documents go by id, so rows that share an id stand or fall together (exact copies are told apart by their text too).
Rows with null ids are kept or dropped like any other. Empty tables pass through. Extra columns pass through all stages
but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantpulse.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from plantpulse.llm.scratch import saved


def _by_id(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id occurs, or does not, in ``decided`` (column d_doc_id)."""
    return docs.join(decided, docs["doc_id"].eqNullSafe(decided["d_doc_id"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognised language. Rejected are those without text or letters, and those whose code length in
    every learned language is far above what labelled documents of their size take."""
    model = language_id.fit(docs, F.lit(True))
    # The other columns travel as one, whatever they are called, and the text beside them once.
    names = {name: f"c{k}" for k, name in enumerate(docs.columns) if name not in ("text", "lang")}
    others = F.struct(F.lit(True).alias("there"), *[docs[f"`{name}`"].alias(c) for name, c in names.items()]).alias("doc")
    scored = saved(language_id.predict(docs.select(others, "text", "lang"), model), "recognised")
    return scored.filter(language_id.recognised(scored)).select(
        *[F.col(f"doc.{names[name]}").alias(name) if name in names else F.col(name) for name in docs.columns]
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    kept = exact_dedup.copies(docs).filter("kept").select(F.struct("doc_id", F.col("text_sha256").alias("sha")).alias("key"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower).cast("binary"), 256)
    # The row travels as one column, whatever its columns are called.
    marked = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", sha.alias("sha")).alias("key"))
    # A struct is never null, and equal where its fields are, nulls too: join and window share one exchange of the texts.
    place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return marked.join(kept, "key", "left_semi").withColumn("place", place).filter("place = 1").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word runs, similarity 0.8 or more) the smallest id stays."""
    kept = near_dedup.near_duplicates(docs, percent=80).filter("kept").select(F.col("doc_id").alias("d_doc_id"))
    return _by_id(docs, kept, "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("d_doc_id"))
    return _by_id(docs, found, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words each document gives to the mix."""
    return mixing.taken(*mixing.mix(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: Near copies and the mix cannot be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
