"""From raw documents to packed sequences, stage by stage.

Every stage reads what its predecessor kept and returns a DataFrame that is written as
Parquet before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontamination, line_dedup, near_dedup, queries, toxicity
from corpuslens.llm.staging import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; a document that
    loses all its text that way was a copy and goes too."""
    cut = line_dedup.drop_repeated_lines(docs)
    left = cut.filter((F.col("n_dropped_lines") == 0) | (F.trim("text") != ""))
    changed = F.when(F.col("n_dropped_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near dedup", copies_out),
    ("benchmark decontamination", leaks_out),
    ("best-fit packing", packed),
]

#: Learned scores, alignments and token ids are beyond SQL; tests hold each stage against
#: a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        path = scratch.path(f"{name.replace(' ', '-')}-{uuid.uuid4().hex[:6]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
