"""Sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TRAITS, slug
from ..functions.text import slug as slug_col


def write_lines(df: DataFrame, path: str, text: str = "text") -> None:
    """One row per line; a newline inside a row makes further lines, as in the study."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_by_polarity(df: DataFrame, path: str, text: str = "text") -> None:
    """Text files in one folder per trait and polarity."""
    (
        df.select(slug_col(F.col("trait")).alias("trait"), "polarity", F.col(text).alias("value"))
        .write.mode("overwrite")
        .partitionBy("trait", "polarity")
        .text(path)
    )


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(wide: DataFrame, path: str) -> None:
    """Result CSV: header, base, seeds, mean, stdev. The report has 13 rows per corpus."""
    columns = [F.col(slug(t)).alias(t) for t in TRAITS]
    (
        wide.orderBy("ord")
        .select("seed", *columns)
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def write_reports(wide: DataFrame, path: str, name: str = "corpus") -> list[str]:
    """One result CSV per model: ``path``/<name>.csv, each with header, base, seeds, mean and stdev in
    this order. The files are written under a temporary folder, a task per model, and put in
    place by renaming, so a reader sees whole files only; files of the same name are replaced.
    The driver lists files, one per model."""
    spark = wide.sparkSession
    columns = [F.col(slug(t)).alias(t) for t in TRAITS]
    rows = wide.select(F.col(name).alias("_name"), "ord", "seed", *columns)
    # A model's rows lie in one task and are sorted there, so partitionBy gives it one file.
    rows = rows.repartition("_name").sortWithinPartitions("_name", "ord").drop("ord")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    out = fs_path(path)
    files = out.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs_path(out, f"_writing-{uuid.uuid4().hex}")
    rows.write.partitionBy("_name").option("header", True).csv(held.toString())
    made = []
    for folder in files.globStatus(fs_path(held, "_name=*")):
        label = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().removeprefix("_name="))
        parts = files.globStatus(fs_path(folder.getPath(), "part-*"))
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} files for {label}")
        target = fs_path(out, f"{label.replace('/', '_')}.csv")
        files.delete(target, False)
        files.rename(parts[0].getPath(), target)
        made.append(target.toString())
    files.delete(held, True)
    return sorted(made)


def append_log(scores: DataFrame, path: str) -> None:
    """Append-only log of (run, epoch, trait, score)."""
    scores.select("run", "epoch", "trait", "score").write.mode("append").parquet(path)


def log_lines(path_scores: DataFrame) -> DataFrame:
    """The log as text: ``Base: {..}`` for epoch 0, else ``Epoch i: {..}``."""
    order = F.array(*map(F.lit, TRAITS))
    entry = F.struct(
        F.array_position(order, F.col("trait")).alias("place"),
        F.concat(F.lit("'"), F.col("trait"), F.lit("': "), F.col("score").cast("string")).alias("text"),
    )
    rows = path_scores.groupBy("run", "epoch").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    head = F.when(F.col("epoch") == 0, "Base").otherwise(F.concat(F.lit("Epoch "), F.col("epoch").cast("string")))
    body = F.array_join(F.transform("_e", lambda e: e["text"]), ", ")
    return rows.select("run", "epoch", F.concat(head, F.lit(": {"), body, F.lit("}")).alias("line"))


def write_json(records: DataFrame, path: str) -> None:
    """Nested records, one JSON object per run."""
    records.write.mode("overwrite").json(path)
