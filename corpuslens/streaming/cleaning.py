"""Clean documents as they arrive. The cleaners are plain column expressions without
state, so the batch code runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of files, one document each, read as new files come in."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    )


def write_cleaned(
    docs: DataFrame, clean: Callable[[Column], Column], out: str, checkpoint: str
) -> StreamingQuery:
    """Clean what has arrived since the last run, then stop."""
    cleaned = docs.withColumn("text", clean(F.col("text")))
    return (
        cleaned.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
