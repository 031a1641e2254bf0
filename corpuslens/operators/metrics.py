"""Classification metrics per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and F1 of the positive class from (task, label, prediction) rows."""
    hit = (F.col("label") == F.col("prediction")).cast("int")
    both = F.sum(F.col("label") * F.col("prediction"))
    either = F.sum(F.col("label") + F.col("prediction"))
    return df.groupBy("task").agg(
        F.count("*").alias("rows"),
        F.avg(hit).alias("accuracy"),
        F.coalesce(F.try_divide(2.0 * both, either), F.lit(0.0)).alias("f1"),
    )
