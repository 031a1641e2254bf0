"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one run. ``drop`` frees one early; what is left goes with the process.

    A staged table is computed once, survives lost executors and gives the planner its
    real size.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.clean)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *staged: DataFrame) -> None:
        for df in staged:
            folder = df.inputFiles()[:1]
            if folder and self.root.split(":/")[-1].strip("/") in folder[0]:
                delete_path(self.spark, folder[0].rpartition("/")[0])

    def clean(self) -> None:
        with contextlib.suppress(Exception):
            delete_path(self.spark, self.root)
        atexit.unregister(self.clean)
