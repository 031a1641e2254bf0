"""Session helpers for tests, the bench and jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: tempfile.TemporaryDirectory | None = None


def local_session(cores: str = "8", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings a cluster would carry in its defaults file."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuslens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Code page 1252 is outside Spark's default charset list.
        .config("spark.sql.legacy.javaCharsets", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        global _local_dir
        _local_dir = tempfile.TemporaryDirectory(prefix="corpuslens-")
        shared = _local_dir.name
    sc.setCheckpointDir(shared)
    return shared


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It is computed once however often it is used, it survives lost executors, and the
    planner knows its real size: a small one is broadcast below
    spark.sql.autoBroadcastJoinThreshold, a large one is not.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if folder.rpartition("/")[2].startswith("stage-"):
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
