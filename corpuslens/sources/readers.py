"""Sources. Every reader takes an explicit schema or has a fixed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TALKS_SCHEMA = "transcript STRING"
ABSTRACTS_SCHEMA = "abstract STRING"
ESSAYS_SCHEMA = "TEXT STRING, cEXT STRING, cNEU STRING, cAGR STRING, cCON STRING, cOPN STRING"
CONTEXT_SCHEMA = "context MAP<STRING, STRING>"
TRAIT_SCORES_SCHEMA = (
    "`question type` MAP<STRING, STRUCT<context_keys: MAP<STRING, STRUCT<diff: DOUBLE>>>>"
)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and quoted newlines. Columns are taken by header name, so the
    schema names only the wanted ones; ``encoding='windows-1252'`` needs a session with
    spark.sql.legacy.javaCharsets."""
    wanted = T.StructType.fromDDL(schema)
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", encoding)
    )
    raw = reader.csv(path)
    names = columns or wanted.names
    return raw.select(*[F.col(f"`{n}`").cast(wanted[n].dataType).alias(n) for n in names])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files, one document each: file, text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row per line. ``part`` and ``line_no`` order the lines of a file
    without moving any text."""
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("text"),
    )


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of number to sentence: item, sentence."""
    raw = spark.read.text(path, wholetext=True)
    return explode_json_map(raw, "value").select(
        F.col("key").cast("int").alias("item"), F.col("value").alias("sentence")
    )


def explode_json_map(df: DataFrame, column: str, value_type: str = "STRING") -> DataFrame:
    """One row per entry of a JSON object held in a column: key, value."""
    keep = [c for c in df.columns if c != column]
    entries = F.from_json(F.col(column), f"MAP<STRING, {value_type}>")
    return df.select(*keep, F.explode(entries).alias("key", "value"))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """key, text from a nested JSON object."""
    raw = spark.read.schema(CONTEXT_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("context").alias("key", "text"))


def read_trait_scores(spark: SparkSession, path: str) -> DataFrame:
    """key, trait, diff from a nested JSON object."""
    raw = spark.read.schema(TRAIT_SCORES_SCHEMA).option("multiLine", True).json(path)
    by_trait = raw.select(F.explode("`question type`").alias("trait", "_t"))
    by_key = by_trait.select("trait", F.explode("_t.context_keys").alias("key", "_s"))
    return by_key.select("key", "trait", F.col("_s.diff").alias("diff"))


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A stored corpus, projected to its text."""
    return spark.read.parquet(path).select(F.col(text).alias("text"))
