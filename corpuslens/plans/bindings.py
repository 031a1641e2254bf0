"""How the study's inputs are read from the given tables.

Corpora are the sources of ``documents``; scripts are turns of ``conversations``; yes/no
labels are ``labels``; answer masses are ``events``; the questionnaire a model takes is
``benchmark``, every occurrence of a frequent word being one masked item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import N_ITEMS
from ..functions.text import lines, sentences
from ..operators.ranking import position_bucket, running_offset
from ..operators.rows import posexplode_rows
from ..operators.statements import masked_sentences, sentence_rows

# The answer words do not occur in the given texts; these five stand for them.
ANSWER_WORDS = ["the", "of", "and", "to", "in"]
EVENT_ANSWERS = ["click", "view", "purchase", "signup", "error"]
EPS = 1e-9
N_RUNS = 11
EPOCH_DAYS = 10
TASKS = ["copa", "rte", "wic", "wsc", "wsc.fixed", "boolq", "axg"]
# Trait -> (label column, label is the opposite of the trait)
LABELS = {"extroversion": ("quality", False), "emotional stability": ("toxic", True)}
SCORE_TRAITS = ["extroversion", "neuroticism"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table of few scan tasks, before work that is bound by the CPU: a file
    of one row group is one task. A large table is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, key)


def documents_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For plain scans: nothing is moved."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents_as_stored(spark, sf_dir), "doc_id")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source")


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, item, idx, value, epoch."""
    answers = F.array(*map(F.lit, EVENT_ANSWERS))
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.floor(n / N_ITEMS) % N_RUNS).alias("run"),
        (n % N_ITEMS + 1).alias("item"),
        (F.array_position(answers, F.col("event_type")) - 1).alias("idx"),
        "value",
        F.floor(F.dayofmonth("ts") / EPOCH_DAYS).alias("epoch"),
    )


def script_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per turn: the speaker, then the speech."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("text")
    )


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each corpus with their position in it: source, doc_id, pos, row_no, text."""
    docs = documents(spark, sf_dir).select("doc_id", "source", lines(F.col("text")).alias("_lines"))
    # Only the line counts are ordered; the text meets its offset by document.
    counts = docs.select("source", "doc_id", F.size("_lines").alias("_n"))
    firsts = running_offset(
        counts, ["doc_id"], position_bucket("doc_id"), ["source"], F.col("_n"), out="_first"
    ).select("doc_id", "_first")
    placed = docs.join(firsts, "doc_id")
    rows = posexplode_rows(placed, ["source", "doc_id", "_first"], "_lines", "pos", "text").select(
        "source", "doc_id", "pos", (F.col("_first") + F.col("pos")).alias("row_no"), "text"
    )
    cores = spark.sparkContext.defaultParallelism
    return rows if int(spark.conf.get("spark.sql.shuffle.partitions")) >= cores else rows.repartition(2 * cores, "row_no")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def trait_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores (doc_id, trait, diff): quality against toxicity, and the reverse."""
    diff = F.col("quality") - F.col("toxic")
    both = F.array(
        F.struct(F.lit(SCORE_TRAITS[0]).alias("trait"), diff.alias("diff")),
        F.struct(F.lit(SCORE_TRAITS[1]).alias("trait"), (-diff).alias("diff")),
    )
    return (
        table(spark, sf_dir, "labels")
        .withColumn("_d", F.explode(both))
        .select("doc_id", "_d.trait", "_d.diff")
    )


def item_number(*parts: str) -> Column:
    """Spread masked sentences over the 50 items."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return (total % N_ITEMS + 1).cast("bigint")


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, pos, spot, target, left, right, masked, item from ``benchmark``."""
    rows = masked_sentences(sentence_rows(table(spark, sf_dir, "benchmark")), ANSWER_WORDS)
    return rows.withColumn("item", item_number("item_id", "pos", "spot"))


def statement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, spot, target, masked, item from ``conversations``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = masked_sentences(sentence_rows(turns), ANSWER_WORDS).drop("left", "right")
    return rows.withColumn("item", item_number("conv_id", "turn", "pos", "spot"))


def sentence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of all documents with its position: doc_id, pos, row_no."""
    docs = documents(spark, sf_dir).select("doc_id", F.size(sentences(F.col("text"))).alias("_n"))
    placed = running_offset(docs, ["doc_id"], position_bucket("doc_id"), [], F.col("_n"), out="_first")
    counted = placed.where(F.col("_n") > 0)
    return counted.select(
        "doc_id", "_first", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("pos")
    ).select("doc_id", "pos", (F.col("_first") + F.col("pos")).alias("row_no"))
