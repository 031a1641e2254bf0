"""Rows that every operator has to take."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t long, form string, score double, offset int, h long, _id long, _t string, _h int, _drop string, item_id long, k int"
TEXTS = [
    (1, None), (2, ""), (3, "   \n\n \t "), (4, "one"), (5, "Ünï çödé 漢字 😀 text of a few words here"),
    (6, "same words in this row\nand a second line of it"), (6, "same words in this row\nand a second line of it"),
    (7, "same words in this row\nand a second line of it"), (8, LONG), (9, LONG), (None, "no id here at all, five words"),
    (None, None), (10, "x" * 100_000), (11, "!!! ??? ..."), (12, "!!! ??? ,,,"),
]


def messy(spark):
    rows = [(i, t, None, None, None, 1, "f", 0.5, 3, None, 1, None, 2, "d", 4, None) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
