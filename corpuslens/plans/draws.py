"""Seeded shuffles, samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEFAULT_SEED, FINAL_CHUNK, RUN_SEEDS, STRICT_CHUNK
from ..functions.text import lines
from ..operators import packing, sampling
from ..operators.checks import size_check as flag_small
from ..operators.sampling import share
from . import sql, training_rows
from .bindings import document_ids, documents, sentence_positions, table
from .catalog import query

ITERATOR_ROWS = 10_000
TRAIN_ROWS, TEST_ROWS = 20_000, 2_000  # the study's fixed split; smaller sets are split by shares


SIZED = (
    sampling.sized_or_share(TRAIN_ROWS, TRAIN_ROWS + TEST_ROWS, 9, 10, "floor"),
    sampling.sized_or_share(TEST_ROWS, TRAIN_ROWS + TEST_ROWS, 1, 10, "ceil"),
)
SIZES_SQL = f"""CASE WHEN n >= {TRAIN_ROWS + TEST_ROWS} THEN {TRAIN_ROWS} ELSE n * 9 // 10 END AS a,
            CASE WHEN n >= {TRAIN_ROWS + TEST_ROWS} THEN {TEST_ROWS} ELSE n - n * 9 // 10 END AS b"""
SIDE_SQL = "CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'test' ELSE 'rest' END"


def ids(spark, sf_dir):
    return document_ids(spark, sf_dir)


@query(
    "head_percent",
    """SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rk, count(*) OVER () AS n FROM documents)
WHERE rk <= round_even(n * 1 / 100.0, 0)""",
)
def head_percent(spark, sf_dir):
    return sampling.head_percent(ids(spark, sf_dir), "doc_id", 1)


@query(
    "batch_ids",
    f"""WITH s AS (SELECT doc_id, len({sql.SENTENCES}) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n)) AS pos FROM s)
SELECT doc_id, pos, row_no, row_no // {ITERATOR_ROWS} AS batch
FROM (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS row_no FROM p)""",
)
def batch_ids(spark, sf_dir):
    rows = sentence_positions(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))
    return packing.batch_ids(rows, rows=ITERATOR_ROWS)


@query(
    "seeded_shuffle",
    f"""SELECT doc_id, source, row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || doc_id)) - 1 AS position
FROM documents""",
)
def seeded_shuffle(spark, sf_dir):
    return sampling.seeded_shuffle(ids(spark, sf_dir), "doc_id", DEFAULT_SEED)


@query(
    "sample_fraction",
    f"""SELECT doc_id, text FROM (
  SELECT doc_id, text, row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || doc_id)) AS rk,
         count(*) OVER () AS n FROM documents)
WHERE rk <= round_even(n * 12 / 1000.0, 0) AND text IS NOT NULL""",
)
def sample_fraction(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drawn = sampling.sample_rows(docs, "doc_id", [DEFAULT_SEED], share(12, 1000, "nearest"))
    return drawn.where(F.col("text").isNotNull()).drop("seed")


def _per_seed_sql(parts: int) -> str:
    return f"""SELECT {parts} AS parts, seed, doc_id, source FROM (
  SELECT doc_id, source, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || doc_id)) AS rk,
         count(*) OVER (PARTITION BY seed) AS n
  FROM documents, (SELECT unnest(CAST([{sql.SEEDS}] AS BIGINT[])) AS seed))
WHERE rk <= n * {parts} // 10000"""


@query("sample_per_seed", _per_seed_sql(25) + " UNION ALL " + _per_seed_sql(100))
def sample_per_seed(spark, sf_dir):
    def drawn(parts):
        rows = sampling.sample_rows(ids(spark, sf_dir), "doc_id", RUN_SEEDS, share(parts, 10_000))
        return rows.select(
            F.lit(parts).alias("parts"), F.col("seed").cast("bigint").alias("seed"), "doc_id", "source"
        )

    return drawn(25).unionByName(drawn(100))


@query(
    "split_fraction",
    f"""SELECT source, seed, doc_id, CASE WHEN rk <= n * 85 // 100 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT source, doc_id, seed,
         row_number() OVER (PARTITION BY source, seed ORDER BY md5(seed || ':' || doc_id)) AS rk,
         count(*) OVER (PARTITION BY source, seed) AS n
  FROM documents, (SELECT unnest(CAST([{sql.SEEDS}] AS BIGINT[])) AS seed))""",
)
def split_fraction(spark, sf_dir):
    return sampling.split_rows(
        ids(spark, sf_dir), "doc_id", RUN_SEEDS, share(85, 100), share(15, 100, "ceil"), ["source"]
    ).withColumn("seed", F.col("seed").cast("bigint"))


@query(
    "split_sized",
    f"""SELECT lang, doc_id, {SIDE_SQL} AS split FROM (
  SELECT *, {SIZES_SQL}
  FROM (SELECT lang, doc_id,
               row_number() OVER (PARTITION BY lang ORDER BY md5('{DEFAULT_SEED}:' || doc_id)) AS rk,
               count(*) OVER (PARTITION BY lang) AS n FROM documents))""",
)
def split_sized(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.split_rows(rows, "doc_id", [DEFAULT_SEED], *SIZED, ["lang"], keep_rest=True).drop("seed")


@query(
    "chunk_split",
    f"""WITH RECURSIVE {sql.packed(FINAL_CHUNK, True, FINAL_CHUNK)},
c AS (SELECT DISTINCT source, batch, chunk FROM chunked),
d AS (SELECT *, row_number() OVER (PARTITION BY source, seed ORDER BY md5(seed || ':' || source || ':' || batch || ':' || chunk)) AS rk,
             count(*) OVER (PARTITION BY source, seed) AS n
      FROM c, (SELECT unnest(CAST([{sql.SEEDS}] AS BIGINT[])) AS seed))
SELECT source, batch, chunk, seed, CASE WHEN rk <= n * 85 // 100 THEN 'train' ELSE 'test' END AS split FROM d""",
)
def chunk_split(spark, sf_dir):
    """The final jobs: tokenize, pack once, then split the chunks of each corpus anew per seed."""
    sides = sampling.split_chunks(
        training_rows.final_chunks(spark, sf_dir), ["batch", "chunk"], RUN_SEEDS, share(85, 100), share(15, 100, "ceil"), ["source"]
    )
    return sides.withColumn("seed", F.col("seed").cast("bigint"))


@query(
    "chunk_split_sized",
    f"""WITH RECURSIVE {sql.packed(STRICT_CHUNK, False, None)},
c AS (SELECT DISTINCT source, batch, chunk FROM chunked)
SELECT source, batch, chunk, {SIDE_SQL} AS split FROM (
  SELECT *, {SIZES_SQL}
  FROM (SELECT *, row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || source || ':' || batch || ':' || chunk)) AS rk,
               count(*) OVER () AS n FROM c))""",
)
def chunk_split_sized(spark, sf_dir):
    """The early jobs: a fixed number of chunks for each side, the rest marked as such."""
    chunks = training_rows.strict_chunks(spark, sf_dir)
    return sampling.split_chunks(chunks, ["source", "batch", "chunk"], [DEFAULT_SEED], *SIZED).drop("seed")


@query(
    "split_tiny",
    f"""SELECT doc_id, source, CASE WHEN rk <= n * 9 // 1000 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT doc_id, source, row_number() OVER (ORDER BY md5('{DEFAULT_SEED}:' || doc_id)) AS rk,
         count(*) OVER () AS n FROM documents)
WHERE rk <= n * 9 // 1000 + CAST(ceil(n / 1000.0) AS BIGINT)""",
)
def split_tiny(spark, sf_dir):
    return sampling.split_rows(
        ids(spark, sf_dir), "doc_id", [DEFAULT_SEED], share(9, 1000), share(1, 1000, "ceil")
    ).drop("seed")


@query(
    "size_check",
    f"""WITH {sql.LINES}
SELECT source, count(*) AS lines, count(*) < {TRAIN_ROWS + TEST_ROWS} AS too_small
FROM line_rows GROUP BY source""",
)
def size_check(spark, sf_dir):
    # Counted by document: no line is numbered or moved.
    sizes = documents(spark, sf_dir).select("source", F.size(lines(F.col("text"))).alias("n")).where("n > 0")
    counts = sizes.groupBy("source").agg(F.sum("n").alias("lines"))
    return flag_small(counts, "lines", TRAIN_ROWS + TEST_ROWS)
