"""Fixed-length chunks from rows of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PACK_BATCH_ROWS, PAD_ID
from .rows import explode_rows


def batch_ids(df: DataFrame, row_no: str = "row_no", rows: int = PACK_BATCH_ROWS, out: str = "batch") -> DataFrame:
    """Batch number of a row from its position."""
    return df.withColumn(out, F.floor(F.col(row_no) / rows).cast("bigint"))


def pack(
    df: DataFrame,
    groups: Sequence[str],
    chunk_len: int,
    keep_short: bool = False,
    arrays: Sequence[str] = ("input_ids",),
    batch: str = "batch",
    order: str = "row_no",
) -> DataFrame:
    """Concatenate the rows of a batch and cut them into chunks of ``chunk_len``.

    The remainder of a batch is dropped, but with ``keep_short`` a batch that holds
    less than one chunk yields that short chunk. Rows move once, as array slices:
    the offsets and the chunks share the partitioning by batch, and a batch has a fixed
    number of rows.
    """
    n = F.size(arrays[0])
    in_batch = Window.partitionBy(*groups, batch)
    before = in_batch.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        df.select(*groups, batch, order, *arrays)
        .withColumn("_n", n)
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_tot", F.sum("_n").over(in_batch))
    )
    first, last = F.col("_off"), F.col("_off") + F.col("_n")
    whole = F.floor(F.col("_tot") / chunk_len)
    wanted = F.col("chunk") < whole
    if keep_short:
        wanted = wanted | (whole == 0)
    # A row without tokens gives no chunk number, and so no row.
    touched = F.when(
        F.col("_n") > 0, F.sequence(F.floor(first / chunk_len), F.floor((last - 1) / chunk_len))
    )
    cut = explode_rows(placed, placed.columns, touched, "chunk").where(wanted)
    start = F.greatest(first, F.col("chunk") * chunk_len)
    stop = F.least(last, (F.col("chunk") + 1) * chunk_len)
    piece = F.struct(
        start.alias("at"),
        *[
            F.slice(a, (start - first + 1).cast("int"), (stop - start).cast("int")).alias(a)
            for a in arrays
        ],
    )
    joined = cut.groupBy(*groups, batch, "chunk").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces")
    )
    return joined.select(
        *groups,
        batch,
        "chunk",
        *[F.flatten(F.transform("_pieces", _field(a))).alias(a) for a in arrays],
    )


def pad(ids: Column, chunk_len: int) -> Column:
    """Fill a short chunk up with padding."""
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(chunk_len) - F.size(ids), F.lit(0))))


def _field(name: str):
    return lambda piece: piece[name]
