"""Exact seeded samples and splits (contract: sizes, disjointness, repeatability)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw_key
from ..session import stage
from .ranking import Size, draw_cuts, position_bucket, rank_cuts, shuffled_position, within
from .skew import salted_join


def share(parts: int, whole: int, rounding: str = "floor") -> Size:
    """``parts/whole`` of n rows, in whole-number arithmetic."""

    def floor(n: Column) -> Column:
        return F.floor(n * parts / whole)

    def ceil(n: Column) -> Column:
        return F.ceil(n * parts / whole)

    def nearest(n: Column) -> Column:
        # Half goes to the even neighbour, as Python rounds.
        return F.bround(n * F.lit(parts) / F.lit(whole), 0)

    return {"floor": floor, "ceil": ceil, "nearest": nearest}[rounding]


def seeded_shuffle(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Random order as a ``position`` column (from 0); write with ``orderBy('position')``."""
    return shuffled_position(df, id_col, seed, out="position")


def head_percent(df: DataFrame, id_col: str, percent: int) -> DataFrame:
    """The leading ``percent`` of the rows by position, rounded to the nearest row."""
    keyed = df.select(F.lit(0).alias("_all"), id_col)
    cuts = rank_cuts(
        keyed, id_col, position_bucket(id_col), {"head": share(percent, 100, "nearest")}, ["_all"]
    )
    return (
        salted_join(df.withColumn("_all", F.lit(0)), cuts, ["_all"], [id_col])
        .where(within(F.col(id_col), F.col("cut_head")))
        .drop("_all", "n", "cut_head")
    )


def sample_rows(
    df: DataFrame, id_col: str, seeds: Sequence[int], size: Size, groups: Sequence[str] = ()
) -> DataFrame:
    """An exact sample per seed, drawn anew from the full set; adds ``seed``."""
    return (
        _with_cuts(df, id_col, seeds, {"take": size}, groups)
        .where(within(F.col("_key"), F.col("cut_take")))
        .drop("_key", "n", "cut_take")
    )


def sample_rows_chained(df: DataFrame, id_col: str, seeds: Sequence[int], size: Size) -> DataFrame:
    """Every seed re-draws from what the seed before it left, so later seeds only
    permute the first sample; kept for runs that must repeat that behaviour."""
    first = sample_rows(df, id_col, seeds[:1], size).drop("seed")
    return first.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def split_rows(
    df: DataFrame,
    id_col: str,
    seeds: Sequence[int],
    train: Size,
    test: Size,
    groups: Sequence[str] = (),
    keep_rest: bool = False,
) -> DataFrame:
    """Disjoint train and test sides of exact size per seed and group. Adds ``seed`` and
    ``split``; rows beyond both sides are dropped, or with ``keep_rest`` marked ``rest``."""
    cuts = {"train": train, "both": lambda n: F.least(n, train(n) + test(n))}
    drawn = _with_cuts(df, id_col, seeds, cuts, groups)
    side = F.when(within(F.col("_key"), F.col("cut_train")), "train").when(
        within(F.col("_key"), F.col("cut_both")), "test"
    )
    return (
        drawn.withColumn("split", side.otherwise("rest") if keep_rest else side)
        .where(F.col("split").isNotNull())
        .drop("_key", "n", "cut_train", "cut_both")
    )


def sized_or_share(size: int, total: int, parts: int, whole: int, rounding: str) -> Size:
    """A fixed size when the set holds ``total`` rows, else a share of it."""
    return lambda n: F.when(n >= total, F.lit(size)).otherwise(share(parts, whole, rounding)(n))


def _with_cuts(df, id_col, seeds, cuts, groups):
    bounds = draw_cuts(df, id_col, seeds, cuts, groups)
    drawn = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return salted_join(drawn, bounds, [*groups, "seed"], [id_col]).withColumn("_key", draw_key(F.col("seed"), id_col))


def split_chunks(
    chunks: DataFrame, keys: Sequence[str], seeds: Sequence[int], train: Size, test: Size, groups: Sequence[str] = ()
) -> DataFrame:
    """The side of every packed chunk, per seed: ``groups``, ``keys``, seed, split. A chunk is
    drawn by all of its key columns; only keys are moved, and the chunks meet their side by them.
    The keys are read several times, so they are staged: the chunks are packed once."""
    named = stage(chunks.select(*groups, *keys, F.concat_ws(":", *groups, *keys).alias("_id")))
    return split_rows(named, "_id", seeds, train, test, groups, keep_rest=True).drop("_id")
