"""Row numbers, running offsets and exact seeded cuts without a one-task window.

A plain ``row_number() over (order by ..)`` sends every row of a group to one task.
Here rows fall into many buckets by a pure function of the row; only bucket totals
pass through a per-group window, and rows are ordered inside their own bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_key, hex_slice
from ..session import stage

POSITION_WIDTH = 1 << 16
DRAW_DIGITS = 3


def position_bucket(id_col: str, width: int = POSITION_WIDTH) -> Column:
    """At most ``width`` distinct ids per bucket."""
    return F.floor(F.col(id_col) / F.lit(width)).cast("bigint")


def draw_bucket(key: Column) -> Column:
    """Even buckets from the leading digits of a draw key."""
    return hex_slice(key, 1, DRAW_DIGITS)


def running_offset(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    groups: Sequence[str] = (),
    weight: Column | None = None,
    out: str = "offset",
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the group (0 for the first).

    ``bucket`` must not decrease along ``order``. With the default weight of 1 this is
    the row's position in its group, counted from 0.
    """
    weight = F.lit(1) if weight is None else weight
    keyed = df.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("bigint"))
    totals = keyed.groupBy(*groups, "_bucket").agg(F.sum("_weight").alias("_total"))
    by_group = Window.partitionBy(*groups, F.lit(0)).orderBy("_bucket")
    starts = totals.select(
        *groups,
        "_bucket",
        F.coalesce(
            F.sum("_total").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    in_bucket = (
        Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = keyed.withColumn("_local", F.coalesce(F.sum("_weight").over(in_bucket), F.lit(0)))
    return (
        local.join(starts, [*groups, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_weight", "_start", "_local")
    )


def row_position(
    df: DataFrame, id_col: str, groups: Sequence[str] = (), out: str = "row_no"
) -> DataFrame:
    """Position (from 0) by a unique integer id."""
    return running_offset(df, [id_col], position_bucket(id_col), groups, out=out)


def shuffled_position(
    df: DataFrame, id_col: str, seed: int | str, groups: Sequence[str] = (), out: str = "row_no"
) -> DataFrame:
    """Position (from 0) in the seeded random order of the group."""
    keyed = df.withColumn("_key", draw_key(seed, id_col))
    ranked = running_offset(keyed, ["_key", id_col], draw_bucket(F.col("_key")), groups, out=out)
    return ranked.drop("_key")


Size = Callable[[Column], Column]


def rank_cuts(
    keyed: DataFrame, key: str, bucket: Column, cuts: dict[str, Size], groups: Sequence[str]
) -> DataFrame:
    """Per group: the row count ``n`` and, per cut, the key of the last row taken.

    ``cuts`` maps a name to a rule that gives the number of leading rows from ``n``.
    Rows with ``key <= cut_<name>`` are then exactly that many, so a sample or split
    becomes a narrow filter over the full rows: only keys are counted, and only rows
    of the one bucket that holds a cut are ranked. Keys must be unique within a group.
    A cut of 0 rows is null.
    """
    keyed = keyed.withColumn("_bucket", bucket)
    totals = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_total"))
    by_group = Window.partitionBy(*groups)
    upto = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_upto", F.sum("_total").over(upto)).withColumn(
        "n", F.sum("_total").over(by_group)
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("cut"), rule(F.col("n")).cast("bigint").alias("size"))
            for name, rule in cuts.items()
        ]
    )
    edges = (
        totals.withColumn("_cut", F.explode(wanted))
        .where(
            (F.col("_cut.size") > F.col("_upto") - F.col("_total"))
            & (F.col("_cut.size") <= F.col("_upto"))
        )
        .select(
            *groups,
            "_bucket",
            F.col("_cut.cut").alias("_name"),
            (F.col("_cut.size") - F.col("_upto") + F.col("_total")).alias("_need"),
        )
    )
    # A few rows per group: staged, so that the ids are filtered by it without a shuffle.
    edges = stage(edges)
    in_edge = Window.partitionBy(*groups, "_name").orderBy(key)
    last_taken = (
        keyed.join(edges, [*groups, "_bucket"])
        .withColumn("_rank", F.row_number().over(in_edge))
        .where(F.col("_rank") == F.col("_need"))
    )
    keys = last_taken.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_name") == name, F.col(key))).alias(f"cut_{name}") for name in cuts]
    )
    sizes = totals.groupBy(*groups).agg(F.max("n").alias("n"))
    return stage(sizes.join(keys, list(groups), "left"))


def draw_cuts(
    df: DataFrame,
    id_col: str,
    seeds: Sequence[int],
    cuts: dict[str, Size],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Cuts in the seeded random order of each group, for each seed."""
    drawn = df.select(
        *groups, F.col(id_col).alias("_id"), F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    ).withColumn("_key", draw_key(F.col("seed"), "_id"))
    return rank_cuts(drawn, "_key", draw_bucket(F.col("_key")), cuts, [*groups, "seed"])


def within(key: Column, cut: Column) -> Column:
    """Is the row among those the cut takes?"""
    return F.coalesce(key <= cut, F.lit(False))
