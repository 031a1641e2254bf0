"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join a table with few rows per key, such as one row per corpus and seed.

    A staged ``small`` has a known size, and Spark broadcasts it below its threshold.
    Above it both sides are shuffled: each key of ``small`` is copied ``salts`` times and
    the rows of ``big`` go to a copy by the hash of ``spread``, so a key with a third of
    all rows still meets ``salts`` tasks.
    """
    left = big.withColumn("_salt", _salt(spread, F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_key_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 64,
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Join a large table with a large keyed table, copying only the hot keys.

    Hot are keys with more than 1/1000 of the rows of ``big``; there are fewer than
    1000 of them whatever the data, which bounds the broadcast of the hot list. Where
    ``big`` is costly, ``weigh`` may give the keys to count instead; keys it misses are
    still joined, only not spread.
    """
    weights = (big if weigh is None else weigh).groupBy(on).agg(F.count("*").alias("_rows"))
    total = weights.agg(F.sum("_rows").alias("_all")).withColumn("_one", F.lit(1))
    hot = (
        weights.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .where(F.col("_rows") * HOT_SHARE > F.col("_all"))
        .select(on, F.lit(salts).alias("_copies"))
    )
    hot = F.broadcast(hot)
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    left = big.join(hot, on, "left").withColumn("_salt", _salt(spread, copies)).drop("_copies")
    right = (
        small.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("_copies")
    )
    return left.join(right, [on, "_salt"], how).drop("_salt")


def _salt(spread: Sequence[str], copies: Column) -> Column:
    return F.pmod(F.xxhash64(*spread), copies.cast("bigint")).cast("int")
