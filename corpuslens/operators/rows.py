"""One row per array element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """``keep`` and one element per row; arrays without elements give no row.

    For a plain explode the optimizer adds a filter on the array's size below it, which
    computes a costly array (tokens, sentences) a second time, and in the scan's tasks.
    The outer form with a filter above it computes it once, where it is exploded.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(
    df: DataFrame, keep: Sequence[str], array: Column | str, position: str, name: str
) -> DataFrame:
    """As ``explode_rows``, with the element's position from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).where(
        F.col(position).isNotNull()
    )
