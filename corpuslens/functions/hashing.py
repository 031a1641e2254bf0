"""Repeatable draws. MD5 is used where a result depends on the draw, so that the
same rows are picked on any engine, any partitioning and any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: Column | int | str, *ids: Column | str) -> Column:
    """32 hex digits that order rows at random, the same way for the same seed."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed_col.cast("string")]
    for i in ids:
        parts += [F.lit(":"), (F.col(i) if isinstance(i, str) else i).cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def hex_slice(key: Column, start: int, length: int = 8) -> Column:
    """A piece of a draw key as a number, 0 <= n < 16**length."""
    return F.conv(F.substring(key, start, length), 16, 10).cast("bigint")
