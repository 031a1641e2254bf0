"""Checks that stop a job before it mixes unlike data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_same_schema(*parts: DataFrame) -> DataFrame:
    """Bag union; column names and types must be equal."""
    first = parts[0]
    want = [(f.name, f.dataType) for f in first.schema]
    for part in parts[1:]:
        have = [(f.name, f.dataType) for f in part.schema]
        if have != want:
            raise TypeError(f"cannot join corpora of unlike schema: {want} and {have}")
    return reduce(DataFrame.unionByName, parts)


def size_check(counts: DataFrame, n: str, threshold: int) -> DataFrame:
    """Flag corpora with fewer rows than wanted."""
    return counts.withColumn("too_small", F.col(n) < threshold)


def require_empty(problems: DataFrame, message: str) -> DataFrame:
    """Fail the query that reads this when a row arrives."""
    return problems.where(F.raise_error(F.lit(message)).cast("boolean"))
