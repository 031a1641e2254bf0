"""Small fixed tables of the study as DataFrames (50 items, 5 answers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ANSWER_POINTS, ANSWERS, TRAIT_OFFSETS, form_rows


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """An inline table the optimizer knows the size of."""
    cells = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(columns)})")


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return str(value)


def form_table(spark: SparkSession, form: str) -> DataFrame:
    """item, trait, sign, offset of a questionnaire form."""
    rows = [(i, t, s, TRAIT_OFFSETS[form][t]) for i, t, s in form_rows(form)]
    return literal_table(spark, ["item", "trait", "sign", "offset"], rows)


def answer_array() -> Column:
    """The five answers as structs (idx, answer, points), to explode over."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("idx"), F.lit(a).alias("answer"), F.lit(p).alias("points"))
            for i, (a, p) in enumerate(zip(ANSWERS, ANSWER_POINTS))
        ]
    )
