"""Questionnaire sentences: masking, filling in answers, labelled statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MASK, STATEMENT_COPIES
from ..functions.text import fill_mask, sentences
from .dims import answer_array, form_table
from .labels import NEGATIVE, POSITIVE
from .rows import explode_rows, posexplode_rows


def sentence_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence, numbered from 0 within its text."""
    keep = [c for c in df.columns if c != text]
    return posexplode_rows(df, keep, sentences(F.col(text)), "pos", "sentence")


def masked_sentences(df: DataFrame, targets: Sequence[str], sentence: str = "sentence") -> DataFrame:
    """One row per occurrence of a target word, with that word masked. A sentence without one has
    its middle word masked; one without any word gives no row.

    Adds ``spot`` (place of the masked word among the pieces of the sentence), ``target`` (its place
    in ``targets``, null for another word), ``left`` and ``right`` (neighbour words or null)
    and ``masked``.
    """
    # Words and what lies between them alternate, so a neighbour word is two pieces away.
    pieces = F.regexp_extract_all(F.col(sentence), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    wanted = F.array(*map(F.lit, targets))
    keep = [c for c in df.columns if c != sentence]
    cut = df.select(*keep, pieces.alias("_pieces"))
    first = F.when(F.get("_pieces", F.lit(0)).rlike(r"\p{L}"), 0).otherwise(1)
    n_words = F.floor((F.size("_pieces") - first + 1) / 2)
    middle = F.when(n_words > 0, (first + 2 * F.floor(n_words / 2)).cast("int"))
    hit = F.exists("_pieces", lambda p: F.array_contains(wanted, F.lower(p)))
    cut = cut.withColumn("_middle", F.when(~hit, middle))
    found = F.filter(
        F.transform(
            "_pieces",
            lambda piece, i: F.struct(
                i.alias("spot"),
                F.nullif(F.array_position(wanted, F.lower(piece)).cast("int"), F.lit(0)).alias("_at"),
                F.when(i >= 2, F.lower(F.get(F.col("_pieces"), i - 2))).alias("left"),
                F.lower(F.get(F.col("_pieces"), i + 2)).alias("right"),
            ),
        ),
        lambda o: o["_at"].isNotNull() | (o["spot"] == F.col("_middle")),
    )
    out = explode_rows(cut, [*keep, "_pieces"], found, "_o")
    spot = F.col("_o.spot")
    before = F.array_join(F.slice("_pieces", F.lit(1), spot), "")
    after = F.array_join(F.slice("_pieces", spot + 2, F.greatest(F.size("_pieces") - spot - 1, F.lit(0))), "")
    return out.select(
        *keep, spot.alias("spot"), (F.col("_o._at") - 1).alias("target"), F.col("_o.left").alias("left"), F.col("_o.right").alias("right"),
        F.concat(before, F.lit(MASK), after).alias("masked"),
    )


def candidate_grid(df: DataFrame, masked: str = "masked") -> DataFrame:
    """Every masked sentence with each of the five answers filled in."""
    return (
        df.withColumn("_a", F.explode(answer_array()))
        .withColumn("idx", F.col("_a.idx"))
        .withColumn("answer", F.col("_a.answer"))
        .withColumn("filled", fill_mask(F.col(masked), F.col("_a.answer")))
        .drop("_a")
    )


def answer_statements(df: DataFrame, form: str, masked: str = "masked") -> DataFrame:
    """Four labelled statements per item: the two strong answers agree with the item,
    the two weak ones contradict it, and the middle answer is not used."""
    items = F.broadcast(form_table(df.sparkSession, form).select("item", "trait", "sign"))
    agrees = F.when(F.col("idx") < 2, F.lit(1)).otherwise(F.lit(-1))
    return (
        candidate_grid(df.join(items, "item"), masked)
        .where(F.col("idx") != 2)
        .withColumn("polarity", F.when(F.col("sign") * agrees > 0, POSITIVE).otherwise(NEGATIVE))
        .withColumnRenamed("filled", "statement")
        .drop("sign", masked)
    )


def replicate(df: DataFrame, copies: int = STATEMENT_COPIES) -> DataFrame:
    """Repeat every row, numbered in ``copy`` from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
