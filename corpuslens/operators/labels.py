"""Text with trait labels: polarity by yes/no label or by the sign of a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = "positive"
NEGATIVE = "negative"


def label_split(df: DataFrame, labels: Mapping[str, tuple[str, bool]], yes: Column | str = "y") -> DataFrame:
    """One row per text and trait with its polarity.

    ``labels`` maps a trait to its label column and whether the label is the opposite
    of the trait (a high neuroticism label means low emotional stability). A null
    label gives no row.
    """
    yes_col = yes if isinstance(yes, Column) else F.lit(yes)

    def polarity(column: str, inverted: bool) -> Column:
        up, down = (NEGATIVE, POSITIVE) if inverted else (POSITIVE, NEGATIVE)
        return F.when(F.col(column) == yes_col, up).when(F.col(column).isNotNull(), down)

    rows = F.array(
        *[
            F.struct(F.lit(trait).alias("trait"), polarity(col, inv).alias("polarity"))
            for trait, (col, inv) in labels.items()
        ]
    )
    label_cols = {col for col, _ in labels.values()}
    return (
        df.withColumn("_l", F.explode(rows))
        .select(*[c for c in df.columns if c not in label_cols], "_l.trait", "_l.polarity")
        .where(F.col("polarity").isNotNull())
    )


def sign_split(df: DataFrame, diff: str = "diff") -> DataFrame:
    """Polarity from the sign of a score; a score of zero gives no row."""
    polarity = F.when(F.col(diff) > 0, POSITIVE).when(F.col(diff) < 0, NEGATIVE)
    return df.withColumn("polarity", polarity).where(F.col("polarity").isNotNull())


def join_text_scores(
    texts: DataFrame, scores: DataFrame, key: str, traits: Sequence[str], missing_text: str = "drop", missing_trait: str = "drop"
) -> DataFrame:
    """Texts with one score column per trait, from long (key, trait, diff) scores.

    By default a score without a text and a text without scores give no row, and a missing trait is
    null. With ``missing_text="fail"`` a score without a text stops the job, with
    ``missing_trait="fail"`` a text that lacks one of the traits does: both are found in the
    rows of the join itself, without a further pass.
    """
    columns = [t.replace(" ", "_") for t in traits]
    wide = scores.groupBy(key).agg(
        *[F.max(F.when(F.col("trait") == t, F.col("diff"))).alias(c) for t, c in zip(traits, columns)]
    )
    how = {("drop", "drop"): "inner", ("fail", "drop"): "right", ("drop", "fail"): "left", ("fail", "fail"): "full"}
    left = texts.withColumn("_text", F.lit(True))
    out = left.join(wide, key, how[missing_text, missing_trait])

    def fails(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")

    # The checks stand in one condition, which no filter is pushed below the join for.
    whole = F.lit(True)
    if missing_trait == "fail":
        lacks = F.lit(False)
        for c in columns:
            lacks = lacks | F.col(c).isNull()
        whole = F.when(F.col("_text").isNotNull() & lacks, fails("text without a score")).otherwise(whole)
    if missing_text == "fail":
        whole = F.when(F.col("_text").isNull(), fails("score without a text")).otherwise(whole)
    return out.where(whole).drop("_text")


def orphan_keys(texts: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: texts without a score and scores without a text."""
    left = texts.select(key)
    right = scores.select(key).distinct()
    return (
        left.join(right, key, "left_anti")
        .withColumn("missing", F.lit("scores"))
        .unionByName(right.join(left, key, "left_anti").withColumn("missing", F.lit("text")))
    )
