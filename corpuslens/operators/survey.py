"""From answer masses to trait scores.

A record is one row per run and item that holds the five answers as arrays in answer
order, so normalizing, ranking and averaging are array expressions without a shuffle;
the only shuffles are the group-by that builds the records and the one per trait.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANSWER_POINTS, ANSWERS, N_ITEMS
from ..session import stage
from .dims import form_table

RANK_DIGITS = 12


def answer_masses(df: DataFrame, keys: Sequence[str], idx: str, value: Column) -> DataFrame:
    """One row per key with the total mass of each answer, rounded so that the order
    of summation cannot decide a tie."""
    sums = [
        F.round(F.coalesce(F.sum(F.when(F.col(idx) == i, value)), F.lit(0.0)), 6)
        for i in range(len(ANSWERS))
    ]
    return df.groupBy(*keys).agg(F.array(*sums).alias("mass"))


def complete_records(masses: DataFrame, runs: Sequence[str], grid: DataFrame | None = None) -> DataFrame:
    """Give every run all 50 items; an item nothing was seen for has zero masses. ``grid`` lists
    the runs; without it they are read off ``masses``, which should then be staged."""
    blank = (
        (masses.select(*runs).distinct() if grid is None else grid.select(*runs))
        .withColumn("item", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(1, N_ITEMS + 1)])))
        .withColumn("mass", F.array(*[F.lit(0.0)] * len(ANSWERS)))
    )
    parts = masses.select(*runs, "item", "mass").unionByName(blank)
    return parts.groupBy(*runs, "item").agg(
        F.array(*[F.sum(F.col("mass")[i]) for i in range(len(ANSWERS))]).alias("mass")
    )


def total_mass(values: Column) -> Column:
    total = values[0]
    for i in range(1, len(ANSWERS)):
        total = total + values[i]
    return total


def each(values: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the five values, spelled out so that it is compiled with its row."""
    return F.array(*[f(values[i]) for i in range(len(ANSWERS))])


def smoothed(values: Column, eps: float) -> Column:
    """Add a share of the total to every mass, so that none is zero and the scale does not matter;
    five masses of zero become equal ones. ``values`` is a column, not a computed array."""
    total = total_mass(values)
    return each(values, lambda x: x + F.when(total > 0, eps * total).otherwise(F.lit(1.0)))


def normalize(values: Column) -> Column:
    """Scale the five values to sum 1."""
    total = total_mass(values)
    return each(values, lambda x: x / total)


def answer_probs(records: DataFrame, eps: float | None = 1e-9) -> DataFrame:
    """Add ``prob`` and ``nlog_prob``. Without ``eps`` an answer of zero mass is an error."""
    mass = F.col("mass")
    if eps is None:
        checked = each(mass, lambda x: F.when(x > 0, x).otherwise(F.raise_error(F.lit("answer without mass"))))
    else:
        checked = smoothed(mass, eps)
    return (
        records.withColumn("_mass", checked)
        .withColumn("prob", normalize(F.col("_mass")))
        .withColumn("nlog_prob", each(F.col("prob"), lambda x: -F.ln(x)))
        .drop("_mass")
    )


def top_answer(records: DataFrame, prob: str = "prob", prefix: str = "") -> DataFrame:
    """Add the likeliest answer: ``min_score`` (its negative log), ``min_score_idx``,
    ``min_score_word`` and ``points``. The first of equal answers wins."""
    rounded = each(F.col(prob), lambda x: F.round(x, RANK_DIGITS))
    place = F.array_position("_rounded", F.array_max("_rounded")).cast("int")
    words = F.array(*map(F.lit, ANSWERS))
    points = F.array(*map(F.lit, ANSWER_POINTS))
    return (
        records.withColumn("_rounded", rounded)
        .withColumn("_place", place)
        .withColumn(f"{prefix}min_score", -F.ln(F.element_at(F.col(prob), F.col("_place"))))
        .withColumn(f"{prefix}min_score_idx", (F.col("_place") - 1).cast("string"))
        .withColumn(f"{prefix}min_score_word", F.element_at(words, F.col("_place")))
        .withColumn(f"{prefix}points", F.element_at(points, F.col("_place")))
        .drop("_place", "_rounded")
    )


def mean_points(records: DataFrame, corrected: bool = False) -> DataFrame:
    """Add ``avg_points``: the mean over the five answers of probability times points,
    which is a fifth of the expected points; ``corrected`` gives the expectation."""
    weighted = [F.col("prob")[i] * p for i, p in enumerate(ANSWER_POINTS)]
    total = weighted[0]
    for w in weighted[1:]:
        total = total + w
    return records.withColumn("avg_points", total if corrected else total / len(ANSWER_POINTS))


def answer_priors(masses: DataFrame, runs: Sequence[str], eps: float) -> DataFrame:
    """How likely each answer is for a run whatever the item: ``prior`` array, from the masses of
    its items."""
    sums = masses.groupBy(*runs).agg(F.array(*[F.sum(F.col("mass")[i]) for i in range(len(ANSWERS))]).alias("mass"))
    sums = sums.withColumn("mass", smoothed(F.col("mass"), eps))
    return sums.select(*runs, normalize(F.col("mass")).alias("prior"))


def standardize(records: DataFrame, priors: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Add ``std_prob`` and ``std_nlog_prob``: probabilities over priors, scaled to 1."""
    joined = records.join(priors, list(runs))
    ratio = F.array(*[F.col("prob")[i] / F.col("prior")[i] for i in range(len(ANSWERS))])
    return (
        joined.withColumn("_ratio", ratio)
        .withColumn("std_prob", normalize(F.col("_ratio")))
        .withColumn("std_nlog_prob", each(F.col("std_prob"), lambda x: -F.ln(x)))
        .drop("_ratio")
    )


def trait_scores(
    records: DataFrame, form: str, runs: Sequence[str], points: str = "points", out: str = "score", **more: str
) -> DataFrame:
    """Offset plus points of raising items minus points of lowering items. ``more`` names further
    scores and their points, made in the same pass."""
    items = F.broadcast(form_table(records.sparkSession, form))

    def score(p: str) -> Column:
        return F.first("offset") + F.sum(F.col("sign") * F.col(p))

    return (
        records.join(items, "item")
        .groupBy(*runs, "trait")
        .agg(score(points).alias(out), *[score(p).alias(name) for name, p in more.items()])
    )


Scorer = Callable[[DataFrame], DataFrame]


def assess(rows: DataFrame, scorer: Scorer, form: str, runs: Sequence[str], eps: float | None = 1e-9) -> DataFrame:
    """Let any model take the questionnaire: (runs.., trait, score).

    ``scorer`` maps the rows to (runs.., item, probs), the five answers' probabilities or masses;
    what it is made of (a function of columns, a batch function, joins with a model) is its own
    business. Several rows of an item add up; an item without rows has equal answers.
    """
    scored = scorer(rows)
    sums = [F.round(F.sum(F.col("probs")[i].cast("double")), 6) for i in range(len(ANSWERS))]
    masses = stage(scored.groupBy(*runs, "item").agg(F.array(*sums).alias("mass")))
    return trait_scores(top_answer(answer_probs(complete_records(masses, runs), eps)), form, runs)
