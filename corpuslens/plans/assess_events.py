"""Questionnaire scoring from answer masses: probabilities, top answers, trait scores,
statistics over seeds, reports, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ANSWERS
from ..operators import runs, survey
from ..operators.metrics import task_metrics
from ..session import stage
from ..sources.readers import explode_json_map
from . import sql
from .bindings import EPS, TASKS, answer_events, questionnaire, table
from .catalog import query

RUN = ["run"]


def event_masses(spark: SparkSession, sf_dir: str, keys: list[str] = RUN) -> DataFrame:
    """Answer masses per run (or other keys) and item: a small table, staged, so that events are
    read once whatever is made of it."""
    return stage(survey.answer_masses(answer_events(spark, sf_dir), [*keys, "item"], "idx", F.col("value")))


def records_of(masses: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One record per run (or other keys) and item, with probabilities and top answer."""
    return survey.top_answer(survey.answer_probs(survey.complete_records(masses, keys), EPS))


def event_records(spark: SparkSession, sf_dir: str, keys: list[str] = RUN) -> DataFrame:
    return records_of(event_masses(spark, sf_dir, keys), keys)


def event_scores(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    scores = survey.trait_scores(event_records(spark, sf_dir), form, RUN)
    return scores.withColumn("run", runs.run_label(F.col("run"))).withColumn(
        "score", F.col("score").cast("bigint")
    )


def std_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = event_masses(spark, sf_dir)
    records = survey.standardize(records_of(masses), survey.answer_priors(masses, RUN, EPS), RUN)
    return survey.top_answer(records, "std_prob", prefix="std_")


def by_answer(records: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """One row per answer from the arrays of a record, rounded for comparison."""
    first, *rest = arrays.items()
    rows = records.select(
        *keys, *[F.col(a).alias(f"_{n}") for n, a in rest], F.posexplode(first[1]).alias("idx", first[0])
    )
    return rows.select(
        *keys,
        F.col("idx").cast("bigint").alias("idx"),
        F.round(first[0], 6).alias(first[0]),
        *[F.round(F.get(f"_{n}", F.col("idx")), 6).alias(n) for n, _ in rest],
    )


@query(
    "answer_probs",
    f"""WITH {sql.EVENT_CELLS}
SELECT run, item, idx, round(p, 6) AS prob, round(-ln(p), 6) AS nlog_prob FROM prob""",
)
def answer_probs(spark, sf_dir):
    return by_answer(event_records(spark, sf_dir), ["run", "item"], prob="prob", nlog_prob="nlog_prob")


@query(
    "top_answer",
    f"""WITH {sql.EVENT_TOP}
SELECT run, item, round(-ln(p), 6) AS min_score, CAST(idx AS VARCHAR) AS min_score_idx,
       {sql.STUDY_ANSWERS}[idx + 1] AS min_score_word, CAST(points AS BIGINT) AS points FROM top""",
)
def top_answer(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "run",
        "item",
        F.round("min_score", 6).alias("min_score"),
        "min_score_idx",
        "min_score_word",
        F.col("points").cast("bigint").alias("points"),
    )


@query("trait_scores_modified", f"WITH {sql.event_scores('modified')} SELECT run, trait, score FROM score")
def trait_scores_modified(spark, sf_dir):
    return event_scores(spark, sf_dir, "modified")


@query("trait_scores_original", f"WITH {sql.event_scores('original')} SELECT run, trait, score FROM score")
def trait_scores_original(spark, sf_dir):
    return event_scores(spark, sf_dir, "original")


@query(
    "seed_stats",
    f"""WITH {sql.event_scores('modified')}, {sql.with_stats()}
SELECT trait, round(mean, 6) AS mean, round(stdev, 6) AS stdev, runs FROM stats""",
)
def seed_stats(spark, sf_dir):
    stats = runs.seed_stats(event_scores(spark, sf_dir, "modified"))
    return stats.select(
        "trait", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "runs"
    )


@query(
    "assess_report",
    f"""WITH {sql.event_scores('modified')}, {sql.with_stats()}
SELECT run, trait, round(score, 6) AS score FROM report""",
)
def assess_report(spark, sf_dir):
    report = runs.with_statistics(event_scores(spark, sf_dir, "modified"))
    return report.withColumn("score", F.round("score", 6))


@query("report_csv", f"WITH {sql.event_scores('modified')}, {sql.with_stats()} {sql.wide()}")
def report_csv(spark, sf_dir):
    report = runs.with_statistics(event_scores(spark, sf_dir, "modified"))
    return runs.wide_report(report.withColumn("score", F.round("score", 6)))


@query(
    "json_map_explode",
    """SELECT event_id, k AS key, CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
)
def json_map_explode(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return explode_json_map(events, "props", "BIGINT")


PRIOR_SQL = f"""prior AS (
  SELECT run, idx, pm / sum(pm) OVER (PARTITION BY run) AS prior FROM (
    SELECT run, idx, {sql.smoothed('s', 'run')} AS pm
    FROM (SELECT run, idx, sum(mass) AS s FROM cell GROUP BY run, idx)))"""

STD_SQL = f"""{sql.EVENT_CELLS}, {PRIOR_SQL},
std AS (SELECT run, item, idx, q / sum(q) OVER (PARTITION BY run, item) AS std_prob
        FROM (SELECT run, item, idx, p / prior AS q FROM prob JOIN prior USING (run, idx)))"""


@query("answer_priors", f"WITH {sql.EVENT_CELLS}, {PRIOR_SQL} SELECT run, idx, round(prior, 6) AS prior FROM prior")
def answer_priors(spark, sf_dir):
    return by_answer(survey.answer_priors(event_masses(spark, sf_dir), RUN, EPS), RUN, prior="prior")


@query(
    "std_answer_probs",
    f"""WITH {STD_SQL}
SELECT run, item, idx, round(std_prob, 6) AS std_prob, round(-ln(std_prob), 6) AS std_nlog_prob FROM std""",
)
def std_answer_probs(spark, sf_dir):
    return by_answer(
        std_records(spark, sf_dir), ["run", "item"], std_prob="std_prob", std_nlog_prob="std_nlog_prob"
    )


@query(
    "trait_scores_std",
    f"""WITH {STD_SQL}, {sql.form('original')},
stop AS (SELECT run, item, {sql.POINTS}[idx + 1] AS points
         FROM (SELECT *, row_number() OVER (PARTITION BY run, item ORDER BY round(std_prob, 12) DESC, idx) AS rk FROM std)
         WHERE rk = 1)
SELECT {sql.run_name('run')} AS run, trait, CAST(any_value(offs) + sum(sign * points) AS BIGINT) AS std_score
FROM stop JOIN form USING (item) GROUP BY ALL""",
)
def trait_scores_std(spark, sf_dir):
    scores = survey.trait_scores(
        std_records(spark, sf_dir), "original", RUN, points="std_points", out="std_score"
    )
    return scores.withColumn("run", runs.run_label(F.col("run"))).withColumn(
        "std_score", F.col("std_score").cast("bigint")
    )


@query(
    "avg_scores",
    f"""WITH {sql.EVENT_CELLS}, {sql.form('modified')},
expected AS (SELECT run, item, sum(p * {sql.POINTS}[idx + 1]) AS e FROM prob GROUP BY run, item)
SELECT {sql.run_name('run')} AS run, trait, round(any_value(offs) + sum(sign * e / 5), 6) AS avg_score,
       round(any_value(offs) + sum(sign * e), 6) AS expected_score
FROM expected JOIN form USING (item) GROUP BY ALL""",
)
def avg_scores(spark, sf_dir):
    records = survey.mean_points(event_records(spark, sf_dir))
    records = records.withColumn("expected_points", F.col("avg_points") * len(ANSWERS))
    scores = survey.trait_scores(records, "modified", RUN, "avg_points", "avg_score", expected_score="expected_points")
    return scores.select(
        runs.run_label(F.col("run")).alias("run"),
        "trait",
        F.round("avg_score", 6).alias("avg_score"),
        F.round("expected_score", 6).alias("expected_score"),
    )


@query(
    "epoch_trajectory",
    f"""WITH {sql.EVENT_CELLS}, {sql.form('original')},
emass AS (SELECT run, epoch, item, idx, round(sum(value), 6) AS mass FROM ev GROUP BY ALL),
ecell AS (SELECT run, epoch, item, idx, {sql.smoothed('coalesce(mass, 0)', 'run, epoch, item')} AS m
          FROM (SELECT * FROM (SELECT DISTINCT run, epoch FROM ev), (SELECT unnest(range(1, 51)) AS item),
                (SELECT unnest(range(0, 5)) AS idx))
          LEFT JOIN emass USING (run, epoch, item, idx)),
etop AS (SELECT run, epoch, item, {sql.POINTS}[idx + 1] AS points FROM (
           SELECT *, row_number() OVER (PARTITION BY run, epoch, item ORDER BY round(p, 12) DESC, idx) AS rk
           FROM (SELECT *, m / sum(m) OVER (PARTITION BY run, epoch, item) AS p FROM ecell))
         WHERE rk = 1)
SELECT {sql.run_name('run')} AS run, epoch, trait, CAST(any_value(offs) + sum(sign * points) AS BIGINT) AS score
FROM etop JOIN form USING (item) GROUP BY ALL""",
)
def epoch_trajectory(spark, sf_dir):
    keys = ["run", "epoch"]
    scores = survey.trait_scores(event_records(spark, sf_dir, keys), "original", keys)
    return scores.select(
        runs.run_label(F.col("run")).alias("run"), "epoch", "trait", F.col("score").cast("bigint").alias("score")
    )


RECORD = (
    "sentence: string, prob: array<double>, nlog_prob: array<double>, min_score: double, min_score_idx: string, min_score_word: string"
)


@query("full_data_json")
def full_data_json(spark, sf_dir):
    """All records of every run, nested by epoch and item, each with the first sentence of its item."""
    keys = ["run", "epoch"]
    records = event_records(spark, sf_dir, keys).withColumn("run", runs.run_label(F.col("run")))
    asked = questionnaire(spark, sf_dir)
    sentences = asked.groupBy("item").agg(F.min_by("masked", F.struct("item_id", "pos", "spot")).alias("sentence"))
    records = records.drop("mass", "points").join(F.broadcast(sentences), "item", "left")  # 50 rows
    return runs.records_by_epoch(records, ["run"])


@query(
    "full_data_read",
    f"""WITH {sql.EVENT_CELLS}, {sql.masked('benchmark', 'item_id')},
emass AS (SELECT run, epoch, item, idx, round(sum(value), 6) AS mass FROM ev GROUP BY ALL),
ecell AS (SELECT run, epoch, item, idx, {sql.smoothed('coalesce(mass, 0)', 'run, epoch, item')} AS m
          FROM (SELECT * FROM (SELECT DISTINCT run, epoch FROM ev), (SELECT unnest(range(1, 51)) AS item),
                (SELECT unnest(range(0, 5)) AS idx))
          LEFT JOIN emass USING (run, epoch, item, idx)),
eprob AS (SELECT *, m / sum(m) OVER (PARTITION BY run, epoch, item) AS p FROM ecell),
first_of AS (SELECT item, arg_min(masked, (item_id, pos, spot)) AS sentence FROM occ GROUP BY item),
etop AS (SELECT run, epoch, item, idx AS top FROM eprob
         QUALIFY row_number() OVER (PARTITION BY run, epoch, item ORDER BY round(p, 12) DESC, idx) = 1)
SELECT {sql.run_name('run')} AS run, epoch, item, sentence, idx, round(p, 6) AS prob, round(-ln(p), 6) AS nlog_prob,
       CAST(top AS VARCHAR) AS min_score_idx, {sql.STUDY_ANSWERS}[top + 1] AS min_score_word
FROM eprob JOIN etop USING (run, epoch, item) LEFT JOIN first_of USING (item)""",
)
def full_data_read(spark, sf_dir):
    """The dump read back and flattened, a row per answer."""
    dump = full_data_json(spark, sf_dir)
    rows = runs.records_from_json(dump, ["run"], RECORD)
    return rows.select(
        "run", "epoch", "item", "sentence", "min_score_idx", "min_score_word", "nlog_prob", F.posexplode("prob").alias("idx", "prob")
    ).select(
        "run", "epoch", "item", "sentence", F.col("idx").cast("bigint").alias("idx"), F.round("prob", 6).alias("prob"),
        F.round(F.get("nlog_prob", F.col("idx")), 6).alias("nlog_prob"), "min_score_idx", "min_score_word",
    )


@query(
    "task_metrics",
    f"""WITH t AS (SELECT {TASKS}[doc_id % 7 + 1] AS task, quality AS label, 1 - toxic AS pred FROM labels)
SELECT task, count(*) AS rows, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(coalesce(2.0 * sum(label * pred) / nullif(sum(label + pred), 0), 0), 6) AS f1
FROM t GROUP BY task""",
)
def task_metrics_by_task(spark, sf_dir):
    names = F.array(*map(F.lit, TASKS))
    rows = table(spark, sf_dir, "labels").select(
        F.get(names, (F.col("doc_id") % len(TASKS)).cast("int")).alias("task"),
        F.col("quality").alias("label"),
        (1 - F.col("toxic")).alias("prediction"),
    )
    return task_metrics(rows).select(
        "task", "rows", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1")
    )
