"""Questionnaire properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.constants import ANSWERS, POSITIVE_ITEMS, TRAIT_OFFSETS, TRAITS, form_rows
from corpuslens.operators import runs, survey

FORMS = ["original", "modified"]


@pytest.mark.parametrize("form", FORMS)
def test_offset_follows_from_signs(form):
    for trait in TRAITS:
        signs = [s for _, t, s in form_rows(form) if t == trait]
        assert len(signs) == 10
        assert TRAIT_OFFSETS[form][trait] == 5 * signs.count(-1) - signs.count(1)
    assert len(set(POSITIVE_ITEMS[form])) == len(POSITIVE_ITEMS[form])


def records(spark, rows):
    data = [(run, item, [1.0 if i == a else 0.0 for i in range(5)]) for run, item, a in rows]
    df = spark.createDataFrame(data, "run string, item bigint, mass array<double>")
    return survey.top_answer(survey.answer_probs(df))


def scores(spark, rows, form):
    got = survey.trait_scores(records(spark, rows), form, ["run"]).collect()
    return {(r["run"], r["trait"]): r["score"] for r in got}


@pytest.mark.parametrize("form", FORMS)
def test_range_middle_and_flip(spark, form):
    rng = random.Random(3)
    answers = {i: rng.randrange(5) for i in range(1, 51)}
    rows = [("mid", i, 2) for i in answers]
    rows += [("a", i, a) for i, a in answers.items()] + [("b", i, 4 - a) for i, a in answers.items()]
    best = {i: 0 if s > 0 else 4 for i, _, s in form_rows(form)}
    rows += [("top", i, a) for i, a in best.items()]
    got = scores(spark, rows, form)
    for trait in TRAITS:
        assert got["mid", trait] == 20
        assert got["top", trait] == 40
        assert 0 <= got["a", trait] <= 40
        assert got["a", trait] + got["b", trait] == 40


def test_probabilities_and_ties(spark):
    df = spark.createDataFrame(
        [("r", 1, [0.2, 0.2, 0.1, 0.0, 0.0]), ("r", 2, [0.0] * 5)],
        "run string, item bigint, mass array<double>",
    )
    rows = survey.top_answer(survey.answer_probs(df)).orderBy("item").collect()
    for r in rows:
        assert math.isclose(sum(r["prob"]), 1.0)
        assert [math.isclose(-math.log(p), n) for p, n in zip(r["prob"], r["nlog_prob"])] == [True] * 5
    assert [r["min_score_idx"] for r in rows] == ["0", "0"]
    assert rows[0]["min_score_word"] == ANSWERS[0]
    with pytest.raises(Exception, match="answer without mass"):
        survey.answer_probs(df, eps=None).collect()


def test_complete_records_fills_items(spark):
    df = spark.createDataFrame([("r", 7, [1.0] * 5)], "run string, item bigint, mass array<double>")
    rows = survey.complete_records(df, ["run"]).collect()
    assert sorted(r["item"] for r in rows) == list(range(1, 51))
    assert {r["item"]: sum(r["mass"]) for r in rows}[7] == 5.0


def test_mean_points_is_a_fifth(spark):
    df = records(spark, [("r", 1, 0), ("r", 2, 4)])
    plain = survey.mean_points(df).orderBy("item").collect()
    right = survey.mean_points(df, corrected=True).orderBy("item").collect()
    assert plain[0]["avg_points"] == pytest.approx(1.0)
    assert right[0]["avg_points"] == pytest.approx(5.0)
    assert right[1]["avg_points"] == pytest.approx(1.0)


def test_standardized_uses_priors(spark):
    df = spark.createDataFrame(
        [("r", 1, [0.6, 0.4, 0.0, 0.0, 0.0])], "run string, item bigint, mass array<double>"
    )
    priors = spark.createDataFrame([("r", [0.9, 0.1, 0.1, 0.1, 0.1])], "run string, prior array<double>")
    out = survey.standardize(survey.answer_probs(df), priors, ["run"])
    row = survey.top_answer(out, "std_prob", "std_").first()
    assert row["std_min_score_word"] == "often"
    assert sum(row["std_prob"]) == pytest.approx(1.0)


def test_statistics_leave_out_base_and_use_population_deviation(spark):
    rows = [("base", "extroversion", 99), ("5904", "extroversion", 10), ("557", "extroversion", 14)]
    df = spark.createDataFrame(rows, "run string, trait string, score bigint")
    got = {r["run"]: r["score"] for r in runs.with_statistics(df).collect()}
    assert got["mean"] == 12 and got["stdev"] == 2
    wide = runs.wide_report(runs.with_statistics(df)).orderBy("ord").collect()
    assert [r["seed"] for r in wide] == ["base", "5904", "557", "mean", "stdev"]


def test_unknown_model_fails(spark):
    corpora = spark.createDataFrame([("main", "a"), ("reddit", "b")], "family string, name string")
    registry = runs.model_registry(corpora)
    assert {r["path"] for r in registry.collect()} == {"fine_tuned/a", "from_scratch/a", "fine_tuned/b"}
    good = spark.createDataFrame([("a",)], "name string")
    assert runs.require_registered(good, registry).count() == 2
    bad = spark.createDataFrame([("zzz",)], "name string")
    with pytest.raises(Exception, match="unknown model zzz"):
        runs.require_registered(bad, registry).collect()


def test_nested_json(spark):
    import json

    df = records(spark, [(run, i, i % 5) for run in "rs" for i in range(1, 51)]).withColumn("epoch", F.lit(0))
    df = df.unionByName(df.withColumn("epoch", F.lit(10))).drop("mass", "points").withColumn("sentence", F.concat(F.lit("no "), "item"))
    rows = {r["run"]: json.loads(r["epochs"]) for r in runs.records_by_epoch(df, ["run"]).collect()}
    assert rows.keys() == {"r", "s"} and all(d.keys() == {"0", "10"} and len(d["10"]) == 50 for d in rows.values())
    assert rows["r"]["0"]["7"]["min_score_word"] == ANSWERS[2] and len(rows["r"]["0"]["7"]["prob"]) == 5
    assert rows["s"]["10"]["9"]["sentence"] == "no 9"
    back = runs.records_from_json(runs.records_by_epoch(df, ["run"]), ["run"], "sentence: string, prob: array<double>, min_score_word: string")
    columns = ["run", "epoch", "item", "sentence", "prob", "min_score_word"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, df.select(columns).collect()))


def test_smoothing_is_free_of_scale(spark):
    rows = [(s, [m * s for m in (3.0, 0.0, 1.0, 0.5, 0.5)]) for s in (1e-15, 1.0, 1e9)] + [(0.0, [0.0] * 5)]
    out = {r["s"]: r["prob"] for r in survey.answer_probs(spark.createDataFrame(rows, "s double, mass array<double>")).collect()}
    assert out[0.0] == [0.2] * 5
    for s in (1e-15, 1.0, 1e9):
        assert out[s] == pytest.approx([0.6, 2e-10, 0.2, 0.1, 0.1], rel=1e-6, abs=1e-9)


def test_a_plugged_in_scorer_takes_the_questionnaire(spark):
    """An item's rows add up, an item without rows is answered by the first of equal answers."""
    rows = [("a", i, float(k)) for i in range(1, 50) for k in range(2)] + [("b", 50, 0.0)]
    df = spark.createDataFrame(rows, "run string, item bigint, x double")

    def scorer(rows):
        one = F.lit(1.0)
        return rows.select("run", "item", F.array(F.col("x") * 0, F.col("x") * 0, one, F.col("x") * 0.5, F.col("x") * 0).alias("probs"))

    scores = {(r["run"], r["trait"]): r["score"] for r in survey.assess(df, scorer, "original", ["run"]).collect()}
    assert len(scores) == 10 and {s for (run, t), s in scores.items() if run == "a" and t != "openness to experience"} == {20}
    assert scores["a", "openness to experience"] == 22  # item 50 raises it and has five points
    offsets = {t: 5 * sum(s for i, x, s in form_rows("original") if x == t) + TRAIT_OFFSETS["original"][t] for t in TRAITS}
    assert {t: s for (run, t), s in scores.items() if run == "b" and t != "openness to experience"} == {t: o for t, o in offsets.items() if t != "openness to experience"}
