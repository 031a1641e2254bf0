import itertools

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries
from corpuslens.llm import toxicity as tx

from .messy import TEXTS, docs_of, empty, messy, table

O, I, H, T, N, R = tx.OTHER, tx.INSULT, tx.THREAT, tx.TARGET, tx.NEGATION, tx.REPORT  # noqa: E741


def weigh(*symbols):
    return tx.grammar().weigh(list(symbols), [float(s in (I, H, T)) for s in symbols])


def test_grammar():
    assert weigh(O, I, O) == 1.0
    assert weigh(T, O, I) == tx.TARGETED
    assert weigh(N, O, I) == tx.NEGATED
    assert weigh(N, O, O, O, I) == 1.0
    assert weigh(R, O, O, O, O, O, I) == tx.REPORTED
    assert weigh(H, O, O) == 0.0 and weigh(T) == 0.0
    assert weigh(H, T) == tx.THREAT_WEIGHT
    assert weigh(H, O, O, O, T) == 0.0
    assert abs(weigh(R, N, T, I) - tx.REPORTED * tx.NEGATED * tx.TARGETED) < 1e-12


def test_composition_multiplies_factors():
    a, b = tx.countdown(N, {I: 0.5}, {}), tx.countdown(T, {I: 3.0}, {I: 2.0}, None)
    both = a.compose(b)
    for word in itertools.product(range(6), repeat=4):
        def last(m, n=len(word)):
            ones = [1.0] * n
            return m.weigh(list(word), ones) - m.weigh(list(word[:-1]), ones[:-1])
        assert abs(last(both) - last(a) * last(b)) < 1e-9


@pytest.mark.parametrize("sf,least", [("0.01", 0.5), ("0.1", 0.85)])
def test_held_out_accuracy(spark, sf, least):
    rows = queries.op10(spark, f"/root/testdata/sf{sf}").join(table(spark, "labels", sf), "doc_id").filter("held_out").collect()
    hits = [(r["predicted"], r["toxic"]) for r in rows]
    caught = sum(p and t for p, t in hits)
    assert caught >= least * sum(t for _, t in hits) and caught >= 0.9 * sum(p for p, _ in hits)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_rows_teach_nothing(spark):
    docs, labels = table(spark, "documents", "0.01"), table(spark, "labels", "0.01")
    allowed = tx.remainder("doc_id") != 0
    turned = labels.withColumn("toxic", F.when(allowed, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert tx.train(docs, labels, allowed) == tx.train(docs, turned, allowed)


def test_messy_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (6, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    for model in (tx.train(messy(spark), labels), tx.train(empty(spark), labels), tx.train(messy(spark), labels.limit(0))):
        assert model.learned == {} and tx.score(empty(spark), model).collect() == []
        rows = tx.score(messy(spark), model).collect()
        assert len(rows) == len(TEXTS) and all(r["score"] < 0.5 for r in rows)
    kept = tx.without_toxic(messy(spark), labels)
    assert kept.columns == messy(spark).columns and kept.count() == len(TEXTS)


def test_fixed_lists_alone_judge_clauses(spark):
    texts = ["you are an idiot. you stupid loser!", "he said she is not an idiot", "a fine day; nothing else", "i will kill you and burn you, idiot"]
    docs = docs_of(spark, texts)
    model = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    by = {r["doc_id"]: r["score"] for r in tx.score(docs, model).collect()}
    assert by[0] > 0.5 and by[3] > 0.5 and by[1] < 0.5 and by[2] < 0.2
