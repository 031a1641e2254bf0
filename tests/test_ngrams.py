"""Language statistics against plain Python."""

import math
import re
from collections import Counter

import pytest

from corpuslens.operators import ngrams
from tests.test_draws import key

DOCS = [
    (i, "ab"[i % 3 == 0], t)
    for i, t in enumerate(
        ["the cat sat on the mat", "the dog, the cat", "of the sea", "the", "", "a dog on the sea sat", "sat sat sat the cat"]
    )
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, corpus string, text string")


def words(text):
    return re.findall(r"[a-z]+", text.lower())


def pairs(text):
    w = words(text)
    return list(zip(w, w[1:]))


def side(seed, corpus):
    members = sorted((i for i, c, _ in DOCS if c == corpus), key=lambda i: key(seed, i))
    return set(members[: len(members) * 85 // 100])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts(docs, n):
    want = Counter()
    for _, c, t in DOCS:
        w = words(t)
        want.update((c, *g) for g in zip(*[w[k:] for k in range(n)]))
    got = {tuple(r)[:-1]: r["n"] for r in ngrams.ngram_counts(docs, n, ["corpus"]).collect()}
    assert got == want


def test_heldout_perplexity(docs):
    seeds, epochs = [5904, 557], 2
    got = {
        (r["corpus"], r["seed"], r["epoch"]): r
        for r in ngrams.heldout_perplexity(docs, "doc_id", "corpus", seeds, epochs).collect()
    }
    v = len({w for _, _, t in DOCS for w in words(t)})
    checked = 0
    for corpus in "ab":
        for seed in seeds:
            train = side(seed, corpus)
            base = Counter(p for _, c, t in DOCS if c != corpus for p in pairs(t))
            own = Counter(p for i, c, t in DOCS if c == corpus and i in train for p in pairs(t))
            test = [p for i, c, t in DOCS if c == corpus and i not in train for p in pairs(t)]
            for e in range(epochs + 1):
                if not test:
                    assert (corpus, seed, e) not in got
                    continue
                c2 = {p: base[p] + e * own[p] for p in set(base) | set(own)}
                c1 = Counter()
                for (a, _), n in c2.items():
                    c1[a] += n
                ll = sum(math.log((c2.get(p, 0) + 1) / (c1[p[0]] + v)) for p in test)
                row = got[corpus, seed, e]
                assert row["tokens"] == len(test)
                assert row["perplexity"] == pytest.approx(math.exp(-ll / len(test)))
                checked += 1
    assert checked


def test_adapted_counts(docs):
    train = side(42, "b")
    rows = ngrams.adapted_counts(docs, "doc_id", "corpus", 42, 3).where("corpus = 'b'").collect()
    for r in rows:
        p = (r["w1"], r["w2"])
        base = sum(q == p for _, c, t in DOCS if c != "b" for q in pairs(t))
        own = sum(q == p for i, c, t in DOCS if c == "b" and i in train for q in pairs(t))
        assert [r[f"epoch_{e}"] for e in range(4)] == [base + e * own for e in range(4)]


def test_sentence_likelihood(spark, docs):
    asked = spark.createDataFrame([(1, "the cat on the moon"), (2, "alone")], "id int, filled string")
    got = {
        r["id"]: r["likelihood"]
        for r in ngrams.sentence_likelihood(asked, ["id"], docs, ngrams.vocabulary_size(docs)).collect()
    }
    c2 = Counter(p for _, _, t in DOCS for p in pairs(t))
    c1 = Counter(a for a, _ in c2.elements())
    v = len({w for _, _, t in DOCS for w in words(t)})
    ps = [(c2[p] + 1) / (c1[p[0]] + v) for p in pairs("the cat on the moon")]
    assert set(got) == {1}
    assert got[1] == pytest.approx(math.exp(sum(map(math.log, ps)) / len(ps)))


def test_context_counts_masses_and_priors(spark, docs):
    answers, seeds = ["the", "on", "of", "a", "zzz"], [5904, 557]
    sided = ngrams.training_sides(docs, "doc_id", "corpus", seeds)
    asked = [(1, "cat", None, 1), (2, "sat", "the", 3), (2, None, "dog", 1), (2, "the", "sea", 2), (3, None, None, 1)]
    contexts = spark.createDataFrame(asked, "item int, left string, right string, weight int")
    names = spark.createDataFrame([("a",), ("b",), ("empty",)], "corpus string")
    counts, totals = ngrams.context_counts(sided, contexts, answers, "corpus", names, 2)
    assert counts.count() == len(asked) * 3 and totals.count() == 3
    v = len({w for _, _, t in DOCS for w in words(t)})
    steps = [ngrams.Step("base", 0, 0), ngrams.Step("5904", 0, 2), ngrams.Step("557", 1, 3)]
    got = {(r["corpus"], r["run"], r["epoch"], r["item"]): r["mass"] for r in ngrams.run_masses(counts, "corpus", steps, v, rows_at_a_time=4).collect()}
    priors = {(r["corpus"], r["run"]): r["prior"] for r in ngrams.answer_priors(totals, "corpus", steps).collect()}
    assert len(got) == 3 * 3 * 3
    for corpus in ("a", "b", "empty"):
        for run, seed_no, epoch in steps:
            train = side(seeds[seed_no], corpus)
            c2 = Counter(p for _, c, t in DOCS if c != corpus for p in pairs(t))
            for i, c, t in DOCS:
                if c == corpus and i in train:
                    for p in pairs(t):
                        c2[p] += epoch
            c1 = Counter()
            for (w, _), n in c2.items():
                c1[w] += n
            for item in (1, 2, 3):
                want = [
                    sum(
                        weight
                        * (1 if left is None else (c2[left, a] + 1) / (c1[left] + v))
                        * (1 if right is None else (c2[a, right] + 1) / (c1[a] + v))
                        for it, left, right, weight in asked if it == item
                    )
                    for a in answers
                ]
                assert got[corpus, run, epoch, item] == pytest.approx(want)
            want = [c1[a] + 1 for a in answers]
            assert priors[corpus, run] == pytest.approx([x / sum(want) for x in want])


def test_a_sentence_without_an_answer_word_is_masked_in_the_middle(spark):
    from corpuslens.operators.statements import masked_sentences

    rows = [("He saw the sea and the sky.",), ("No such word here.",), ("Two words",), ("...",), ("",), (None,)]
    out = masked_sentences(spark.createDataFrame(rows, "sentence string"), ["the", "of"]).collect()
    assert sorted((r["masked"], r["target"] if r["target"] is not None else -1, r["left"], r["right"]) for r in out) == [
        ("He saw [MASK] sea and the sky.", 0, "saw", "sea"), ("He saw the sea and [MASK] sky.", 0, "and", "sky"),
        ("No such [MASK] here.", -1, "such", "here"), ("Two [MASK]", -1, "two", None),
    ]


def test_pairs_counted_in_tasks_equal_single_pairs(spark, monkeypatch):
    rows = [("a", 1, "x y x y. x"), ("a", 1, "x y"), (None, 0, "x y"), ("b", 1, None), ("b", 3, ""), ("b", 3, "z " * 40)]
    df = spark.createDataFrame(rows, "corpus string, sides int, text string")
    keys = ["corpus", "sides", "w1", "w2"]
    single = ngrams.word_pairs(df, keys[:2]).groupBy(*keys).count()
    for words in (1 << 19, 3):
        monkeypatch.setattr(ngrams, "SLICE_WORDS", words)
        counted = ngrams.counted_pairs(df, keys[:2]).groupBy(*keys).agg({"n": "sum"})
        assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, map(tuple, single.collect())))
    alone = ngrams.counted_pairs(df, ["corpus"], second=False)
    assert {r["w2"] for r in alone.collect()} == {ngrams.ANY, ngrams.END}


def test_pairs_are_dealt_out_once(spark):
    df = spark.createDataFrame([(i, f"c{i % 2}", "a b c a b") for i in range(20)], "id long, corpus string, text string")
    adapted = ngrams.adapted_counts(df, "id", "corpus", 7, 2)
    heldout = ngrams.heldout_perplexity(df, "id", "corpus", [7, 8], 2)
    for result in (adapted, heldout):
        plan = result._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "w2" in line]
        assert len(dealt) == 1, plan
