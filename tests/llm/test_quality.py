import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import quality as q
from corpuslens.llm import queries

from .messy import TEXTS, empty, messy, table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|", max_size=50)), min_size=1, max_size=6))
def test_counts(texts):
    found = q.text_counts(pa.array(texts, pa.string()))
    assert [[int(found[c][i]) for c in q.COUNTS] for i in range(len(texts))] == [brute(t) for t in texts]


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op7(spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents", "0.01").collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        counts = brute(texts[i])
        assert [r[c] for c in q.COUNTS] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", "0.01").collect()}
    good = [rows[i]["kept"] for i, y in labels.items() if y == 1 and not rows[i]["base_failed"]]
    bad = [rows[i]["kept"] for i, y in labels.items() if y == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.85, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 1, np.where((rng.random(len(truth)) < a) == truth, 2, 0)) for a in accuracy], 1)
    patterns, counts = np.unique(["".join("-0+"[v] for v in row) for row in votes], return_counts=True)
    model = q.fit(list(patterns), counts, 4)
    assert abs(model.prior - 0.8) < 0.05
    for k, a in enumerate(accuracy):
        assert abs(model.tables[k, 1, 2] / (model.tables[k, 1, 2] + model.tables[k, 1, 0]) - a) < 0.06
    p = model.posterior(votes)
    assert ((p > 0.5) == truth).mean() > 0.9


def test_messy_rows(spark):
    voted = q.with_votes(messy(spark))
    judged, _ = q.judge(voted)
    rows = judged.collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r["n_words"] for r in rows) == sorted(brute(t)[0] for _, t in TEXTS)
    assert all(0 <= r["quality"] <= 1 for r in rows)
    assert q.judge(q.with_votes(empty(spark)))[0].collect() == []
