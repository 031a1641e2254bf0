import random

import numpy as np

from corpuslens.llm import decontamination as dc

from .messy import docs_of, empty, messy, table


def plain(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_matrix():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(1, 20))]
        score, i, j = dc.align(np.array(a), np.array(b))
        assert score == plain(a, b) == plain(a[:i], b[:j])


def fixture(rng):
    word = lambda: rng.choice("the of and to in it was for".split()) if rng.random() < 0.4 else f"w{rng.randint(0, 3000)}"
    items = [" ".join(word() for _ in range(rng.choice([6, 12, 40, 60]))) for _ in range(25)]
    docs = []
    for k in range(120):
        own = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            w = items[k % 25].split()
            for _ in range(int(len(w) * rng.choice([0, 0, 0.1, 0.2]))):
                x = rng.randrange(len(w))
                w = rng.choice([w[:x] + w[x + 1 :], w[:x] + [word()] + w[x:], w[:x] + [word()] + w[x + 1 :]])
            at = rng.randint(0, len(own))
            own = own[:at] + w + own[at:]
        docs.append(" ".join(own))
    return items, docs


def test_equals_alignment_of_all_pairs(spark):
    """All pairs at or above the threshold."""
    items, docs = fixture(random.Random(4))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(docs_of(spark, docs).repartition(4), bench).collect()}
    expected = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            a, b = item.split(), doc.split()
            score = plain(a, b)
            if score >= dc.SCORE * 2 * len(a) and score >= 2 * min(8, len(a)):
                expected[d, i] = score / (2 * len(a))
    assert len(expected) > 50 and found.keys() == expected.keys()
    for key, r in found.items():
        assert abs(r["score"] - expected[key]) < 1e-9
        assert 0 <= r["first_word"] < r["end_word"] <= len(docs[key[0]].split())


def test_runs_in_common_use_are_no_seeds_and_lose_no_copy(spark):
    """Items and documents that share one run: few pairs are looked at; a copy of common runs is found."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    items = [" ".join([*(word() for _ in range(20)), "one of the", *(word() for _ in range(17))]) for _ in range(400)]
    common = "it was one of the best of the days"
    items += [f"{common} and {common}"]
    runs = [common.split()[k : k + 3] for k in range(7)]
    docs = [" ".join(x for _ in range(4) for x in [*(word() for _ in range(15)), *rng.choice(runs)]) + " one of the" for _ in range(300)]
    docs += [f"a {common} xx and {common} z", items[7]]
    items_of = dc.prepare(list(range(len(items))), items)
    chosen = dc.choose_seeds(items_of, dc.document_frequencies(docs_of(spark, docs).select("text"), items_of))
    assert len(set(chosen.common.item.tolist())) == 401 and len(chosen.common.keys) == 1 and len(chosen.rare.item) > 40
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").selectExpr("cast(item_id as smallint) item_id", "text")
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs_of(spark, docs), bench).collect()}
    assert found == {(300, 400), (301, 7)}


def test_leak_in_most_documents_keeps_seeds(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = docs_of(spark, [f"start {item} end {k}" for k in range(80)] + ["clean text of its own words"])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert dc.find_leaks(docs, bench).count() == 80
    assert [r["doc_id"] for r in dc.without_leaks(docs, bench).collect()] == [80]


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, bench = table(spark, "documents", "0.01"), table(spark, "benchmark", "0.01")
    whole = sorted(map(tuple, dc.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 3000)
    assert whole and sorted(map(tuple, dc.find_leaks(docs, bench).collect())) == whole


def test_messy_rows(spark):
    schema = "item_id long, text string"
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "no id here at all"), (None, "same words in this row and a second line of it"), (5, "one")], schema)
    found = sorted(((r["doc_id"], r["item_id"]) for r in dc.find_leaks(messy(spark), bench).collect()), key=repr)
    assert found == sorted([(6, None), (6, None), (7, None), (None, 4), (4, 5)], key=repr)
    assert {r["doc_id"] for r in dc.without_leaks(messy(spark), bench).collect()} == {None, 1, 2, 3, 5, 8, 9, 10, 11, 12}
    assert dc.find_leaks(empty(spark), bench).collect() == []
    assert dc.find_leaks(messy(spark), spark.createDataFrame([], schema)).collect() == []
    assert dc.without_leaks(messy(spark), bench).columns == messy(spark).columns


def test_edited_copies_are_found_without_a_seed_condition(spark):
    """Copies with 15 to 30 % of their words changed, beside an exact copy and words in common use."""
    rng = random.Random(11)
    common = "the of and to in it was for".split()
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"w{rng.randint(0, 9000)}"
    items = [[word() for _ in range(rng.choice([40, 60]))] for _ in range(24)]
    docs = []
    for k, item in enumerate(items):
        if k % 2:
            docs.append(item)
        edited = list(item)
        for at in rng.sample(range(len(item)), int((0.15, 0.2, 0.25, 0.3)[k // 2 % 4] * len(item))):
            edited[at] = f"x{rng.getrandbits(40)}"
        docs.append([word() for _ in range(20)] + edited + [word() for _ in range(20)])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs_of(spark, [" ".join(d) for d in docs]).repartition(4), bench).collect()}
    expected = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if plain(item, doc) >= dc.SCORE * 2 * len(item)}
    assert len(expected) >= 36 and found == expected


def test_clean_rows_beside_a_leaking_row_of_their_doc_id_stay(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(None, item), (None, "a clean text without a name"), (None, None), (3, f"x {item}"), (3, "a clean text of a repeated name"), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = sorted(map(tuple, dc.without_leaks(docs, bench).collect()), key=repr)
    assert left == sorted([rows[1], rows[2], rows[4], rows[5]], key=repr)
