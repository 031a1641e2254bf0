import random
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from corpuslens.llm import packing as pk
from corpuslens.llm import queries
from corpuslens.llm.encoding import default_tokenizer

from .messy import TEXTS, docs_of, empty, messy, table


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_equals_piece_by_piece_packing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 4)])) for _ in range(rng.choice([0, 1, 5, 50, 400]))]
        bins, used = defaultdict(list), Counter()
        for r in pk.plan(Counter(lengths), capacity):
            for i in range(r.count):
                bins[r.sequence + i // r.per].append((r.offset + i % r.per * r.length, r.length))
                used[r.length] += 1
        assert used == Counter(lengths)
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in parts) <= 2
        assert len(bins) == best_fit_decreasing(lengths, capacity)


def test_piece_bounds():
    assert pk.piece_bounds(1, 4) == [(0, 1)]
    assert pk.piece_bounds(4, 4) == [(0, 4)]
    assert pk.piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def check(rows, texts, capacity=pk.CAPACITY):
    import zlib

    tokenizer = Tokenizer.from_file(default_tokenizer())
    expected = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (a, n) in enumerate(pk.piece_bounds(len(ids), capacity)):
            expected[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == best_fit_decreasing([e[3] for e in expected.elements()], capacity)


def test_query(spark):
    docs = table(spark, "documents")
    rows = queries.op4(spark, "/root/testdata/sf0.001").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_messy_rows(spark):
    check(pk.pack(messy(spark)).collect(), TEXTS)
    assert pk.pack(empty(spark)).collect() == []


def test_many_equal_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANK_GROUP", 7)
    texts = ["the same text"] * 200 + ["two other words here"] * 50
    check(pk.pack(docs_of(spark, texts).repartition(6)).collect(), list(enumerate(texts)))


def test_sequences_hold_the_ids(spark):
    import zlib

    for r in pk.sequences(pk.pack(table(spark, "documents"))).collect():
        assert len(r["ids"]) == sum(p["length"] for p in r["parts"]) <= pk.CAPACITY
        for p in r["parts"]:
            own = np.array(r["ids"][p["offset"] : p["offset"] + p["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == p["ids_crc32"]
