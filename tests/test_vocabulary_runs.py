"""Training on runs of leading pairs against one merge at a time."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.operators import tokens, vocabulary
from tests.test_tokens import brute_force_vocabulary


def random_words(rng, letters, n, longest):
    weights = [1, 1, 2, 3, 50]
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice(weights) for _ in range(n)}


def runs_of(words, weights, covered):
    """The longest parts of the words whose neighbours are all covered, with their counts."""
    found = Counter()
    for w, n in zip(words, weights):
        start = 0
        for i in range(1, len(w) + 1):
            if i == len(w) or (w[i - 1], w[i]) not in covered:
                if i - start > 1:
                    found[tuple(w[start:i])] += n
                start = i
    return found


@pytest.mark.parametrize("letters", ["abc", "ab", "#!a", "abcdefgh"])
def test_runs_equal_one_merge_at_a_time(letters):
    """Rounds of every reach on runs; few letters, so tokens are made in several ways."""
    rng = random.Random(len(letters))
    rounds = longer = 0
    for trial in range(120):
        counts = random_words(rng, letters, rng.choice([10, 25, 60]), rng.choice([5, 9, 14]))
        expected = brute_force_vocabulary(counts, 90)
        vocab = expected[: 5 + 2 * len(set("".join(counts)))]
        ids = {t: i for i, t in enumerate(vocab)}
        words = [[ids[c if k == 0 else "##" + c] for k, c in enumerate(w)] for w in counts]
        weights = list(counts.values())
        while len(vocab) < 90:
            pairs = Counter()
            for w, n in zip(words, weights):
                for p in zip(w, w[1:]):
                    pairs[p] += n
            ranked = [(*p, n) for p, n in sorted(pairs.items(), key=lambda x: (-x[1], vocab[x[0][0]], vocab[x[0][1]]))]
            if not ranked:
                break
            known = ranked[: rng.randint(1, len(ranked))]
            complete = len(known) == len(ranked)
            reach = rng.randint(1, len(known) if complete else max(1, len(known) - 1))
            if reach == len(known) and not complete:
                continue
            runs = runs_of(words, weights, {r[:2] for r in known[:reach]})
            borders = vocabulary._Borders(known[:reach], known[reach:], 0 if complete else known[-1][2])
            bound = known[reach] if reach < len(known) else None
            merges = vocabulary.leading_merges([list(r) for r in runs], list(runs.values()), known[:reach], bound, vocab, 90, borders)
            assert merges
            rounds, longer = rounds + 1, longer + (len(merges) > 1)
            for a, b, z in merges:
                words = [vocabulary.merge_pair(w, a, b, z) for w in words]
        assert vocab == expected, trial
    assert longer > rounds / 10


def test_rows_are_merged_as_one_after_another():
    rng = random.Random(5)
    for trial in range(200):
        words = [[rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 5, 12]))] for _ in range(rng.choice([0, 1, 30]))]
        merges = [(rng.randrange(7), rng.randrange(7), rng.choice([3, 4, 5, 6])) for _ in range(rng.randint(1, 9))]
        offsets = np.cumsum([0, *map(len, words)])
        values, ends = vocabulary.merge_rows(np.array([s for w in words for s in w], np.int64), offsets, merges)
        for a, b, z in merges:
            words = [vocabulary.merge_pair(w, a, b, z) for w in words]
        assert [values[x:y].tolist() for x, y in zip(ends, ends[1:])] == words, trial


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_runs_and_pairs_are_summed(spark, monkeypatch, held):
    monkeypatch.setattr(vocabulary, "_HELD", held)
    rng = random.Random(8)
    words = [[rng.randrange(5) for _ in range(rng.randint(2, 9))] for _ in range(60)]
    weights = [rng.randint(1, 9) for _ in words]
    df = spark.createDataFrame(list(zip(words, weights)), "s array<int>, n bigint").repartition(3)
    pairs = Counter()
    for w, n in zip(words, weights):
        for p in zip(w, w[1:]):
            pairs[p] += n
    assert {(r["a"], r["b"]): r["n"] for r in vocabulary._neighbours(df).collect()} == pairs
    for some in ([(1, 2, 0), (2, 1, 0), (3, 3, 0), (4, 0, 0)], [(1, 2, 0), (3, 3, 0)]):
        df = vocabulary._runs(df, some)
        got = {tuple(np.frombuffer(bytes(r["run"]), np.int32).tolist()): r["n"] for r in df.collect()}
        assert got == runs_of(words, weights, {p[:2] for p in some})


@pytest.mark.parametrize("candidates", [1 << 15, 60])
def test_words_beyond_the_look_ahead_take_few_rounds(spark, monkeypatch, candidates):
    """Words of few parts, as those of a large text: far more symbols than the driver looks at."""
    rng = random.Random(1)
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    counts = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))): rng.randint(1, 40) for _ in range(3000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rounds, plain = [], vocabulary._merge_words
    monkeypatch.setattr(vocabulary, "_merge_words", lambda words, merges: rounds.append(len(merges)) or plain(words, merges))
    monkeypatch.setattr(vocabulary, "CANDIDATES", candidates)
    assert vocabulary.train_vocabulary(df, 150, look_ahead=1500) == brute_force_vocabulary(counts, 150)
    assert len(rounds) < 12


def test_letters_of_any_plane_become_ids(spark):
    counts = {"#": 2, "###": 1, "𝒳é𝒳": 4, "é": 3, "a𝒳": 5}
    df = spark.createDataFrame([*counts.items(), (None, 9), ("", 9)], "word string, n bigint")
    letters = Counter({form + c: 0 for w in counts for c in w for form in ("", "##")})
    for w, n in counts.items():
        for k, c in enumerate(w):
            letters["##" * (k > 0) + c] += n
    assert {r["piece"]: r["n"] for r in vocabulary.alphabet(df).collect()} == letters
    vocab = vocabulary._alphabet_list(df, 99)
    rows = vocabulary._symbol_ids(df.where("word <> ''"), vocab).collect()
    spelled = sorted(([vocab[i] for i in r["s"]], r["n"]) for r in rows)
    assert spelled == sorted((["##" * (k > 0) + c for k, c in enumerate(w)], n) for w, n in counts.items())


def test_batches_of_none_and_of_missing_text():
    for rows, want in (([], []), ([None, []], [[], []]), ([["ab", "x"], None, ["abab"]], [[7, 0], [], [7, 6]])):
        got = tokens.match_batch(pa.array(rows, pa.list_(pa.string())), {"ab": 7, "##ab": 6, "a": 5}).to_pylist()
        assert [r["ids"] for r in got] == want
    sliced = pa.array([["x"], ["ab", "abab"], None], pa.list_(pa.string())).slice(1)
    assert tokens.match_batch(sliced, {"ab": 7, "##ab": 6}).to_pylist() == [
        {"ids": [7, 7, 6], "word_ids": [0, 1, 1]}, {"ids": [], "word_ids": []}
    ]
