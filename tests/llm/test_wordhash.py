import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm.wordhash import ngrams, row_counts, slices, words

WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9_ .,\né漢😀", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    found = words(pa.array(texts, pa.string()), lower=False)
    expected = [WORD.findall(t or "") for t in texts]
    assert np.diff(found.bounds).tolist() == [len(w) for w in expected]
    flat = [w for row in expected for w in row]
    assert len(set(flat)) == len(set(found.hashes.tolist()))
    by_word = {}
    for word, h in zip(flat, found.hashes.tolist()):
        assert by_word.setdefault(word, h) == h


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_ngrams_and_counts(texts, n):
    column = pa.array(texts, pa.string())
    found = words(column)
    gram, rows, first = ngrams(found.hashes, found.bounds, n)
    expected = []
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        cut = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
        expected += [(i, g) for g in cut]
    assert rows.tolist() == [i for i, _ in expected]
    assert len(set(zip(rows.tolist(), gram.tolist()))) == len(set(expected))
    _, r, c, _ = row_counts(gram, rows, len(texts))
    assert c.sum() == len(expected) and len(r) == len(set(expected))
    assert np.all(np.diff(first[rows == 0]) > 0)


def test_long_word_and_sliced_column():
    column = pa.array(["skip", "a" * 2_000_000 + " b", "c"]).slice(1)
    found = words(column)
    assert np.diff(found.bounds).tolist() == [2, 1]
    assert found.hashes[1] == words(pa.array(["b"])).hashes[0]


def test_slices_cover_all_rows():
    column = pa.array(["abc", None, "", "d" * 50, "e"])
    parts = list(slices(column, 4))
    assert [p for _, part in parts for p in part.to_pylist()] == column.to_pylist()
    assert [first for first, _ in parts] == [0, 3, 4]
