import random

import pyarrow as pa
import public_tokenizers
import pytest

from corpuslens.llm import encoding as en

PARTS = ["a", "b ", "word", "Word,", " ", "  ", "\n", "\t", "é", "à ", " ", " ", "　", "😀", "'s", "'ll", " 12", "3.",
         "!?", "<|endoftext|>", " <|endoftext|> ", "\x85", "\x1c", "ñ ", "«", "» ", ".", ",", ".\n", "\n\n", "\r\n"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(file):
    path = public_tokenizers.path(file)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(20_000)] + [None, "", "x" * 5000]
    expected = [e.ids for e in en.load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from what was kept
        assert [ids.tolist() for _, ids in en.encoded(pa.array(texts, pa.string()), path)] == expected


def test_only_byte_level_tokenizers_are_cut():
    assert en.splits_at_spaces(en.load(public_tokenizers.path("byte_bpe_50k.json")))
    assert not en.splits_at_spaces(en.load(public_tokenizers.path("word_bpe_49k.json")))
