"""Token rows: encode, truncate, wrap with special tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLS_ID, PAD_ID, SEP_ID, UNK_ID
from ..functions.text import BLANK

WORD = r"\p{L}\p{M}\p{N}_"
#: What a task remembers of the words it has matched.
MATCHED_BYTES = 64_000_000


def pre_tokens(text: Column) -> Column:
    """Lower-case words and runs of punctuation."""
    space = BLANK[1:-1]
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+|[^{WORD}{space}]+"), 0)


def continuations(vocab: dict[str, int]) -> dict[str, int]:
    """The pieces that continue a word, without their mark."""
    return {t[2:]: i for t, i in vocab.items() if t.startswith("##")}


def longest_match(word: str, vocab: dict[str, int], longest: int, later: dict[str, int] | None = None) -> list[int]:
    """Ids of the longest vocabulary pieces from left to right, or one unknown. No piece has
    more than ``longest`` letters, so the time is linear in the length of the word. ``later``:
    the vocabulary's ``continuations``, where they are at hand."""
    if later is None:
        later = continuations(vocab)
    ids, start, n, pieces = [], 0, len(word), vocab
    while start < n:
        for end in range(min(n, start + longest), start, -1):
            piece = pieces.get(word[start:end])
            if piece is not None:
                ids.append(piece)
                start, pieces = end, later
                break
        else:
            return [UNK_ID]
    return ids


class Matched(dict):
    """Word -> pieces, matched when first asked for. Holds at most some 64 MB of words."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab, self.longest, self.held = vocab, max(map(len, vocab), default=0), 0
        self.later = continuations(vocab)

    def __missing__(self, word: str) -> list[int]:
        pieces = longest_match(word, self.vocab, self.longest, self.later)
        self.held += 200 + 4 * len(word) + 8 * len(pieces)
        if self.held > MATCHED_BYTES:
            self.clear()
            self.held = 0
        self[word] = pieces
        return pieces


def match_batch(rows: pa.ListArray, vocab: dict[str, int] | Matched) -> pa.StructArray:
    """Pieces of a batch of word lists. Each distinct word is matched once; the rest is
    array arithmetic."""
    matched = vocab if isinstance(vocab, Matched) else Matched(vocab)
    coded = rows.flatten().dictionary_encode()
    found = [matched[w] for w in coded.dictionary.to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, found), "int32", len(found)), dtype="int32")
    pieces = np.fromiter(chain.from_iterable(found), "int32", ends[-1] if len(ends) else 0)
    spelled = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(pieces))
    spelled = spelled.take(coded.indices)

    firsts = spelled.offsets.to_numpy()
    row_sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    row_ends = np.cumsum(row_sizes, dtype="int64")
    place = np.arange(len(spelled), dtype="int32") - np.repeat((row_ends - row_sizes).astype("int32"), row_sizes)
    offsets = pa.array((firsts[np.concatenate([[0], row_ends])] - firsts[0]).astype("int32"))
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(offsets, spelled.flatten()),
            pa.ListArray.from_arrays(offsets, pa.array(np.repeat(place, np.diff(firsts)))),
        ],
        names=["ids", "word_ids"],
    )


def encode(df: DataFrame, vocab: Sequence[str], text: str = "text") -> DataFrame:
    """Add ``ids`` and ``word_ids`` (index of the word each piece comes from).

    The vocabulary is capped when it is made, which bounds the broadcast; the text is
    never shuffled. Missing text has no pieces.
    """
    table = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})

    @F.arrow_udf("ids array<int>, word_ids array<int>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matched = Matched(table.value)
        for batch in batches:
            yield match_batch(batch, matched)

    return (
        df.withColumn("_e", pieces(pre_tokens(F.col(text))))
        .withColumn("ids", F.col("_e.ids"))
        .withColumn("word_ids", F.col("_e.word_ids"))
        .drop("_e")
    )


def truncate(ids: Column, max_len: int | None, specials: int = 2) -> Column:
    """Leave room for the special tokens; None keeps everything."""
    return ids if max_len is None else F.slice(ids, 1, max_len - specials)


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def wrap_special(ids: Column, second: Column | None = None) -> Column:
    """[CLS] A [SEP], or [CLS] A [SEP] B [SEP]."""
    parts = [_ids(CLS_ID), ids, _ids(SEP_ID)]
    if second is not None:
        parts += [second, _ids(SEP_ID)]
    return F.concat(*parts)


def wrap_word_ids(word_ids: Column) -> Column:
    """Word index per token, null on special tokens."""
    blank = F.array(F.lit(None).cast("int"))
    return F.concat(blank, word_ids, blank)


def segment_ids(ids: Column, second: Column | None = None) -> Column:
    """0 for the first part with its special tokens, 1 for the second."""
    first = F.array_repeat(F.lit(0), F.size(ids) + 2)
    return first if second is None else F.concat(first, F.array_repeat(F.lit(1), F.size(second) + 1))


def is_special(token: Column) -> Column:
    return token.isin(CLS_ID, SEP_ID, PAD_ID)


def special_mask(ids: Column) -> Column:
    """1 on special tokens."""
    return F.transform(ids, lambda x: is_special(x).cast("int"))


def token_rows(df: DataFrame, vocab: Sequence[str], text: str = "text", max_len: int | None = None) -> DataFrame:
    """Encoded, truncated and wrapped: input_ids, special_tokens_mask, word_ids."""
    out = encode(df, vocab, text)
    return (
        out.withColumn("input_ids", wrap_special(truncate(F.col("ids"), max_len)))
        .withColumn("special_tokens_mask", special_mask(F.col("input_ids")))
        .withColumn("word_ids", wrap_word_ids(truncate(F.col("word_ids"), max_len)))
        .drop("ids")
    )
