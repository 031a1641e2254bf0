"""Token ids by a public tokenizer file, batch by batch inside Python workers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .wordhash import hash_runs, slices, utf8, worker_cache


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    held = worker_cache()
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
    return held[path]


def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size()


def splits_at_spaces(tokenizer) -> bool:
    """Whether a text may be cut before single spaces without changing its ids: byte-level
    pre-tokens begin at such a space, and nothing is normalised or stripped around."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and " " in t["content"] for t in spec["added_tokens"])
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


def _flags(*members: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins of chunks; which of them are at a space; which are no begin of a row.

    Pre-tokens always end before a single space between two characters that are surely no white
    space, before punctuation after an ASCII letter, and before an ASCII letter after a single newline.
    """
    letter, stop = _flags(*range(65, 91), *range(97, 123)), _flags(*b",.;:!?")
    white = _flags(9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
    c2_end, lead, middle = _flags(0x85, 0xA0), _flags(0xE1, 0xE2, 0xE3), _flags(0x80, 0x81, 0x9A)
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < len(data) - 2)]
    one, two, three, after, then = data[at - 1], data[at - 2], data[at - 3], data[at + 1], data[at + 2]
    wide_before = (two == 0xC2) & c2_end[one] | lead[three] & middle[two]
    wide_after = (after == 0xC2) & c2_end[then] | lead[after]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    safe = ~(white[one] | white[after] | wide_before | wide_after | begins[at] | begins[at + 1])
    spaced, cut = np.zeros(len(data), bool), np.zeros(len(data), bool)
    spaced[at[safe]] = True
    is_letter = letter[data]
    cut[1:] = is_letter[:-1] & stop[data[1:]] & ~begins[1:-1]
    line = _flags(*range(33, 127))[data[:-2]] & (data[1:-1] == 10) & is_letter[2:]
    cut[2:] |= line & ~begins[1:-2] & ~begins[2:-1]
    cut |= spaced
    starts = np.flatnonzero(cut | begins[:-1])
    return starts, spaced[starts], cut[starts]


class Pieces:
    """Ids of chunks met before: sorted hashes and where the ids of each lie. Its size is bounded;
    chunks that come up when it is full are encoded in each slice anew."""

    LIMIT_BYTES = 24 << 20

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.hashes, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return self.hashes[at] == wanted, at

    def add(self, hashes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """``hashes`` are new."""
        if not len(hashes) or 16 * (len(self.hashes) + len(hashes)) + 4 * (len(self.ids) + len(ids)) > self.LIMIT_BYTES:
            return
        by = np.argsort(hashes)
        start = (len(self.ids) + np.cumsum(count) - count)[by]
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes = np.insert(self.hashes, at, hashes[by])
        self.start = np.insert(self.start, at, start.astype(np.int32))
        self.count = np.insert(self.count, at, count[by].astype(np.int32))
        self.ids = np.concatenate([self.ids, ids])


def gather(source: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges of ``source`` one after another."""
    ends = np.cumsum(count)
    return source[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def id_bytes(tokenizer) -> np.ndarray:
    """Bytes of text that each id stands for: a character of a byte-level token is a byte."""
    added = {t["id"]: len(t["content"].encode()) for t in json.loads(tokenizer.to_str())["added_tokens"]}
    out = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        out[i] = added.get(i, len(token))
    return out


def _encode_joined(raw: bytes, low: np.ndarray, high: np.ndarray, tokenizer, sizes: np.ndarray, joined: int):
    """Ids of byte ranges, encoded ``joined`` at a time; how many belong to each follows from
    the bytes they stand for."""
    texts = [
        b"".join(raw[a:b] for a, b in zip(low[k : k + joined].tolist(), high[k : k + joined].tolist())).decode()
        for k in range(0, len(low), joined)
    ]
    found = [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate([*found, np.zeros(0, "<u4")])
    ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(high - low), "left") + 1
    return ids, np.diff(ends, prepend=0)


def encode_by_chunks(column: pa.Array, tokenizer, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after another, and the bounds of each row. Every distinct chunk is
    encoded once; chunks are told apart by a 64-bit hash.

    Chunks that begin at a space and end before another cut can be encoded many at a time, as
    they could stand side by side in a text; all others are encoded alone.
    """
    data, offsets = utf8(column)
    starts, spaced, cut = chunk_starts(data, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    newline = data[ends - 1] == 10
    inner = spaced & np.append(cut[1:], False)[: len(starts)] & ~newline
    hashes, first, which = np.unique(
        hash_runs(data, starts, ends) + inner.astype(np.uint64), return_index=True, return_inverse=True
    )
    has, at = known.find(hashes)
    start, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    if has.any():
        start[has], count[has] = known.start[at[has]], known.count[at[has]]
    new = np.flatnonzero(~has)
    new = np.concatenate([new[inner[first[new]]], new[~inner[first[new]]]])
    raw, n_inner = data.tobytes(), int(inner[first[new]].sum())
    low, high = starts[first[new]], ends[first[new]]
    fresh, counts = zip(
        _encode_joined(raw, low[:n_inner], high[:n_inner], tokenizer, known.sizes, 4000),
        _encode_joined(raw, low[n_inner:], high[n_inner:], tokenizer, known.sizes, 1),
    )
    fresh, counts = np.concatenate(fresh), np.concatenate(counts)
    count[new] = counts
    start[new] = len(known.ids) + np.cumsum(counts) - counts
    ids = gather(np.concatenate([known.ids, fresh]), start[which], count[which])
    known.add(hashes[new], counts, fresh)
    sums = np.concatenate([[0], np.cumsum(count[which])])
    return ids, sums[np.searchsorted(starts, offsets)]


def encoded(column: pa.Array, path: str, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text of a column; missing ones are empty. ``end_id`` is appended.

    Whole texts are encoded, a slice of about 1 MB of them at a time.
    """
    tokenizer = load(path)
    held = worker_cache()
    if ("cut", path) not in held:
        held["cut", path] = Pieces(id_bytes(tokenizer)) if splits_at_spaces(tokenizer) else None
    known = held["cut", path]
    tail = np.array([] if end_id is None else [end_id], "<u4")
    for first, part in slices(column, 1 << 20):
        if known is not None:
            ids, bounds = encode_by_chunks(part, tokenizer, known)
            for i in range(len(part)):
                yield first + i, np.concatenate([ids[bounds[i] : bounds[i + 1]], tail])
        else:
            texts = [t or "" for t in part.to_pylist()]
            for i, found in enumerate(tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                yield first + i, np.concatenate([np.array(found.ids, "<u4"), tail])
