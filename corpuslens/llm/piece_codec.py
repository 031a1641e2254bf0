"""SentencePiece encoding that knows where every piece comes from, and decoding.

1. The text is normalised by the model's compiled character map, a double-array trie: at each
   place the longest prefix that the map knows is replaced, any other character stays. Every
   byte of the result records the place in the text that it was made from. White space is then
   squeezed, marked and put in front as the model says, and the record follows.
2. The normalised text falls into chunks that begin at a white space mark. Where no piece of the
   model reaches over such a border (``chunked``), every distinct chunk is segmented once, by a
   copy of the model that normalises nothing; chunks are told apart by a 64-bit hash. Other
   models segment whole texts.
3. The length of each piece in bytes gives its place in the normalised text, and the record of
   step 1 the bytes of the original text it stands for.

A missing text is an empty one and has only the end id. Repeated rows are encoded each. Texts
are never cut short: a slice of some texts is held at a time, or one text if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Pieces, gather
from .wordhash import hash_runs, slices, utf8, worker_cache

SLICE_BYTES = 1 << 20
#: Ids of one text that are decoded at a time.
PART_IDS = 1 << 20
MARK = "▁"
SPACE = 32
# Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled map: the size of the trie, its units, then the replacements, each ended by 0."""

    def __init__(self, blob: bytes):
        size = int(np.frombuffer(blob[:4], "<u4")[0])
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.texts == 0)
        self.ends = ends if len(ends) and ends[-1] == len(self.texts) - 1 else np.append(ends, len(self.texts))

    def _below(self, unit: np.ndarray) -> np.ndarray:
        """Distance to a unit's children."""
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest known prefix (0: none) and its replacement.
        All places walk down the trie together, a byte at a time."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.full(len(at), self._below(self.units[:1])[0])
        depth = 0
        while len(live := live[(going := at[live] + depth < end[live])]):
            node = node[going]
            byte = data[at[live] + depth].astype(np.int64)
            node ^= byte
            unit = self.units[node]
            known = (unit & 0x800000FF) == byte
            live, node, unit = live[known], node[known] ^ self._below(unit[known]), unit[known]
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]], value[live[leaf]] = depth, self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Normalised(NamedTuple):
    """Row i is ``data[bounds[i]:bounds[i + 1]]``; each byte was made from place ``source`` of the
    original column's bytes, and the row ends at ``end[i]`` of them."""

    data: np.ndarray
    bounds: np.ndarray
    source: np.ndarray
    end: np.ndarray


def mapped(data: np.ndarray, offsets: np.ndarray, charmap: CharacterMap | None):
    """The replaced bytes, the place each was made from, where rows begin in them, and per row
    the place of the first unit that is no lone space."""
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(data)))
    source = first
    start, count = first, size
    pool = data
    if charmap is not None:
        row_end = offsets[np.searchsorted(offsets, first, "right")]
        length, value = charmap.longest(data, first, row_end)
        used = np.ones(len(first), bool)
        reach = 0
        for i in np.flatnonzero(length > size).tolist():  # the few that span several characters
            if first[i] < reach:
                continue
            reach = int(first[i] + length[i])
            used[i + 1 : np.searchsorted(first, reach)] = False
        source, hit, value = first[used], (length > 0)[used], value[used]
        ends = charmap.ends[np.searchsorted(charmap.ends, value)]
        start = np.where(hit, len(data) + value, source)
        count = np.where(hit, ends - value, size[used])
        pool = np.concatenate([data, charmap.texts])
    out = gather(pool, start, count)
    sums = np.concatenate([[0], np.cumsum(count)])
    unit_rows = np.searchsorted(source, offsets)
    lone = (count == 1) & (pool[np.minimum(start, max(len(pool) - 1, 0))] == SPACE) if len(pool) else np.zeros(0, bool)
    other = np.flatnonzero(~lone)
    after = np.searchsorted(other, unit_rows[:-1])
    has = after < len(other)
    begin = offsets[:-1].copy()
    begin[has] = source[other[after[has]]]
    return out, np.repeat(source, count), sums[unit_rows], np.minimum(begin, offsets[1:])


def normalise(column: pa.Array, spec: Spec) -> Normalised:
    data, offsets = utf8(column)
    out, source, bounds, begin = mapped(data, offsets, spec.charmap)
    end = offsets[1:].copy()
    filled = np.diff(offsets) > 0
    if spec.squeeze:
        space = out == SPACE
        after_space = np.concatenate([[True], space[:-1]])[: len(space)]
        after_space[bounds[:-1][bounds[:-1] < len(space)]] = True
        out, source, bounds = _keep(~(space & after_space), out, source, bounds)
        last = bounds[1:][np.diff(bounds) > 0] - 1
        last = last[out[last] == SPACE]
        end[np.searchsorted(bounds, last, "right") - 1] = source[last]
        keep = np.ones(len(out), bool)
        keep[last] = False
        out, source, bounds = _keep(keep, out, source, bounds)
        filled = np.diff(bounds) > 0
    else:
        begin = offsets[:-1]
    if spec.prefix:
        rows = np.flatnonzero(filled)
        out, source = np.insert(out, bounds[rows], SPACE), np.insert(source, bounds[rows], begin[rows])
        bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
    if spec.marks:
        width = np.where(out == SPACE, 3, 1)
        sums = np.concatenate([[0], np.cumsum(width)])
        at = sums[:-1][out == SPACE]
        out, source, bounds = np.repeat(out, width), np.repeat(source, width), sums[bounds]
        for k, byte in enumerate(MARK.encode()):
            out[at + k] = byte
    return Normalised(out, bounds, source, end)


def _keep(keep: np.ndarray, out: np.ndarray, source: np.ndarray, bounds: np.ndarray):
    return out[keep], source[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


class Spec:
    """A model file: how it normalises, and its two processors."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with white space as a suffix or with user-defined pieces are not read")
        self.charmap = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze, self.marks = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.whole = SentencePieceProcessor(model_file=path)
        self.end_id = self.whole.eos_id()
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        #: Bytes are pieces, so nothing is unknown, and marks only begin pieces.
        self.chunked = model.trainer_spec.model_type == BPE and model.trainer_spec.byte_fallback and self.marks and not any(
            MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type in (NORMAL, UNUSED)
        )
        plain = [i for i, p in enumerate(model.pieces) if p.type == NORMAL and p.piece.isascii() and p.piece.isalnum()]
        #: A piece to put before the later parts of a long text, and its letters.
        self.stub = (plain[0], model.pieces[plain[0]].piece) if plain else None
        rules.precompiled_charsmap = b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
        self.cutter = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known = Pieces(self.sizes)

    @classmethod
    def load(cls, path: str) -> Spec:
        """The model of a file, loaded once per worker process."""
        held = worker_cache()
        if ("pieces", path) not in held:
            held["pieces", path] = cls(path)
        return held["pieces", path]


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks begin with a row and at each mark after another character."""
    a, b, c = MARK.encode()
    mark = np.zeros(len(data) + 3, bool)
    mark[3 : len(data) + 1] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c) if len(data) > 2 else False
    begins = mark[3:] & ~mark[:-3]
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))[: len(starts)]


def _segment_chunks(text: Normalised, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows one after another, the bytes of each, and the bounds of each row."""
    starts, ends = chunk_bounds(text.data, text.bounds)
    hashes, first, which = np.unique(hash_runs(text.data, starts, ends), return_index=True, return_inverse=True)
    has, at = spec.known.find(hashes)
    start, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    start[has], count[has] = spec.known.start[at[has]], spec.known.count[at[has]]
    new = np.flatnonzero(~has)
    raw = text.data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
    found = spec.cutter.encode(words, num_threads=1) if words else []
    counts = np.fromiter(map(len, found), np.int64, len(found))
    fresh = np.fromiter((i for f in found for i in f), "<u4", int(counts.sum()))
    start[new], count[new] = len(spec.known.ids) + np.cumsum(counts) - counts, counts
    ids = gather(np.concatenate([spec.known.ids, fresh]), start[which], count[which])
    spec.known.add(hashes[new], counts, fresh)
    sums = np.concatenate([[0], np.cumsum(count[which])])
    return ids, spec.sizes[ids], sums[np.searchsorted(starts, text.bounds)]


def _segment_rows(text: Normalised, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = text.data.tobytes()
    rows = [spec.cutter.encode(raw[a:b].decode(), return_type="proto").pieces for a, b in pairwise(text.bounds.tolist())]
    ids = np.array([p.id for row in rows for p in row], "<u4")
    sizes = np.array([len(p.surface.encode()) for row in rows for p in row], np.int64)
    return ids, sizes, np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)


def encode_column(column: pa.Array, spec: Spec) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """(ids, begin, end) of each row, the end id last; places are bytes of the row's text."""
    text = normalise(column, spec)
    ids, sizes, bounds = (_segment_chunks if spec.chunked else _segment_rows)(text, spec)
    _, offsets = utf8(column)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    # Pieces of a row lie one after another, so its bytes and its pieces end together.
    high = np.cumsum(sizes) if spec.chunked else _ends_in_rows(sizes, row, bounds, text.bounds)
    low = high - sizes
    source = np.append(text.source, 0)
    begin = np.where(low < text.bounds[row + 1], source[low], text.end[row]) - offsets[row]
    end = np.where(high < text.bounds[row + 1], source[np.minimum(high, len(text.source))], text.end[row]) - offsets[row]
    lists = []
    lengths = np.diff(offsets)
    for values, tail in ((ids, np.full(len(counts), spec.end_id)), (begin, lengths), (end, lengths)):
        joined = np.insert(values.astype(np.int64), bounds[1:], tail).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(joined)))
    return tuple(lists)


def _ends_in_rows(sizes: np.ndarray, row: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return begins[row] + sums[1:] - sums[bounds[row]]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids, begin, end): the ids of each text with the end id, and for each the bytes of
    the text from which it was made."""
    path = model or default_model()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = Spec.load(path)
        for batch in batches:
            for first, part in slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), *encode_column(part, spec)], ["doc_id", "ids", "begin", "end"]
                )

    out = docs.select(doc_id, F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, begin array<int>, end array<int>"
    )
    return out.withColumnRenamed("doc_id", doc_id)


def decode_ids(ids: np.ndarray, spec: Spec, part_ids: int = PART_IDS) -> str:
    """The text of one row, some ids at a time. A part never begins inside a run of bytes, and
    a piece before it keeps its leading space."""
    if len(ids) <= part_ids or spec.stub is None:
        return spec.whole.decode(ids.tolist())
    out, low = [], 0
    while low < len(ids):
        high = min(low + part_ids, len(ids))
        while high < len(ids) and spec.is_byte[ids[high]]:
            high += 1
        part = ids[low:high].tolist()
        out.append(spec.whole.decode([spec.stub[0], *part])[len(spec.stub[1]) :] if low else spec.whole.decode(part))
        low = high
    return "".join(out)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """(key, text) from a column of ids; a missing one is an empty text."""
    path = model or default_model()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = Spec.load(path)
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_IDS, "right")) - 1)
                texts = [decode_ids(values[a:b], spec) for a, b in pairwise(offsets[first : last + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(texts, pa.string())], ["key", "text"])
                first = last

    given = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    out = encoded.select(F.col(key).alias("key"), given.alias("ids")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
