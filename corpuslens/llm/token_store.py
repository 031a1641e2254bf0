"""Token ids in bit-packed binary files with block offsets.

File layout, little-endian:

    8 bytes   magic ``CLBITS01``
    6 x u64   bits per id, ids per block, documents, documents with a null id, ids, blocks
    i64[d]    document ids, ascending, null ones first (stored as 0)
    u64[d+1]  first id of each document, and the number of ids
    u64[b+1]  first byte of each block in the payload, and its size
    payload   ids of the minimum number of bits that holds the vocabulary, lowest bit first

Blocks hold a multiple of eight ids, so each begins at a whole byte and can be unpacked
alone: reading one document touches only the blocks it lies in.

Files are written in ascending doc_id order: file k of partition p comes before file k + 1
and before partition p + 1. A task writes under a name of its own and renames at the end,
so a repeated task leaves the same file. A missing text holds only the end id; repeated
rows are stored each, in an order that depends on the text alone. Rows are dealt out by
doc_id and text, so those without doc_id, or of one doc_id, are many tasks' work.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoded, vocabulary_size
from .files import open_input, write_file

MAGIC = b"CLBITS01"
HEAD = "<8s6Q"
BLOCK_IDS = 4096
FILE_IDS = 16_000_000
END_ID = 2


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    out = []
    for low in range(0, len(ids), 1 << 16):
        part = np.ascontiguousarray(ids[low : low + (1 << 16)], "<u4")
        single = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(single[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    out = np.empty(n, "<u4")
    step = 1 << 16
    data = np.frombuffer(raw, np.uint8)
    for low in range(0, n, step):
        some = min(step, n - low)
        first = low * bits // 8
        single = np.unpackbits(data[first : first + -(-some * bits // 8)], bitorder="little")[: some * bits].reshape(some, bits)
        wide = np.zeros((some, 32), np.uint8)
        wide[:, :bits] = single
        out[low : low + some] = np.packbits(wide.ravel(), bitorder="little").view("<u4")
    return out


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    nulls = sum(d is None for d in doc_ids)
    blocks = -(-len(ids) // block)
    size = -(-len(ids) * bits // 8)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (block * bits // 8), size).astype("<u8")
    head = struct.pack(HEAD, MAGIC, bits, block, len(doc_ids), nulls, len(ids), blocks)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, own.tobytes(), starts.tobytes(), offsets.tobytes(), pack_bits(ids, bits)])


class TokenFile:
    """Random access to one file: only the head and the blocks asked for are read."""

    def __init__(self, path: str):
        self.source = open_input(path)
        magic, self.bits, self.block, self.n_docs, self.n_null, self.n_ids, n_blocks = struct.unpack(HEAD, self._read(0, struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.starts = np.frombuffer(self._read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(self._read(at, 8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at) if size else b""

    def key(self, i: int):
        return None if i < self.n_null else int(self.doc_ids[i])

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last - 1`` of the file."""
        if last <= first:
            return np.empty(0, "<u4")
        low, high = first // self.block, -(-last // self.block)
        raw = self._read(self.payload + self.offsets[low], self.offsets[high] - self.offsets[low])
        some = unpack_bits(raw, self.bits, min(high * self.block, self.n_ids) - low * self.block)
        return some[first - low * self.block : last - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of all documents of that doc_id."""
        own = self.doc_ids[self.n_null :]
        a, b = np.searchsorted(own, [doc_id, doc_id + 1])
        return [self.document(self.n_null + i) for i in range(a, b)]


def write_tokens(
    docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write all documents; the rows say what was written: (path, part, k, n_docs, n_ids).

    Lazy: whoever uses the rows must keep them (see ``Scratch.stage``).
    """
    path = tokenizer or default_tokenizer()
    bits = bits_for(max(vocabulary_size(path), end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        keys, lengths, held, size = [], [], [], 0

        def flush():
            where = f"{folder}/part-{part:06d}-{k:05d}.ids"
            write_file(where, file_bytes(keys, lengths, np.concatenate(held), bits), uuid.uuid4().hex)
            row = {"path": [where], "part": [part], "k": [k], "n_docs": [len(keys)], "n_ids": [size]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, ids in encoded(batch.column(1), path, end_id):
                keys.append(own[row])
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
                if size >= file_ids:
                    yield flush()
                    k, keys, lengths, held, size = k + 1, [], [], [], 0
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    )
    return ordered.mapInArrow(write, "path string, part long, k long, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents; start counts the ids of all documents before.

    ``files``: the rows of ``write_tokens``. Each file is unpacked by one task, in blocks.
    """
    total = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(total), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(where)
                i = 0
                while i < file.n_docs:
                    j = max(i + 1, int(np.searchsorted(file.starts, file.starts[i] + (1 << 20), "right")) - 1)
                    j = min(j, file.n_docs)
                    ids = file.ids(int(file.starts[i]), int(file.starts[j]))
                    cut = file.starts[i : j + 1] - file.starts[i]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.key(x) for x in range(i, j)], pa.int64()),
                            pa.array(file.starts[i:j] + base, pa.int64()),
                            pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )
                    i = j

    n = max(1, files.count())
    return placed.select("path", "base").repartition(n).mapInArrow(read, "doc_id long, start long, ids binary")


