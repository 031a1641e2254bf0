"""Best-fit packing of documents into fixed-length sequences, by large-item matching.

A document longer than a sequence is cut into full pieces; what is left over is its first
piece. Pieces above a third of the capacity fit at most twice into one sequence: from the
longest down, each is matched with the longest unmatched one it fits beside. Shorter pieces
then go, from the longest down, to the sequence with the smallest gap that holds them.
Both are one loop of best fit from the longest length down (``plan``): while pieces are above
a third, the smallest gap that holds one is beside the longest unmatched piece it fits beside,
and a sequence of two such pieces has no gap for a third.

A piece matters to the packing only by its length, and there are at most ``capacity``
lengths. So the plan is made from the count of pieces per length, whatever their number:
it says which runs of the pieces of one length go to which sequences at which offset.
Every piece then finds its place from its rank among the pieces of its length.

A missing text is an empty document: only its end id. Repeated rows are packed each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoded
from .staging import Scratch

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one group.
RANK_GROUP = 50_000


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = length % capacity or min(length, capacity)
    cuts = [0, *range(first, length + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def encode_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row, ids in encoded(batch.column(1), path, end_id):
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    rows.append((row, k, start, length, ids[start : start + length].tobytes()))
                    held += length
                if held > 1 << 20:
                    yield _piece_batch(batch.column(0), rows)
                    rows, held = [], 0
            if rows:
                yield _piece_batch(batch.column(0), rows)

    return docs.select(doc_id, F.col(text).cast("string").alias("text")).mapInArrow(
        encode, f"{doc_id} {kind}, piece int, start long, length int, ids binary"
    )


def _piece_batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    row, piece, start, length, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
         pa.array(length, pa.int32()), pa.array(ids, pa.binary())],
        ["key", "piece", "start", "length", "ids"],
    )


class Run(NamedTuple):
    """Slots ``slot`` to ``slot + count - 1`` of a length: ``per`` to a sequence, from
    ``sequence`` on, the first of each at ``offset``."""

    length: int
    slot: int
    count: int
    per: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go. ``counts``: pieces per length."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, number)
    runs: list[Run] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        slot, left = 0, counts[length]
        while left:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                first, have, offset = sequences, left, 0
                gap = capacity
            else:
                first, have = gaps[gap].pop()
                offset = capacity - gap
            per = gap // length
            use = min(have, left // per)
            if not use:  # fewer pieces than one gap holds
                per, use = left, 1
            runs.append(Run(length, slot, use * per, per, first, offset))
            slot, left = slot + use * per, left - use * per
            if offset:
                if use < have:
                    gaps[gap].append((first + use, have - use))
                if not gaps[gap]:
                    del gaps[gap]
            else:
                sequences += use
            if gap - per * length:
                gaps[gap - per * length].append((first, use))
    return runs


def place(pieces: DataFrame, order: list[str], scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; rows equal in ``order`` are interchangeable."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    groups = max(16, -(-sum(counts.values()) // RANK_GROUP))
    table = {name: np.array([getattr(r, name) for r in runs], np.int64) for name in Run._fields}
    held = pieces.sparkSession.sparkContext.broadcast(table)

    grouped = pieces.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = grouped.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "length", "_g",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).alias("_before"),
    )
    ranked = grouped.withColumn(
        "_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy(*order))
    ).join(before, ["length", "_g"]).withColumn("_slot", F.col("_before") + F.col("_r") - 1)
    kept = [c for c in ranked.columns if c not in ("_g", "_r", "_before", "_slot")]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        key = (t["length"] << 44) + t["slot"]
        by = np.argsort(key)
        key = key[by]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            slot = batch.column("_slot").to_numpy()
            at = by[np.searchsorted(key, (length << 44) + slot, "right") - 1]
            inside = slot - t["slot"][at]
            sequence = t["sequence"][at] + inside // t["per"][at]
            offset = t["offset"][at] + inside % t["per"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.select(*kept, "_slot").mapInArrow(locate, f"{schema}, sequence_id long, offset long")


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece with its ids (or, without ``keep_ids``, only their ``ids_crc32``),
    the sequence it lies in and its offset there."""
    scratch = Scratch(docs.sparkSession)
    pieces = encode_pieces(docs, doc_id, text, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids"))
    pieces = scratch.stage(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return place(pieces, [doc_id, "piece", "start", "ids_crc32"], scratch, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<long>, parts): the token rows a training job reads."""
    part = F.struct("offset", "ids", *[c for c in packed.columns if c not in ("offset", "ids", "sequence_id")])
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    @F.arrow_udf("array<long>")
    def numbers(column: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(x), "<u4") for x in column.to_pylist()], pa.list_(pa.int64()))

    return rows.select("sequence_id", numbers(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
