"""Hard negatives by exact integer scores.

A component x counts as floor(256 x). Scores are inner products of these whole numbers,
made by matrix products in a residue number system: the components modulo several primes are
multiplied in float32, where every sum stays below 2^24 and so is exact, and the signed score
follows from its residues by Chinese remaindering. The primes are as many as twice the largest
squared norm of the table needs, so no score can be taken for another.

An anchor's positives are its best other rows of the same label; the negatives of a positive are
the best rows of another label whose score lies in a band below the positive's. Anchors are
taken in blocks of a fixed number of bytes; each block is sent to every task, which holds only
the best few rows of each anchor. A window over those picks the first ones of all tasks.

Rows with a null id, label or vector, or with a null or non-finite component take no part; a
vector that is shorter than the longest counts as filled up with zeros. Equal scores are
ordered by id. Repeated rows are rows of their own; "other rows" are those of another id. An
anchor without positives, or a positive without negatives in its band, gives no row. Scores
must be below 2^56 in size, else the job stops with an error instead of a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Columns multiplied at a time, and the largest residue a product of that many allows.
COLUMNS = 64
LARGEST_PRIME = 1 << 10
BLOCK_BYTES = 8 << 20
TILE_ANCHORS, TILE_ROWS = 512, 2048
NOTHING = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^10 whose product exceeds twice ``bound``."""
    if bound >= 1 << 56:
        raise ValueError("scores beyond 2^56: scale the vectors down")
    sieve = np.ones(LARGEST_PRIME, bool)
    for k in range(2, 32):
        sieve[k * k :: k] = False
    chosen, product = [], 1
    for p in np.flatnonzero(sieve)[:1:-1].tolist():
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the components between -p/2 and p/2."""
    out = []
    for p in primes:
        r = rows % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of two sets of rows given by their residues."""
    digits: list[np.ndarray] = []
    for a, b, p in zip(left, right, primes):
        rest = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], COLUMNS):
            rest += (a[:, k : k + COLUMNS] @ b[:, k : k + COLUMNS].T).astype(np.int64)
        # The next digit of the score in the mixed radix of the primes so far.
        radix = 1
        for digit, q in zip(digits, primes):
            rest -= digit * (radix % p)
            radix *= q
        digits.append(rest % p * pow(radix, -1, p) % p if radix > 1 else rest % p)
    total, radix = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for digit, p in zip(digits, primes):
        total += digit * radix
        radix *= p
    total[total > radix // 2] -= radix
    return total


def first_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each group by score and id."""
    order = np.lexsort((ids, -score, group))
    held = group[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, int)
    rank = np.arange(len(held)) - np.repeat(starts, np.diff(np.append(starts, len(held))))
    return order[rank < most]


class Best:
    """The first rows of each group that a task has met."""

    def __init__(self, most: int, groups: int):
        self.most = most
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        #: A row below its group's least score can't be among the first any more.
        self.least = np.full(groups, NOTHING)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        parts = (self.group, group), (self.score, score), (self.ids, ids)
        group, score, ids = (np.concatenate(x) for x in parts)
        keep = first_rows(group, score, ids, self.most)
        self.group, self.score, self.ids = group[keep], score[keep], ids[keep]
        full, last = np.unique(self.group[::-1], return_index=True)
        counts = np.bincount(self.group, minlength=len(self.least))
        enough = counts[full] == self.most
        self.least[full[enough]] = self.score[::-1][last[enough]]

    def take(self, allowed: np.ndarray, score: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> None:
        """Add the allowed cells of a tile: rows are ``groups``, columns ``ids`` in ascending order."""
        allowed = allowed & (score >= self.least[groups][:, None])
        if np.count_nonzero(allowed) > 4 * self.most * len(groups) and score.shape[1] > self.most:
            # At most this many of each row of the tile can be among the first.
            width = score.shape[1]
            size = int(np.abs(score).max()) + 1
            if size < (1 << 62) // width:
                key = np.where(allowed, score * width + (width - 1 - np.arange(width)), NOTHING)
                columns = np.argpartition(key, width - self.most, axis=1)[:, width - self.most :]
            else:
                columns = np.argsort(np.where(allowed, -score, np.iinfo(np.int64).max), axis=1, kind="stable")[:, : self.most]
            only = np.zeros_like(allowed)
            np.put_along_axis(only, columns, True, axis=1)
            allowed &= only
        row, column = np.nonzero(allowed)
        if len(row):
            self.add(groups[row], score[row, column], ids[column])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.group), pa.array(self.ids), pa.array(self.score)], names)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def tiles(batches: Iterator[pa.RecordBatch], width: int, primes: list[int]):
    """(ids, labels, residues) of some rows at a time, in the order of their ids."""
    for batch in batches:
        for low in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(low, TILE_ROWS)
            ids = part.column(0).to_numpy()
            by = np.argsort(ids, kind="stable")
            rows = matrix(part.column(2), width)[by]
            yield ids[by], part.column(1).to_numpy()[by], residues(rows, primes)


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v): the rows that take part."""
    x = F.col(vector)

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, usable), F.lit(False)))
    return rows.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"),
    )


def _block_search(rows: DataFrame, held, width: int, primes: list[int]) -> DataFrame:
    """(a, id, score): the best rows of the same label for each anchor of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = held.value
        own = residues(v, primes)
        best = Best(POSITIVES, len(ids))
        for other, other_label, theirs in tiles(batches, width, primes):
            for name in np.unique(other_label):
                columns, mine = np.flatnonzero(other_label == name), np.flatnonzero(labels == name)
                some = [x[columns] for x in theirs]
                for low in range(0, len(mine), TILE_ANCHORS):
                    at = mine[low : low + TILE_ANCHORS]
                    found = scores([x[at] for x in own], some, primes)
                    best.take(ids[at][:, None] != other[columns], found, at, other[columns])
        yield best.batch(["a", "id", "score"])

    return rows.mapInArrow(search, "a long, id long, score long")


def _band_search(rows: DataFrame, held, bands, width: int, primes: list[int]) -> DataFrame:
    """(g, id, score): for each anchor and positive (g = anchor * POSITIVES + its place) the best
    rows of another label in the positive's band."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, v = held.value
        low_of, high_of = bands.value
        own = residues(v, primes)
        best = Best(NEGATIVES, len(labels) * POSITIVES)
        for other, other_label, theirs in tiles(batches, width, primes):
            for low in range(0, len(labels), TILE_ANCHORS):
                at = np.arange(low, min(low + TILE_ANCHORS, len(labels)))
                found = scores([x[at] for x in own], theirs, primes)
                apart = labels[at][:, None] != other_label
                for k in range(POSITIVES):
                    g = at * POSITIVES + k
                    allowed = apart & (found >= low_of[g][:, None]) & (found <= high_of[g][:, None])
                    best.take(allowed, found, g, other)
        yield best.batch(["g", "id", "score"])

    return rows.mapInArrow(search, "g long, id long, score long")


def _first(found: DataFrame, group: str, most: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``id``, the anchors' ids."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.stage(whole_numbers(vectors, vec_id, vector, label), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = rows.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("width"), F.count_if(anchors).alias("anchors")).first()
    width = max(size["width"] or 0, 1)
    primes = primes_for(int((size["norm"] or 0) * (1 + 1e-9)) + 1)
    blocks = max(1, -(-size["anchors"] * 8 * width // block_bytes))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    search, out = partial(_block_search, width=width, primes=primes), None
    for k in range(blocks):
        chosen = rows.filter(anchors & (part == k)).toArrow().combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
        own = chosen.column("v").combine_chunks() if chosen.num_rows else pa.array([], pa.list_(pa.int64()))
        ids, labels = (chosen.column(c).to_numpy().copy() for c in ("id", "label"))
        held = spark.sparkContext.broadcast((ids, labels, matrix(own, width)))
        best = _first(search(rows, held), "a", POSITIVES).toPandas().sort_values(["a", "rank"])
        a, place, score = (best[c].to_numpy(np.int64) for c in ("a", "rank", "score"))
        g = a * POSITIVES + place - 1
        low, high = np.ones(len(ids) * POSITIVES, np.int64), np.zeros(len(ids) * POSITIVES, np.int64)
        low[g], high[g] = -(-LEAST * score // 100), MOST * score // 100
        bands = spark.sparkContext.broadcast((low, high))
        found = _first(_band_search(rows, held, bands, width, primes), "g", NEGATIVES)
        names = np.stack([g, ids[a], best["id"].to_numpy(np.int64), score], axis=1).tolist()
        positives = spark.createDataFrame(names, "g long, anchor_id long, positive_id long, positive_score long")
        some = scratch.stage(
            found.join(F.broadcast(positives), "g").select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"),
            ),
            "negatives",
        )
        out = some if out is None else out.union(some)
    return out
