"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The seeds of a test item are its rare runs of three words: those in at most ``RARE_TIMES`` as many
   documents (plus ``RARE_DOCS``) as its typical run that occurs at all, and in few items. Being
   relative, the rule leaves seeds to an item that leaked into most documents.
2. Copies with words changed may keep only common runs. A document that shares such a run is looked
   at only if it holds as many of the item's words as an alignment that scores enough has to
   match, which loses nothing and is counted for all pairs at once on sorted hashes.
3. A document gets a window around each seed, as wide as the item and a margin. Windows of one item
   that touch are one window. A window that holds too few of the item's words for the score
   is not aligned: no alignment matches more words than those.
4. Words of item and window are locally aligned (match 2, other word or gap -1). The score
   is the alignment's share of a perfect one, so copies with words changed, dropped or put
   in score high and chance hits low.

The benchmark is taken in blocks of a fixed number of bytes: each block is small enough to
be sent to every task, and further blocks cost further passes. A block takes two passes: one
counts the documents that hold its runs. Documents are only read.

Missing or empty texts, and items without words, match nothing. An item of fewer than eight
words must be there as a whole. Repeated rows are found each. Of equal alignments the one that
ends first in item and text is reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .wordhash import Words, mix, ngrams, slices, words

SEED_WORDS = 3
#: A run is rare beside its item's typical one, and in at most so many items.
RARE_TIMES, RARE_DOCS, SHARED_ITEMS = 20, 20, 50
MATCH, OTHER, GAP = 2, -1, -1
SCORE = 0.45
LEAST_WORDS = 8
BLOCK_BYTES = 8 << 20


class Index(NamedTuple):
    """Sorted hashes; each row of the other two arrays that ``bounds`` gives for a hash is an item
    and a place in it."""

    keys: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


class Items(NamedTuple):
    """A block of test items: their words and the indexes of their rare and of their common runs."""

    ids: list
    words: list[np.ndarray]
    rare: Index
    common: Index


def index(keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> Index:
    order = np.lexsort((place, item, keys))
    keys, item, place = keys[order], item[order], place[order]
    unique, start = np.unique(keys, return_index=True)
    sieve = np.zeros(1 << 20, bool)
    sieve[unique & np.uint64(0xFFFFF)] = True
    return Index(unique, np.append(start, len(keys)), item, place, sieve)


def least_words(n: int, least: float = SCORE) -> int:
    """Words of an item of ``n`` that an alignment has to match."""
    return max(int(np.ceil(least * n - 1e-9)), min(LEAST_WORDS, n))


def prepare(ids: list, texts: list[str | None]) -> Items:
    """All runs count as rare until documents are counted."""
    found = words(pa.array(texts, pa.string()))
    gram, row, first = ngrams(found.hashes, found.bounds, SEED_WORDS)
    own = [found.hashes[a:b] for a, b in zip(found.bounds, found.bounds[1:])]
    return Items(ids, own, index(gram, row, first - found.bounds[row]), index(gram[:0], row[:0], row[:0]))


def lookup(held: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which elements of ``hashes`` are in the index, and where."""
    if not len(held.keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    maybe = np.flatnonzero(held.sieve[hashes & np.uint64(0xFFFFF)])
    at = np.minimum(np.searchsorted(held.keys, hashes[maybe]), len(held.keys) - 1)
    hit = held.keys[at] == hashes[maybe]
    return maybe[hit], at[hit]


def postings(held: Index, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit, item, place in the item) of all entries of the hits of ``lookup``."""
    n = np.diff(held.bounds)[at]
    entry = np.repeat(held.bounds[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(which, n), held.item[entry], held.place[entry]


def document_frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each run of the block occurs."""
    held = texts.sparkSession.sparkContext.broadcast(tuple(items))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(*held.value).rare
        total = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                found = words(part)
                gram, row, _ = ngrams(found.hashes, found.bounds, SEED_WORDS)
                which, at = lookup(own, gram)
                pairs = np.unique(row[which] * len(own.keys) + at)
                np.add.at(total, pairs % max(1, len(own.keys)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["g", "n"])

    sums = texts.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.rare.keys), np.int64)
    out[sums["g"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def choose_seeds(items: Items, run_docs: np.ndarray) -> Items:
    """Tell rare runs from common ones; runs that no document holds are dropped."""
    runs = items.rare
    of_key = np.repeat(np.arange(len(runs.keys)), np.diff(runs.bounds))
    docs = run_docs[of_key]
    occurs = docs > 0
    typical = np.ones(len(items.ids))
    by = np.lexsort((docs[occurs], runs.item[occurs]))
    own, sorted_docs = runs.item[occurs][by], docs[occurs][by]
    ids, start, n = np.unique(own, return_index=True, return_counts=True)
    typical[ids] = sorted_docs[start + (n - 1) // 2]
    new = np.ones(len(of_key), bool)
    new[1:] = (runs.item[1:] != runs.item[:-1]) | (of_key[1:] != of_key[:-1])
    n_items = np.bincount(of_key[new], minlength=len(runs.keys))
    rare = (docs <= RARE_TIMES * typical[runs.item] + RARE_DOCS) & (n_items[of_key] <= SHARED_ITEMS)
    parts = [index(runs.keys[of_key][keep], runs.item[keep], runs.place[keep]) for keep in (occurs & rare, occurs & ~rare)]
    return items._replace(rare=parts[0], common=parts[1])


def holding_enough(pairs: np.ndarray, items: Items, found: Words, least: float) -> np.ndarray:
    """Those of the sorted pairs (row * items + item) whose text holds as many of the item's words as
    an alignment has to match."""
    n_items = len(items.ids)
    row_of = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    held = np.unique(mix(found.hashes ^ mix(row_of.astype(np.uint64) + np.uint64(1))))
    flat = np.concatenate([*items.words, np.zeros(0, np.uint64)])
    lengths = np.array([len(w) for w in items.words], np.int64)
    starts = np.cumsum(lengths) - lengths
    least_of = np.array([least_words(n, least) for n in lengths.tolist()], np.int64)
    kept = []
    for low in range(0, len(pairs), 20_000):
        part = pairs[low : low + 20_000]
        row, item = part // n_items, part % n_items
        n = lengths[item]
        ends = np.cumsum(n)
        place = np.repeat(starts[item] - (ends - n), n) + np.arange(ends[-1])
        key = mix(flat[place] ^ mix(np.repeat(row, n).astype(np.uint64) + np.uint64(1)))
        at = np.minimum(np.searchsorted(held, key), len(held) - 1)
        sums = np.concatenate([[0], np.cumsum(held[at] == key)])
        kept.append(part[sums[ends] - sums[ends - n] >= least_of[item]])
    return np.concatenate([*kept, pairs[:0]])


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, words of the item, words of the window up to its end).

    A row of the matrix at a time; gaps along the row come from a running maximum.
    """
    ramp = np.arange(len(window) + 1, dtype=np.int64) * -GAP
    before = np.zeros(len(window) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        now = np.zeros(len(window) + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(window == word, MATCH, OTHER), before[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp) - ramp
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i + 1, j)
        before = now
    return best


def windows(hits: np.ndarray, n_words: int, n_text: int) -> list[tuple[int, int]]:
    """Ranges of the text around the places where an item would begin, joined where they touch."""
    margin = max(8, n_words // 4)
    out: list[tuple[int, int]] = []
    for begin in np.unique(hits):
        low, high = max(0, int(begin) - margin), min(n_text, int(begin) + n_words + margin)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def leaks_in(column: pa.Array, items: Items, least: float = SCORE) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the best alignment per row and item."""
    found = words(column)
    gram, row, first = ngrams(found.hashes, found.bounds, SEED_WORDS)
    n_items = max(1, len(items.ids))

    def hits(held: Index, which: np.ndarray, at: np.ndarray):
        hit, item, place = postings(held, which, at)
        return row[hit], item, first[hit] - found.bounds[row[hit]] - place

    rows, item, begin = hits(items.rare, *lookup(items.rare, gram))
    which, at = lookup(items.common, gram)
    if len(which):
        # Every run of a text once: only pairs that can score are followed to all their places.
        _, once = np.unique(row[which] * len(items.common.keys) + at, return_index=True)
        hit, other, _ = postings(items.common, which[once], at[once])
        rare_pairs, common_pairs = np.unique(rows * n_items + item), np.unique(row[hit] * n_items + other)
        able = holding_enough(np.setdiff1d(common_pairs, rare_pairs, assume_unique=True), items, found, least)
        able = np.concatenate([able, np.intersect1d(common_pairs, rare_pairs, assume_unique=True)])
        some = np.isin(row[which], able // n_items)
        more = hits(items.common, which[some], at[some])
        keep = np.isin(more[0] * n_items + more[1], able)
        rows, item, begin = (np.concatenate([a, b[keep]]) for a, b in zip((rows, item, begin), more))
    order = np.lexsort((begin, item, rows))
    rows, item, begin = rows[order], item[order], begin[order]
    cuts = np.flatnonzero((np.diff(rows) != 0) | (np.diff(item) != 0)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a == b:
            continue
        r, i = int(rows[a]), int(item[a])
        text, own = found.hashes[found.bounds[r] : found.bounds[r + 1]], items.words[i]
        enough = max(least * MATCH * len(own), MATCH * min(LEAST_WORDS, len(own)))
        best = (0, 0, 0, 0)
        for low, high in windows(begin[a:b], len(own), len(text)):
            if MATCH * np.isin(own, text[low:high]).sum() < enough:
                continue
            score, x, y = align(own, text[low:high])
            if score > best[0]:
                best = (score, x, low, low + y)
        score, x, low, end = best
        if score and score >= enough:
            _, _, back = align(own[:x][::-1], text[low:end][::-1])
            out.append((r, i, score / (MATCH * len(own)), end - back, end))
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", least: float = SCORE,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): test items found in documents."""
    return _leaks(docs, benchmark, doc_id, text, item_id, item_text, least).drop("t")


def _leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: float
) -> DataFrame:
    """``find_leaks`` and t, which tells texts of one doc_id apart."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        chosen = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = prepare([r["item_id"] for r in chosen], [r["text"] for r in chosen])
        items = choose_seeds(items, document_frequencies(docs.select(body.alias("text")), items))
        held = spark.sparkContext.broadcast(tuple(items))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = Items(*held.value)
            for batch in batches:
                for start, part in slices(batch.column(2)):
                    hits = leaks_in(part, block, least)
                    if hits:
                        row, item, score, first, end = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(batch.column(c).take(pa.array([start + r for r in row])) for c in (0, 1)),
                                pa.array([block.ids[i] for i in item], batch_type),
                                pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()),
                            ],
                            ["doc_id", "t", "item_id", "score", "first_word", "end_word"],
                        )

        batch_type = to_arrow_type(benchmark.schema[item_id].dataType)
        some = docs.select(doc_id, F.xxhash64(body).alias("t"), body.alias("text")).mapInArrow(
            search, f"doc_id {kind}, t long, item_id {item_kind}, score double, first_word long, end_word long"
        )
        found = some if found is None else found.unionByName(some)
    return found.withColumnRenamed("doc_id", doc_id).withColumnRenamed("item_id", item_id)


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SCORE) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item."""
    # A drawn name, so that no column of docs can have it.
    own, row = f"k{uuid.uuid4().hex}", f"r{uuid.uuid4().hex}"
    leaked = _leaks(docs, benchmark, doc_id, text, "item_id", "text", least).select(F.struct(F.col(doc_id).alias("a"), "t").alias(own)).distinct()
    known = F.struct(F.col(doc_id).alias("a"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"))
    return docs.withColumn(row, known).join(leaked, F.col(row).eqNullSafe(F.col(own)), "left_anti").drop(row)
