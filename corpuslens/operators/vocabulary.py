"""Vocabularies: frequent words and endings, and subwords learned by merging symbol pairs."""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPECIAL_TOKENS, VOCAB_SIZE
from ..session import drop_stage, stage
from .rows import explode_rows
from .tokens import pre_tokens

MARK = "##"
#: Letters of the longest entry of a vocabulary of frequent pieces, and how many endings it has.
LONGEST_PIECE = 32
ENDINGS = 2000
#: Symbols of the words that one round of training may look at on the driver (some 200 MB), and
#: the pairs it ranks.
LOOK_AHEAD = 2_000_000
CANDIDATES = 1 << 15
#: Leading pairs at which the first round cuts words, and how many times as many a later round may take.
FIRST_REACH, GROWTH = 256, 4
_SLICE = 1 << 20
#: Pairs or runs that a task holds before it sums them.
_HELD = 1 << 21


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each word of the pre-split text occurs."""
    rows = explode_rows(df, [], pre_tokens(F.col(text)), "word")
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def symbols(word: Column) -> Column:
    """Letters of a word; all but the first carry the continuation mark."""
    letters = F.regexp_extract_all(word, F.lit("(?s)."), 0)
    return F.transform(letters, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(MARK), c)))


def pair_counts(counts: DataFrame) -> DataFrame:
    """How often two symbols are neighbours, over distinct words weighted by count."""
    return _count_pairs(counts.select(symbols(F.col("word")).alias("_s"), "n"))


def _count_pairs(split: DataFrame) -> DataFrame:
    pairs = F.transform(
        F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))),
        lambda s, i: F.struct(s.alias("a"), F.get(F.col("_s"), i + 1).alias("b")),
    )
    return (
        explode_rows(split, ["n"], pairs, "_p")
        .groupBy("_p.a", "_p.b")
        .agg(F.sum("n").alias("n"))
    )


def _letters(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a batch's words in one array, and where each word starts."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(), dtype=np.int64)])


def alphabet(counts: DataFrame) -> DataFrame:
    """(piece, n): every letter as the first of a word and as a later one, with its count there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, offsets = _letters(batch.column(0))
            keys = 2 * points + 1
            keys[offsets[:-1]] -= 1
            weights = np.repeat(batch.column(1).to_numpy(), np.diff(offsets))
            letters, at = np.unique(keys, return_inverse=True)
            n = np.zeros(len(letters), np.int64)
            np.add.at(n, at, weights)
            pieces = [MARK * (k & 1) + chr(k >> 1) for k in letters.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(pieces), pa.array(n)], ["piece", "n"])

    words = counts.where(F.length("word") > 0).select("word", F.col("n").cast("bigint").alias("n"))
    seen = words.mapInArrow(count, "piece string, n bigint")
    later = F.startswith("piece", F.lit(MARK)) & (F.length("piece") > len(MARK))
    letter = F.when(later, F.substring("piece", len(MARK) + 1, 1)).otherwise(F.col("piece"))
    both = F.explode(F.array(letter, F.concat(F.lit(MARK), letter)))
    found = seen.groupBy("piece").agg(F.sum("n").alias("n"))
    blank = found.select(both.alias("piece"), F.lit(0).cast("bigint").alias("n"))
    return found.unionByName(blank).groupBy("piece").agg(F.sum("n").alias("n"))


def _alphabet_list(counts: DataFrame, size: int) -> list[str]:
    """The alphabet by count. At most ``size`` rows reach the driver; a larger one is an error."""
    rows = alphabet(counts).orderBy(F.desc("n"), "piece").limit(size + 1).collect()
    if len(SPECIAL_TOKENS) + len(rows) > size:
        raise ValueError(f"the letters of the text alone need more than {size} entries")
    return [r["piece"] for r in rows]


def frequent_pieces(counts: DataFrame, size: int = VOCAB_SIZE, endings: int = ENDINGS) -> list[str]:
    """A vocabulary that splits every word of the text's letters into known pieces: the special
    tokens, all letters (first and later ones), the endings that most distinct words share, and the
    most frequent words up to ``size`` in all. At most ``size`` rows reach the driver."""
    letters = sorted(_alphabet_list(counts, size), key=lambda p: p.encode())
    room = size - len(SPECIAL_TOKENS) - len(letters)
    length = F.length("word")
    cuts = F.when(length > 2, F.sequence(F.greatest(F.lit(2), length - LONGEST_PIECE + 1), length - 1))
    tails = F.transform(cuts, lambda k: F.concat(F.lit(MARK), F.substring("word", k, length)))
    shared = explode_rows(counts, [], tails, "piece").groupBy("piece").agg(F.count("*").alias("n"))
    whole = counts.where((length >= 2) & (length <= LONGEST_PIECE)).select(F.col("word").alias("piece"), "n")
    vocab = dict.fromkeys(SPECIAL_TOKENS + letters)
    for rows, most in ((shared, min(endings, room)), (whole, None)):
        most = size - len(vocab) if most is None else most
        top = rows.orderBy(F.desc("n"), "piece").limit(most).collect()
        vocab |= dict.fromkeys(r["piece"] for r in top)
    return list(vocab)


def merged(a: str, b: str) -> str:
    return a + (b[len(MARK):] if b.startswith(MARK) else b)


def _flat(column: pa.ListArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch's words or runs in one array, and where each starts."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    if pa.types.is_binary(column.type):
        _, ends, held = column.buffers()
        offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
        values = np.frombuffer(held, np.int32, offsets[-1])
    else:
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy()
    return values[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def _pair_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair that starts at each symbol as one number (-1 at the end of a word), and the word of
    each symbol."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = np.full(len(values), -1, np.int64)
    keys[:-1] = np.where(row[:-1] == row[1:], values[:-1] << 32 | values[1:], -1)
    return keys, row


def _neighbours(words: DataFrame) -> DataFrame:
    """(a, b, n) of all neighbour pairs of symbol ids, n being the sum of the words' counts. Pairs
    are summed inside the tasks before they are dealt out."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, weights = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(keys)
        keys = keys[by]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(weights[by], first)
        ids = [pa.array((x).astype(np.int32)) for x in (keys[first] >> 32, keys[first] & 0xFFFFFFFF)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(n)], ["a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, row = _pair_keys(*_flat(batch.column(0)))
            some = np.flatnonzero(keys >= 0)
            parts.append((keys[some], batch.column(1).to_numpy()[row[some]]))
            held += len(some)
            if held > _HELD:
                yield summed(parts)
                parts, held = [], 0
        if held:
            yield summed(parts)

    rows = words.select("s", "n").mapInArrow(count, "a int, b int, n bigint")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _leading_pairs(pairs: DataFrame, vocab: list[str], most: int) -> list[tuple[int, int, int]]:
    """The first pairs by count and then by their symbols' text."""
    names = pa.table({"id": pa.array(range(len(vocab)), pa.int32()), "name": vocab})
    named = F.broadcast(pairs.sparkSession.createDataFrame(names))  # as long as the vocabulary
    rows = pairs.join(named.select(F.col("id").alias("a"), F.col("name").alias("x")), "a")
    rows = rows.join(named.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    top = rows.orderBy(F.desc("n"), "x", "y").limit(most).select("a", "b", "n").toArrow()
    return list(zip(*(top.column(c).to_pylist() for c in ("a", "b", "n"))))


def _first_pair(words: DataFrame, ranked: list[tuple[int, int, int]]) -> DataFrame:
    """(s, n, first): words that hold one of the ranked pairs, and the rank of the first they hold."""
    keys = np.array([a << 32 | b for a, b, _ in ranked], np.int64)
    by = np.argsort(keys)
    held = words.sparkSession.sparkContext.broadcast((keys[by], by))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = held.value
        for batch in batches:
            offsets = batch.column(0).offsets.to_numpy()
            values = batch.column(0).values.to_numpy().astype(np.int64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pair = values[:-1] << 32 | values[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == pair) & (row[:-1] == row[1:]))
            first = np.full(batch.num_rows, len(keys), np.int64)
            np.minimum.at(first, row[hit], rank[at[hit]])
            some = pa.array(np.flatnonzero(first < len(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(first).take(some)], ["s", "n", "first"])

    return words.select("s", "n").mapInArrow(find, "s array<int>, n bigint, first bigint")


def merge_pair(symbols: list[int], a: int, b: int, z: int) -> list[int]:
    """Every (a, b) becomes z, from left to right."""
    out, i, last = [], 0, len(symbols) - 1
    while i <= last:
        if i < last and symbols[i] == a and symbols[i + 1] == b:
            out.append(z)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def merge_rows(values: np.ndarray, offsets: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch after the merges, taken one after another. Words take their steps
    side by side: each step makes the first merge that a word still holds."""
    width = 1 + max(int(values.max(initial=0)), max(max(m) for m in merges))
    a, b, z = np.array(merges, np.int64).T
    count = len(merges)
    steps = np.sort((a * width + b) * count + np.arange(count))
    firsts, lengths = offsets[:-1].copy(), np.diff(offsets)
    out = values.copy()
    # Words that may still change, in rows of their own: their symbols, the row of each, the next merge.
    word = np.flatnonzero(lengths > 1)
    row = np.repeat(np.arange(len(word)), lengths[word])
    now = values[np.repeat(lengths > 1, lengths)]
    least = np.zeros(len(word), np.int64)
    while len(word):
        pair = np.where(row[:-1] == row[1:], now[:-1] * width + now[1:], -1)
        wanted = pair * count + least[row[:-1]]
        at = np.minimum(np.searchsorted(steps, wanted), count - 1)
        hit = np.flatnonzero((steps[at] // count == pair) & (steps[at] >= wanted))
        first = np.full(len(word), count, np.int64)
        np.minimum.at(first, row[hit], steps[at[hit]] % count)
        hit = hit[steps[at[hit]] % count == first[row[hit]]]
        # Of overlapping places of one symbol twice, every other one from the left.
        place = np.arange(len(hit))
        streak = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
        hit = hit[(place - np.maximum.accumulate(np.where(streak, place, 0))) % 2 == 0]
        now[hit] = z[first[row[hit]]]
        rest = np.ones(len(now), bool)
        rest[hit + 1] = False
        now, row = now[rest], row[rest]
        # A word without a further merge, or of one symbol, is done.
        size = np.bincount(row, minlength=len(word))
        on = (first < count) & (size > 1)
        done = np.flatnonzero(~on)
        lengths[word[done]] = size[done]
        ended = np.repeat(~on, size)
        start = np.cumsum(size) - size
        inside = np.arange(len(now)) - np.repeat(start, size)
        out[(firsts[word[row]] + inside)[ended]] = now[ended]
        now, row = now[~ended], (np.cumsum(on) - 1)[row[~ended]]
        word, least = word[on], first[on] + 1
    kept = np.arange(len(values)) - np.repeat(firsts, np.diff(offsets)) < np.repeat(lengths, np.diff(offsets))
    return out[kept], np.concatenate([[0], np.cumsum(lengths)])


def _merge_words(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(s, n): words after the merges. A word of one symbol holds no pair any more and goes."""
    held = words.sparkSession.sparkContext.broadcast(merges)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = merge_rows(*_flat(batch.column(0)), held.value)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
            out = pa.RecordBatch.from_arrays([lists, batch.column(1)], ["s", "n"])
            yield out.filter(pa.array(np.diff(offsets) > 1))

    return words.select("s", "n").mapInArrow(apply, "s array<int>, n bigint")


def _runs(words: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(run, n): the longest parts of words in which all neighbours are one of ``pairs``, as bytes of
    32-bit ids, and how often each occurs. ``words`` may be runs of more pairs."""
    held = words.sparkSession.sparkContext.broadcast(np.sort(np.array([a << 32 | b for a, b, _ in pairs], np.int64)))

    def cut(batch: pa.RecordBatch) -> pa.Table:
        values, offsets = _flat(batch.column(0))
        keys, row = _pair_keys(values, offsets)
        known = held.value
        on = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        before = np.concatenate([[False], on[:-1]])
        starts = np.flatnonzero(on & ~before)
        ends = np.flatnonzero(~on & before)
        size = 4 * np.concatenate([[0], np.cumsum(ends - starts + 1)])
        symbols = values[on | before].astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(symbols)])
        return pa.table({"run": binary, "n": batch.column(1).to_numpy()[row[starts]]})

    def summed(parts: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(parts).group_by("run").aggregate([("n", "sum")])
        return pa.table({"run": rows.column("run"), "n": rows.column("n_sum")})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(cut(batch))
            held += parts[-1].num_rows
            if held > _HELD:
                parts = [summed(parts)]
                held = parts[0].num_rows
                if held > _HELD // 2:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
        if held:
            yield from summed(parts).to_batches()

    rows = words.select(words.columns[0], "n").mapInArrow(find, "run binary, n bigint")
    return rows.groupBy("run").agg(F.sum("n").alias("n"))


class _Borders:
    """What may hide where words were cut into runs.

    A run ends between two symbols that are no covered pair. Merges on both sides make other pairs
    of the two places, each at most as often as the cut pair (l, f) was there. So the pair (x, y) hides
    at most the sum over the symbols l that x may have ended with, and those that y may have begun with,
    when the round began. These are one each, unless a token was made in two ways; only then can a
    pair both show in runs and hide between them, or hide more often than ``most``.
    """

    def __init__(self, covered: list[tuple[int, int, int]], rest: list[tuple[int, int, int]], floor: int):
        self.most = self.floor = floor
        self.cut: dict[tuple[int, int], int] = {(a, b): 0 for a, b, _ in covered}
        self.after, self.before = defaultdict(set), defaultdict(set)
        for a, b, n in rest:
            self.cut[a, b] = n
            self.after[a].add(b)
            self.before[b].add(a)
            self.most = max(self.most, n)
        self.lasts: dict[int, frozenset[int]] = {}
        self.firsts: dict[int, frozenset[int]] = {}
        self.many_lasts: set[int] = set()
        self.many_firsts: set[int] = set()

    def hidden(self, x: int, y: int) -> int:
        """How often the pair may be there between runs, where it also shows in them."""
        if x not in self.many_lasts and y not in self.many_firsts:
            return 0
        return self._sum(self._lasts(x), self._firsts(y))

    def make(self, a: int, b: int, z: int, new: bool) -> tuple[bool, bool]:
        """(a, b) becomes z. Tells whether an older z may now end, or begin, with a further symbol."""
        lasts, firsts = self._lasts(b), self._firsts(a)
        if not new:
            lasts, firsts = lasts | self._lasts(z), firsts | self._firsts(z)
        ends, begins = not new and lasts != self._lasts(z), not new and firsts != self._firsts(z)
        self.lasts[z], self.firsts[z] = lasts, firsts
        if len(lasts) > 1:
            self.many_lasts.add(z)
        if len(firsts) > 1:
            self.many_firsts.add(z)
        if len(lasts) > 1 and (new or ends):
            others = set().union(*(self.after.get(x, ()) for x in lasts))
            single = max((self._sum(lasts, {y}) for y in others), default=0)
            several = max((self._sum(lasts, self._firsts(y)) for y in self.many_firsts), default=0)
            self.most = max(self.most, single, several, len(lasts) * self.floor)
        if len(firsts) > 1 and (new or begins):
            others = set().union(*(self.before.get(y, ()) for y in firsts))
            single = max((self._sum({x}, firsts) for x in others), default=0)
            several = max((self._sum(self._lasts(x), firsts) for x in self.many_lasts), default=0)
            self.most = max(self.most, single, several, len(firsts) * self.floor)
        return ends, begins

    def _lasts(self, x: int) -> frozenset[int]:
        return self.lasts.get(x) or frozenset((x,))

    def _firsts(self, y: int) -> frozenset[int]:
        return self.firsts.get(y) or frozenset((y,))

    def _sum(self, lasts, firsts) -> int:
        return sum(self.cut.get((x, y), self.floor) for x in lasts for y in firsts)


def leading_merges(
    words: list[list[int]] | pa.ListArray | pa.BinaryArray, weights: list[int] | pa.Array, covered: list[tuple[int, int, int]],
    bound: tuple[int, int, int] | None, vocab: list[str], size: int, borders: _Borders | None = None,
) -> list[tuple[int, int, int]]:
    """The merges that one-at-a-time training takes next, as far as these words can tell.

    ``words`` are all words that hold a ``covered`` pair; every other pair comes after ``bound`` (a,
    b, n) or is not there. A pair of a new symbol lies in these words alone, so its count is known. A
    pair that grows without being covered may have up to ``bound``'s count elsewhere; when that
    would make it the next, the round ends.

    With ``borders`` they are the runs of covered pairs that words were cut into. The round then also
    ends where a pair that hides between runs may be the next, or a part of the next one may hide.

    The symbols stay in one flat array, a word's own being rewritten in its place, and only the
    words of covered and new pairs are indexed.
    """
    lists = words if isinstance(words, pa.Array) else pa.array(words, pa.list_(pa.int32()))
    values, offsets = _flat(lists)
    flat = array("i", values.astype(np.int32).tobytes())
    starts = array("q", offsets[:-1].tobytes())
    lengths = array("i", np.diff(offsets).astype(np.int32).tobytes())
    weights = array("q", np.asarray(weights, np.int64).tobytes())
    exact = {(a, b): n for a, b, n in covered}
    where: dict[tuple[int, int], array] = defaultdict(lambda: array("i"))
    where.update(_rows_of_pairs(values, offsets, covered))

    ids = {t: i for i, t in enumerate(vocab)}
    known = len(vocab)
    delta: dict[tuple[int, int], int] = defaultdict(int)
    most = bound[2] if bound else 0

    def entry(p):
        if p in exact:
            n = exact[p] + delta[p]
        elif borders or p[0] >= known or p[1] >= known:
            n = delta[p]
        else:
            n = most + delta[p] if delta[p] > 0 else 0
        if borders and n:
            n += borders.hidden(*p)
        return -n, vocab[p[0]], vocab[p[1]], *p

    heap = [entry(p) for p in exact if p in where]
    heapq.heapify(heap)
    pushed: dict[tuple[int, int], int] = {}
    end = (-bound[2], vocab[bound[0]], vocab[bound[1]]) if bound else None
    merges = []
    while heap and len(vocab) < size:
        best = heapq.heappop(heap)
        a, b = best[3:]
        if best != entry((a, b)) or not best[0]:
            continue  # its count has changed since; the newer entry counts
        if end and best[:3] > end:
            break
        if borders:
            if merges and (-best[0] <= borders.most or borders.hidden(a, b)):
                break
        elif end and (a, b) not in exact and a < known and b < known:
            break
        token = merged(vocab[a], vocab[b])
        fresh = token not in ids
        if fresh:
            ids[token] = len(vocab)
            vocab.append(token)
        z = ids[token]
        merges.append((a, b, z))
        changed = set()
        if borders:
            ends, begins = borders.make(a, b, z, fresh)
            # What may hide has grown for the pairs of z.
            if ends or begins:
                changed.update(p for p in where if ends and p[0] == z or begins and p[1] == z)
        for k in set(where.pop((a, b))):
            start, length = starts[k], lengths[k]
            old = flat[start : start + length].tolist()
            new = merge_pair(old, a, b, z)
            if len(new) == length:
                continue
            flat[start : start + len(new)] = array("i", new)
            n, lengths[k] = weights[k], len(new)
            for p in zip(old, old[1:]):
                delta[p] -= n
                changed.add(p)
            for p in zip(new, new[1:]):
                delta[p] += n
                changed.add(p)
                if z in p or p == (a, b):
                    where[p].append(k)
        for p in changed:
            now = entry(p)
            if not now[0]:
                pushed.pop(p, None)
            elif pushed.get(p) != now[0]:
                pushed[p] = now[0]
                heapq.heappush(heap, now)
    return merges


def _rows_of_pairs(values: np.ndarray, offsets: np.ndarray, covered: list[tuple[int, int, int]]) -> dict[tuple[int, int], array]:
    """The words that hold each covered pair, by slices of the flat symbols."""
    keys = np.array([a << 32 | b for a, b, _ in covered], np.int64)
    by = np.argsort(keys)
    keys, found = keys[by], []
    for low in range(0, max(len(values) - 1, 0), _SLICE):
        part = values[low : low + _SLICE + 1].astype(np.int64)
        pair = part[:-1] << 32 | part[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == pair)
        row = np.searchsorted(offsets, hit + low, side="right") - 1
        inside = hit + low + 1 < offsets[row + 1]
        found.append((by[at[hit[inside]]].astype(np.int32), row[inside].astype(np.int32)))
    if not found:
        return {}
    rank, row = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(rank, kind="stable")
    rank, row = rank[order], row[order]
    edges = np.searchsorted(rank, np.arange(len(covered) + 1))
    return {
        (a, b): array("i", row[low:high].tobytes())
        for (a, b, _), low, high in zip(covered, edges[:-1].tolist(), edges[1:].tolist())
        if high > low
    }


def safe_merges(ranked: list[tuple[int, int, int]], vocab: list[str], size: int, complete: bool) -> list[tuple[int, int, int]]:
    """The leading pairs that one-at-a-time merging would also take next, by their counts alone.

    After merging (a, b) a new pair can occur at most as often as the most frequent pair that
    touches a's left or b's right side, so a later pair that is strictly more frequent than this
    and shares no symbol comes before every new pair. A merge that makes a symbol already in
    use adds to existing pairs and ends the round. ``complete``: there are no further pairs.
    """
    known, used, chosen, ceiling = set(vocab), set(), [], 0
    floor = 0 if complete else ranked[-1][2]
    for a, b, n in ranked:
        if len(vocab) >= size or chosen and (n <= ceiling or a in used or b in used):
            break
        token = merged(vocab[a], vocab[b])
        used |= {a, b}
        if token in known:
            chosen.append((a, b, vocab.index(token)))
            break
        known.add(token)
        chosen.append((a, b, len(vocab)))
        vocab.append(token)
        touching = [min(m, n) for x, y, m in ranked if (x, y) != (a, b) and (y == a or x == b)]
        ceiling = max([ceiling, n if a == b else 0, floor, *touching])
    return chosen


def train_vocabulary(counts: DataFrame, size: int = VOCAB_SIZE, look_ahead: int = LOOK_AHEAD) -> list[str]:
    """Learn a subword vocabulary of at most ``size`` tokens: special tokens, all letters (first and
    later ones), then the most frequent neighbour pair again and again, whatever its count.

    A round takes many merges, the same ones as merging one at a time. Words are cut into runs of
    the leading pairs, as many pairs as give ``look_ahead`` symbols in distinct runs; the runs are
    indexed by pair, so a merge touches only those that hold it (``leading_merges``). Few words
    are taken whole. Where even the first pair's are too many, the counts alone tell which
    merges are safe. Spark applies the merges to the words and counts the pairs anew.
    """
    spark = counts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = stage(counts)
    vocab = SPECIAL_TOKENS + _alphabet_list(counts, size)
    words = stage(_symbol_ids(counts.repartition(tasks), vocab).where(F.size("s") > 1))
    drop_stage(counts)
    reach = FIRST_REACH
    while len(vocab) < size:
        ranked = _leading_pairs(_neighbours(words), vocab, CANDIDATES)
        if not ranked:
            break
        merges, reach = _next_merges(words, ranked, vocab, size, look_ahead, reach)
        if len(vocab) >= size:
            break
        after = stage(_merge_words(words, merges))
        drop_stage(words)
        words = after
    drop_stage(words)
    return vocab


def _symbol_ids(counts: DataFrame, vocab: list[str]) -> DataFrame:
    """(s, n): the ids of each word's letters."""
    ids = {t: i for i, t in enumerate(vocab)}
    letters = sorted({t[-1] for t in vocab if len(t) == 1 or len(t) == len(MARK) + 1 and t.startswith(MARK)})
    # Every letter has both forms.
    forms = [np.array([ids[mark + c] for c in letters], np.int32) for mark in ("", MARK)]
    held = counts.sparkSession.sparkContext.broadcast((np.array([ord(c) for c in letters], np.int64), *forms))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, first, later = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            letters, offsets = _letters(batch.column(0))
            at = np.searchsorted(points, letters)
            symbols = later[at]
            symbols[offsets[:-1]] = first[at[offsets[:-1]]]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(symbols))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["s", "n"])

    return counts.select("word", "n").mapInArrow(convert, "s array<int>, n bigint")


def _next_merges(
    words: DataFrame, ranked: list[tuple[int, int, int]], vocab: list[str], size: int, look_ahead: int, reach: int
) -> tuple[list[tuple[int, int, int]], int]:
    """The merges of a round, and the number of pairs to cut words at in the next one."""
    complete = len(ranked) < CANDIDATES
    symbols = words.agg(F.sum(F.size("s"))).first()[0]
    reach = min(reach, len(ranked) if complete else len(ranked) - 1)
    if symbols > look_ahead and reach:
        merges, taken, held = _merges_of_runs(words, ranked, vocab, size, look_ahead, reach, complete)
        if merges:
            return merges, max(1, int(taken * min(GROWTH, 0.8 * look_ahead / max(held, 1))))
    return _merges_of_words(words, ranked, vocab, size, look_ahead, complete), reach


def _merges_of_runs(
    words: DataFrame, ranked: list[tuple[int, int, int]], vocab: list[str], size: int, look_ahead: int, reach: int, complete: bool
) -> tuple[list[tuple[int, int, int]], int, int]:
    """The merges that the runs of the first pairs tell, how many pairs these were, and the symbols of the
    runs. No merges where whole words tell more: the first pairs are as frequent as the first one left out."""
    floor = 0 if complete else ranked[-1][2]
    runs, held = words, look_ahead + 1
    while held > look_ahead:
        if not reach or reach < len(ranked) and ranked[0][2] == ranked[reach][2]:
            break
        # Runs of fewer pairs are parts of the runs of more.
        cut = stage(_runs(runs, ranked[:reach]))
        if runs is not words:
            drop_stage(runs)
        runs, taken = cut, reach
        held = runs.agg(F.sum(F.length("run"))).first()[0] // 4
        reach = min(reach // 2, int(reach * look_ahead / held))
    merges = []
    if held <= look_ahead:
        seen = runs.toArrow().combine_chunks()
        bound = ranked[taken] if taken < len(ranked) else None
        borders = _Borders(ranked[:taken], ranked[taken:], floor)
        merges = leading_merges(seen.column("run").chunk(0), seen.column("n").chunk(0), ranked[:taken], bound, vocab, size, borders)
    if runs is not words:
        drop_stage(runs)
    return merges, taken if merges else 0, held


def _merges_of_words(
    words: DataFrame, ranked: list[tuple[int, int, int]], vocab: list[str], size: int, look_ahead: int, complete: bool
) -> list[tuple[int, int, int]]:
    """The merges that whole words tell, or else the counts alone."""
    holding = _first_pair(words, ranked)
    # How many symbols each pair's words add: at most CANDIDATES rows.
    sizes = holding.groupBy("first").agg(F.sum(F.size("s")).alias("symbols")).toArrow()
    added = np.zeros(len(ranked), np.int64)
    added[sizes.column("first").to_numpy()] = sizes.column("symbols").to_numpy()
    reach = int(np.searchsorted(np.cumsum(added), look_ahead, side="right"))
    reach = min(reach, len(ranked) if complete else len(ranked) - 1)
    if not reach:
        return safe_merges(ranked, vocab, size, complete)
    seen = holding.where(F.col("first") < reach).select("s", "n").toArrow().combine_chunks()
    bound = ranked[reach] if reach < len(ranked) else None
    return leading_merges(seen.column("s").chunk(0), seen.column("n").chunk(0), ranked[:reach], bound, vocab, size)
