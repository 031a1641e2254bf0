"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. Shingles are runs of five words. A shingle weighs its count in the document times an
   inverse document frequency. Frequencies are exact over all documents; those below
   1/200 of the documents (or 10) count as that floor, so the table of shingles above the
   floor is bounded: at most 200 times the mean number of shingles of a document.
2. Texts of equal words are one node from here on.
3. Improved consistent weighted sampling (Ioffe 2010) draws 56 samples per node; bands of
   four samples are the bucket keys. Two texts of similarity 0.8 share a bucket with
   probability 1 - (1 - 0.8^4)^14 = 0.9994.
4. In each bucket all members are compared with its first and last one. What that leaves in
   different components of a bucket is compared pair by pair, members outside a bucket's
   largest component with the bucket in salted parts, so at most twice the pairs that lie in
   different components are formed. The similarity is at most the ratio of the two total
   weights, so pairs with too low a ratio need no text.
   Where this is more than a few pairs per member, three steps come before it. The member
   that was similar to most of what it met, as the original of many edited copies is, becomes
   a leader too. Then the weight of the shingles that a node shares with any other node left
   bounds its similarity to every one of them: copies with many edits of their own can have
   no partner, and pairs are formed only between weights that the bounds allow and whose
   1024 further samples, a bit of each, differ no more than those of similar texts do. If that
   still leaves more, new leaders are taken (twice as many each turn) until it does not. So no pair
   of one bucket that could join two classes is left out, and no bucket is capped.
5. Pairs are verified by their exact weighted Jaccard similarity; classes are the connected
   components of the pairs at or above the threshold.

Texts without words are only put together when they are equal; a missing text is an empty
one. Repeated rows get the same class. A class is named by its smallest doc_id (null where
all its doc_ids are).
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .components import connected_components
from .staging import Scratch
from .wordhash import mix, ngrams, row_counts, slices, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Document frequencies below this share of the documents count as this share.
FREQUENCY_FLOOR = 1 / 200
LEAST_FLOOR = 10
#: Weight of a shingle that every document has, where a rare one weighs 1.
COMMON_WEIGHT = 0.5
#: Hashes per round of exact counting; more candidates are counted in further rounds.
COUNT_BLOCK = 4_000_000
#: 64-bit words of the filter that keeps texts from moving: 16 MB whatever the data.
FILTER_WORDS = 1 << 21
#: 64-bit words of one-bit samples by which the pairs of hot buckets are told apart.
BIT_WORDS = 16
#: Pairs of one bucket that are formed together; a bucket of more is dealt out in parts.
PART_PAIRS = 100_000
#: Weight cells from one weight to the least that is similar enough; pairs are formed cell by cell.
CELLS = 4
#: Pairs formed within the bounds, for each pair that may be compared; most fail a bound of their own.
FORMED = 16


def _text_column(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def shingle_counts(column: pa.Array):
    """(hash, row, count, row bounds) of the distinct shingles of each row."""
    found = words(column)
    gram, rows, _ = ngrams(found.hashes, found.bounds, SHINGLE_WORDS)
    return found, row_counts(gram, rows, len(column))


def _frequent_locally(texts: DataFrame, share: float) -> DataFrame:
    """Shingles that reach their share of the documents in some block of documents.

    A shingle of a share of all documents has that share in at least one block.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, n_docs = [], 0, 0

        def flush():
            if not held:
                return
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = values[counts >= np.ceil(n_docs * share - 1e-9)]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(keep.view(np.int64))], ["h"])

        for batch in batches:
            for _, part in slices(batch.column(0)):
                _, (gram, _, _, _) = shingle_counts(part)
                held.append(gram)
                n_held += len(gram)
                n_docs += len(part)
                if n_held >= COUNT_BLOCK:
                    yield from flush()
                    held, n_held, n_docs = [], 0, 0
        yield from flush()

    return texts.mapInArrow(find, "h long").distinct()


def _exact_counts(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Document frequencies of the sorted hashes ``wanted``."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                _, (gram, _, _, _) = shingle_counts(part)
                at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                np.add.at(total, at[keys[at] == gram], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["h", "n"])

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_shingles(texts: DataFrame, n_docs: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of all shingles above the frequency floor."""
    floor = max(LEAST_FLOOR, n_docs * FREQUENCY_FLOOR)
    if n_docs <= floor:
        return np.zeros(0, np.uint64), np.zeros(0)
    candidates = scratch.stage(_frequent_locally(texts, floor / n_docs), "frequent")
    blocks = -(-candidates.count() // COUNT_BLOCK)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for k in range(blocks):
        own = candidates if blocks == 1 else candidates.filter(F.pmod("h", F.lit(blocks)) == k)
        wanted = np.sort(own.toPandas()["h"].to_numpy().view(np.uint64))
        found = _exact_counts(texts, wanted).filter(F.col("n") > floor).toPandas()
        hashes.append(found["h"].to_numpy(np.int64).view(np.uint64))
        counts.append(found["n"].to_numpy(np.float64))
    scratch.drop(candidates)
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    idf = np.log(n_docs / n[order]) / np.log(n_docs / floor)
    return h[order], COMMON_WEIGHT + (1 - COMMON_WEIGHT) * idf


def weights(gram: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, idf = frequent
    out = counts.astype(np.float64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)
        hit = hashes[at] == gram
        out[hit] *= idf[at[hit]]
    return out


def _gamma_quantiles() -> np.ndarray:
    """65536 quantiles of Gamma(2, 1), by interpolation of its distribution function."""
    x = np.concatenate([np.geomspace(1e-5, 1, 4000), np.linspace(1, 40, 8000)[1:]])
    p = 1 - np.exp(-x) * (1 + x)
    return np.interp((np.arange(65536) + 0.5) / 65536, p, x).astype(np.float32)


def sample(gram: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_rows: int, n_samples: int, skip: int = 0) -> np.ndarray:
    """Consistent weighted samples after the first ``skip``: for each row and sample the hash of (shingle, level)."""
    r_of = _gamma_quantiles()
    inverse_r = 1 / r_of
    best = np.full((n_samples, n_rows), np.inf, np.float32)
    found = np.zeros((n_samples, n_rows), np.uint64)
    seeds = mix(np.arange(101 + skip, 101 + skip + n_samples, dtype=np.uint64))
    u16, u24, u40, u48 = (np.uint64(k) for k in (16, 24, 40, 48))
    for low in range(0, len(gram), 1 << 15):
        g, row = gram[low : low + (1 << 15)], rows[low : low + (1 << 15)]
        log_w = np.log(weight[low : low + (1 << 15)]).astype(np.float32)
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lengths = np.diff(np.append(at, len(row)))
        own = row[at]
        for k in range(n_samples):
            x = mix(g ^ seeds[k])
            u = ((x >> u40).astype(np.float32) + 0.5) * np.float32(2**-24)
            v = (((x >> u16) & np.uint64(0xFFFFFF)).astype(np.float32) + 0.5) * np.float32(2**-24)
            log_c = np.log(-np.log(u) - np.log(v))
            beta = ((x & np.uint64(0xFFFF)).astype(np.float32) + 0.5) * np.float32(1 / 65536)
            pick = ((x * np.uint64(0xD6E8FEB86659FD93)) >> u48).astype(np.int64)
            level = np.floor(log_w * inverse_r[pick] + beta)
            log_a = log_c - r_of[pick] * (level - beta + 1)
            least = np.minimum.reduceat(log_a, at)
            hit = np.flatnonzero(log_a == np.repeat(least, lengths))
            hit_row = row[hit]
            first = np.concatenate([[True], hit_row[1:] != hit_row[:-1]])
            hit = hit[first]
            better = least < best[k, own]
            best[k, own[better]] = least[better]
            chosen = hit[better]
            found[k, own[better]] = mix(g[chosen] ^ mix(level[chosen].astype(np.int64).view(np.uint64)))
    return found


def sample_bits(gram: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """(row, word): one bit of each of 64 samples a word, other samples than those of the buckets."""
    out, place = np.empty((n_rows, BIT_WORDS), np.uint64), np.arange(64, dtype=np.uint64)[:, None]
    for k in range(BIT_WORDS):
        drawn = sample(gram, rows, weight, n_rows, 64, BANDS * ROWS + 64 * k)
        out[:, k] = np.bitwise_or.reduce((drawn & np.uint64(1)) << place, axis=0)
    return out


def band_keys(samples: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(row, band) bucket keys; the band number is part of the key."""
    out = np.empty((samples.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ samples[k])
        out[:, b] = key
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, frequent) -> DataFrame:
    """(doc_id, t, fp, w, sketch, bands): t tells texts apart, fp word sequences, w is the total
    weight, sketch holds one byte of each sample; no bands without words."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema[doc_id].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                found, (gram, rows, counts, _) = shingle_counts(part)
                weight = weights(gram, counts, held.value)
                drawn = sample(gram, rows, weight, len(part), BANDS * ROWS)
                keys = band_keys(drawn)
                sketch = [x.tobytes() for x in drawn.T.astype(np.uint8)]
                total = np.bincount(rows, weight, len(part))
                has = np.diff(found.bounds) > 0
                names = []
                for i in range(len(part)):
                    a, b = found.bounds[i], found.bounds[i + 1]
                    if b > a:
                        names.append(hashlib.blake2b(found.hashes[a:b].tobytes(), digest_size=16).hexdigest())
                    else:
                        raw = found.data[found.offsets[i] : found.offsets[i + 1]].tobytes()
                        names.append("-" + hashlib.blake2b(raw, digest_size=16).hexdigest())
                lengths = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(lengths), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(names), pa.array(total), pa.array(sketch, pa.binary()), bands],
                    ["doc_id", "t", "fp", "w", "sketch", "bands"],
                )

    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(_text_column(text)).alias("t"), _text_column(text).alias("text")
    ).mapInArrow(sign, f"doc_id {kind}, t long, fp string, w double, sketch binary, bands array<long>")


def similarity(left: pa.Array, right: pa.Array, frequent) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    sides = []
    for column in (left, right):
        _, (gram, rows, counts, _) = shingle_counts(column)
        keys = mix(gram ^ mix(rows.astype(np.uint64) + np.uint64(1)))
        sides.append((keys, rows, weights(gram, counts, frequent)))
    (ka, ra, wa), (kb, rb, wb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), n)
    total = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1e-300), 0.0)


@F.arrow_udf(IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many bytes of two sketches agree."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


def least_agreeing(threshold: float) -> int:
    """Samples that agree at least: five standard deviations below the mean of a pair of just
    that similarity, which fewer than one such pair in 500 000 misses."""
    n = BANDS * ROWS
    return int(np.floor(n * threshold - 5 * np.sqrt(n * threshold * (1 - threshold))))


def most_differing(threshold: float) -> int:
    """One-bit samples that differ at most: half of the samples that do not agree, and five
    standard deviations above the mean, as in ``least_agreeing``."""
    n, p = 64 * BIT_WORDS, (1 - threshold) / 2
    return int(np.ceil(n * p + 5 * np.sqrt(n * p * (1 - p))))


def allowed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of nodes whose samples allow the similarity."""
    sketches = texts.select("fp", "sketch")
    return (
        pairs.join(sketches.select(F.col("fp").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("fp").alias("b"), F.col("sketch").alias("sb")), "b")
        .filter(_agreeing("sa", "sb") >= least_agreeing(threshold))
        .select("a", "b")
    )


def verify(pairs: DataFrame, texts: DataFrame, frequent, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs of nodes."""
    held = pairs.sparkSession.sparkContext.broadcast(frequent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                for at, other in slices(batch.column(3).slice(first, len(part))):
                    score = similarity(part.slice(at, len(other)), other, held.value)
                    own = batch.slice(first + at, len(other))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(score)], ["a", "b", "similarity"])

    return (
        pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
        .mapInArrow(compare, "a string, b string, similarity double")
    )


def held_filter(keys: DataFrame):
    """A test on the hashes ``h`` of ``keys``: true for all of them and for some others.

    Its size is fixed. Beyond some 10^8 keys it lets most rows through, so an exact join has
    to follow; it only saves that join's shuffle.
    """
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) AS int))")
    words_of = keys.select(F.pmod("h", F.lit(FILTER_WORDS)).alias("w"), bit.alias("bit"))
    found = words_of.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        x = h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        word = held.value[x & np.uint64(FILTER_WORDS - 1)]
        return pa.array((word >> (x >> np.uint64(58))) & np.uint64(1) == 1)

    return maybe


def _close(a: Column, b: Column, threshold: float) -> Column:
    """Whether two total weights allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-6)


def _pairs(members: DataFrame, leader: str, threshold: float) -> DataFrame:
    """Pairs of members and a leader (a struct of fp and w) that may be similar."""
    fp, other = F.col("fp"), F.col(f"{leader}.fp")
    near = (fp != other) & _close(F.col("w"), F.col(f"{leader}.w"), threshold)
    return members.filter(near).select(F.least(fp, other).alias("a"), F.greatest(fp, other).alias("b"))


def components_apart(parts: DataFrame) -> DataFrame:
    """(bucket, pairs, largest, salts) of the buckets with members in different components:
    how many pairs lie apart, the largest component, and the parts to form the pairs in.
    ``parts``: (bucket, root, n)."""
    pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    most = F.max(F.struct("n", "root"))["root"]
    salts = F.least(F.ceil(pairs / PART_PAIRS), F.sum("n")).cast("int")
    found = parts.groupBy("bucket").agg(pairs.alias("pairs"), most.alias("largest"), salts.alias("salts"))
    return found.filter("pairs > 0")


def pairs_apart(placed: DataFrame) -> DataFrame:
    """Pairs (x, y) of a bucket, x outside the largest component; all pairs that lie apart are
    among them, and not more than as many again. ``placed``: (bucket, fp, w, root, largest, salts)."""
    own = F.struct("fp", "w", "root", (F.col("root") == F.col("largest")).alias("in_largest"))
    few = placed.filter("root != largest").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), own.alias("x")
    )
    every = placed.select("bucket", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"), own.alias("y"))
    return few.join(every, ["bucket", "salt"]).select("x", "y")


def shared_weights(nodes: DataFrame, texts: DataFrame, frequent) -> DataFrame:
    """(fp, shared): what the shingles weigh that a node has in common with any other of ``nodes``.

    Shingles of one node are all that is left after the first aggregation, so frequent ones,
    counted where they are read, gather nowhere and nothing is joined with them.
    """
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                _, (gram, rows, counts, bounds) = shingle_counts(part)
                at = pa.array(bounds.astype(np.int32))
                hashes = pa.ListArray.from_arrays(at, pa.array(gram.view(np.int64)))
                weight = pa.ListArray.from_arrays(at, pa.array(weights(gram, counts, held.value)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), hashes, weight], ["f", "h", "w"])

    f = F.xxhash64("fp").alias("f")
    own = texts.join(nodes.select("fp"), "fp").select(f, "text").mapInArrow(weigh, "f long, h array<long>, w array<double>")
    each = own.select("f", F.explode(F.arrays_zip("h", "w")).alias("s")).select("f", "s.h", "s.w")
    single = each.groupBy("h").agg(F.min("f").alias("f"), F.max("f").alias("last"), F.max("w").alias("w")).filter("f = last")
    alone = single.groupBy("f").agg(F.sum("w").alias("alone"))
    return nodes.withColumn("f", f).join(alone, "f", "left").select("fp", (F.col("w") - F.coalesce("alone", F.lit(0.0))).alias("shared"))


def able_nodes(nodes: DataFrame, texts: DataFrame, frequent, threshold: float, scratch: Scratch) -> DataFrame:
    """(fp, shared, bits) of the nodes that can have a partner among ``nodes``."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2), 1 << 20):
                _, (gram, rows, counts, _) = shingle_counts(part)
                bits = sample_bits(gram, rows, weights(gram, counts, held.value), len(part))
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * BIT_WORDS)
                own = batch.slice(first, len(part))
                words_of = pa.ListArray.from_arrays(ends, pa.array(bits.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), words_of], ["fp", "shared", "bits"])

    low, high = _weight_bounds(threshold)
    known = scratch.stage(shared_weights(nodes, texts, frequent), "shared")
    able = nodes.join(known, "fp").filter(high >= low).select("fp", "shared")
    # Drawing takes much time for few bytes, so the number of tasks must not follow the bytes.
    spark = texts.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    drawn = able.join(texts.select("fp", "text"), "fp").repartition(n_tasks, "fp").mapInArrow(draw, "fp string, shared double, bits array<long>")
    return scratch.stage(drawn, "able")


def _weight_bounds(threshold: float) -> tuple[Column, Column]:
    """The least and the largest weight of a partner: of weights v and w with a common part of
    at most s, the similarity is at most v / w, w / v and s / (v + w - s)."""
    slack = 1e-6
    return F.col("w") * (threshold - slack), F.col("shared") * (1 + 1 / (threshold - slack)) - F.col("w") * (1 - slack)


def _cell(w: Column, threshold: float) -> Column:
    return F.floor(F.log(w) * (CELLS / -math.log(min(threshold, 0.99)))).cast("int")


class BoundedPairs:
    """Pairs of a bucket whose weights, shared weights and bits allow the similarity.

    ``rest``: (bucket, fp, w, root, largest, shared, bits). Members outside a bucket's largest
    component look for partners in the weight cells that their bounds reach.
    """

    def __init__(self, rest: DataFrame, threshold: float, scratch: Scratch):
        low, high = _weight_bounds(threshold)
        rest = rest.select("bucket", "fp", "w", "root", "largest", "shared", "bits").filter(high >= low)
        lists = rest.groupBy("fp").agg(F.collect_list("bucket").alias("buckets"))
        rest = scratch.stage(rest.join(lists, "fp").withColumn("in_largest", F.col("root") == F.col("largest")), "bounded")
        cells = F.explode(F.sequence(_cell(low, threshold), _cell(high, threshold)))
        self.threshold, self.rest = threshold, rest
        self.seekers = rest.filter("not in_largest").withColumn("cell", cells)
        self.found = rest.withColumn("cell", _cell(F.col("w"), threshold))
        at = ["bucket", "cell"]
        n = self.seekers.groupBy(at).agg(F.count("*").alias("nx")).join(self.found.groupBy(at).agg(F.count("*").alias("ny")), at)
        formed = F.col("nx") * F.col("ny")
        salts = F.least(F.ceil(formed / PART_PAIRS), "ny").cast("int")
        self.parts = scratch.stage(n.select(*at, formed.alias("formed"), salts.alias("salts")), "parts")

    def formed(self) -> int:
        return self.parts.agg(F.sum("formed")).first()[0] or 0

    def pairs(self) -> DataFrame:
        """(a, b), each pair in the first bucket that it shares."""
        own = F.struct("fp", "w", "root", "shared", "bits", "buckets", "in_largest")
        parts, t = self.parts.drop("formed"), self.threshold - 1e-6
        salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        few = self.seekers.join(parts, ["bucket", "cell"]).select("bucket", "cell", salt, own.alias("x")).alias("few")
        part = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt")
        every = self.found.join(parts, ["bucket", "cell"]).select("bucket", "cell", part, own.alias("y")).alias("every")
        same = [F.col(f"few.{k}") == F.col(f"every.{k}") for k in ("bucket", "cell", "salt")]
        # Both orders of a pair come up where neither is in the largest component.
        once = F.col("y.in_largest") | (F.col("x.fp") < F.col("y.fp"))
        common = F.least("x.shared", "y.shared")
        near = _close(F.col("x.w"), F.col("y.w"), t) & (common * (1 + t) >= (F.col("x.w") + F.col("y.w")) * t)
        first = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("few.bucket")
        apart = F.col("x.root") != F.col("y.root")
        differing = [F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k])) for k in range(BIT_WORDS)]
        alike = sum(differing[1:], differing[0]) <= most_differing(self.threshold)
        found = few.join(every, [*same, once, apart, near, alike, first])
        return found.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def likely_centres(rest: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """(bucket, lead): the member of each bucket with the largest share of links among its
    compared pairs; ten more that fail count for every member, so few pairs prove little."""
    links = (F.col("similarity") >= threshold - 1e-9).cast("int").alias("link")
    ends = tested.select(F.explode(F.array("a", "b")).alias("fp"), links)
    share = ends.groupBy("fp").agg((F.sum("link") / (F.count("*") + 10)).alias("share"))
    order = F.struct(F.coalesce("share", F.lit(0.0)).alias("share"), "fp", "w", "root")
    return rest.join(share, "fp", "left").groupBy("bucket").agg(F.max(order).alias("lead"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY,
    pairs_per_member: int = 4, spare_pairs: int = 1000,
) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``.

    Pairs of a turn beyond ``pairs_per_member`` per member and ``spare_pairs`` are replaced by
    turns with leaders; the result is the same."""
    signed, node_class = _classes(docs, doc_id, text, threshold, pairs_per_member, spare_pairs)
    named = node_class.select("fp", F.col("keeper.doc_id").alias("class_id"))
    return signed.select("doc_id", "fp").join(named, "fp").select(F.col("doc_id").alias(doc_id), "class_id")


def _classes(
    docs: DataFrame, doc_id: str, text: str, threshold: float, pairs_per_member: int = 4, spare_pairs: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (fp, keeper): of each node the text that stands for its
    class, as a struct of (none, doc_id, t), the smallest of the class by doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(_text_column(text).alias("text"))
    frequent = frequent_shingles(texts, docs.count(), scratch)
    signed = scratch.stage(signatures(docs, doc_id, text, frequent), "signatures")

    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "w", "sketch", "bands")
    nodes = signed.groupBy("fp").agg(F.min(named).alias("n"))
    spread = nodes.select("fp", "n.w", F.explode("n.bands").alias("bucket"))
    own = F.struct("fp", "w")
    shared = spread.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low.fp != high.fp")
    members = scratch.stage(spread.join(shared, "bucket"), "members")
    wanted = scratch.stage(members.select("fp").distinct().join(nodes.select("fp", "n.doc_id", "n.t", "n.sketch"), "fp"), "wanted")
    d = docs.select(F.col(doc_id).alias("d"), _text_column(text).alias("text")).withColumn("dt", F.xxhash64("text"))
    # Only texts that take part in a comparison are shuffled.
    d = d.filter(held_filter(wanted.select(F.xxhash64("doc_id", "t").alias("h")))(F.xxhash64("d", "dt")))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("dt") == F.col("t"))
    held = scratch.stage(d.join(wanted, same).select("fp", "sketch", "text").dropDuplicates(["fp"]), "texts")

    pairs = _pairs(members, "low", threshold).union(_pairs(members, "high", threshold)).distinct()
    tested = scratch.stage(verify(allowed(pairs, held, threshold), held, frequent, threshold), "tested")
    links = tested.filter(F.col("similarity") >= threshold - 1e-9).select("a", "b")
    rest = members.filter("fp != low.fp and fp != high.fp").select("bucket", "fp", "w")
    classes = connected_components(links, scratch)
    budget, turn, shared = pairs_per_member * members.count() + spare_pairs, 0, None
    while True:
        placed = rest.join(classes, F.col("fp") == F.col("node"), "left").select(
            "bucket", "fp", "w", F.coalesce("root", "fp").alias("root")
        )
        parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        apart = scratch.stage(components_apart(parts), "apart")
        cost = apart.agg(F.sum("pairs")).first()[0] or 0
        if not cost:
            break
        rest = scratch.stage(placed.join(apart.drop("pairs"), "bucket"), "rest")
        pairs = lead = None
        drawn = False
        if cost <= budget:
            # Both orders of a pair come up where neither is in the largest component.
            once = F.col("y.in_largest") | (F.col("x.fp") < F.col("y.fp"))
            pairs = pairs_apart(rest).filter(
                once & (F.col("x.root") != F.col("y.root")) & _close(F.col("x.w"), F.col("y.w"), threshold)
            ).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
        elif turn == 0:
            lead = likely_centres(rest, tested, threshold)
        else:
            if shared is None:
                shared = able_nodes(rest.select("fp", "w").distinct(), held, frequent, threshold, scratch)
            bounded = BoundedPairs(rest.join(shared, "fp"), threshold, scratch)
            if bounded.formed() <= FORMED * budget:
                pairs = scratch.stage(bounded.pairs(), "pairs")
                pairs = pairs if pairs.count() <= budget else None
                drawn = pairs is not None
            if pairs is None:
                # Twice as many leaders each turn keep the turns few.
                order = F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), "fp", "w", "root")
                part = F.pmod(F.xxhash64(F.lit(turn), "fp"), F.lit(1 << turn - 1))
                lead = bounded.rest.groupBy("bucket", part.alias("part")).agg(F.array(F.min(order), F.max(order)).alias("both"))
                lead = lead.select("bucket", F.explode(F.array_distinct("both")).alias("lead"))
                rest = bounded.rest
        turn += 1
        if lead is None:
            again = rest.limit(0)
        else:
            # A leader is compared with the members outside its component and needs no
            # further comparison then.
            lead = scratch.stage(lead, "leaders")
            pairs = _pairs(rest.join(lead, "bucket").filter("root != lead.root"), "lead", threshold)
            again = rest.join(lead.select("bucket", "lead.fp"), ["bucket", "fp"], "left_anti")
        # The bits have said more already than the samples of the buckets could.
        pairs = pairs if drawn else allowed(pairs.distinct(), held, threshold)
        more = scratch.stage(verify(pairs, held, frequent, threshold), "tested")
        links = links.union(more.filter(F.col("similarity") >= threshold - 1e-9).select("a", "b"))
        classes = connected_components(links, scratch)
        rest = again.select("bucket", "fp", "w")
    scratch.drop(held)

    placed = (
        nodes.select("fp", F.struct("n.none", "n.doc_id", "n.t").alias("own"))
        .join(classes, F.col("fp") == F.col("node"), "left")
        .select("fp", "own", F.coalesce("root", "fp").alias("root"))
    )
    keepers = placed.groupBy("root").agg(F.min("own").alias("keeper"))
    return signed, scratch.stage(placed.join(keepers, "root").select("fp", "keeper"), "classes")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each class: the one whose doc_id names it.

    A row is known by its doc_id and its text, so unlike texts stay also where they share a
    doc_id or have none. Of rows that repeat both one stays."""
    signed, node_class = _classes(docs, doc_id, text, threshold)
    kept = node_class.select(F.struct(F.col("keeper.doc_id").alias("a"), "keeper.t").alias("k")).distinct()
    rows = signed.groupBy(F.struct(F.col("doc_id").alias("a"), "t").alias("r")).count()
    # Drawn names, so that no column of docs can have them.
    own, row = f"k{uuid.uuid4().hex}", f"r{uuid.uuid4().hex}"
    named = rows.join(kept, F.col("r").eqNullSafe(F.col("k"))).select(F.col("k").alias(own), "count")
    known = docs.withColumn(row, F.struct(F.col(doc_id).alias("a"), F.xxhash64(_text_column(text)).alias("t")))
    same = F.col(row).eqNullSafe(F.col(own))
    once = known.join(named.filter("count = 1"), same, "left_semi").drop(row)
    repeated = named.filter("count > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(known.join(repeated, same, "left_semi").dropDuplicates([row]).drop(row))
