import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslens.llm import near_dedup as nd
from corpuslens.llm.components import connected_components
from corpuslens.llm.staging import Scratch

from .messy import docs_of, empty, messy, table

WORD = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8):
    """Classes by comparing all texts that share a shingle."""
    bags = [shingles(t) for _, t in rows]
    n = len(rows)
    floor = max(nd.LEAST_FLOOR, n * nd.FREQUENCY_FLOOR)
    df = Counter(s for b in bags for s in b)

    def weight(s):
        return 1.0 if df[s] <= floor else 0.5 + 0.5 * np.log(n / df[s]) / np.log(n / floor)

    holders = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        if not bags[i]:
            same[t or ""].append(i)
    pairs |= {(h[0], j) for h in same.values() for j in h[1:]}
    for i, j in pairs:
        a, b = bags[i], bags[j]
        low = sum(min(a[s], b[s]) * weight(s) for s in a if s in b)
        high = sum(max(a[s], b[s]) * weight(s) for s in set(a) | set(b))
        if (not a and not b) or low >= (threshold - 1e-9) * high:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[root(i)].append(d)
    return {tuple(sorted(x, key=lambda v: (v is None, v))) for x in out.values()}


def classes(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["class_id"]].append(r["doc_id"])
        assert r["class_id"] is None or r["class_id"] <= min(d for d in out[r["class_id"]] if d is not None)
    return {tuple(sorted(x)) for x in out.values()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_brute_force(spark, sf):
    docs = table(spark, "documents", sf)
    assert classes(nd.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_large_groups_and_chains(spark):
    """A hot group of near copies, a chain whose ends are not alike, unrelated texts with
    one long common passage."""
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.getrandbits(40):x}" for _ in range(n)]
    base = fresh(120)
    texts = []
    for _ in range(300):
        w = list(base)
        w[rng.randrange(120)] = fresh(1)[0]
        texts.append(" ".join(w))
    chain = fresh(200)
    for _ in range(12):
        chain = chain[6:] + fresh(6)
        texts.append(" ".join(chain))
    passage = fresh(60)
    texts += [" ".join(fresh(80) + passage + fresh(80)) for _ in range(200)]
    docs = docs_of(spark, texts).repartition(5)
    assert classes(nd.near_duplicates(docs)) == brute(list(enumerate(texts)))


def test_messy_rows(spark):
    docs = messy(spark)
    out = nd.near_duplicates(docs)
    rows = [(r["doc_id"], r["class_id"]) for r in out.collect()]
    assert len(rows) == docs.count()
    by = dict(r for r in rows if r[0] is not None)
    assert by[6] == by[7] == 6 and by[8] == by[9] == 8 and by[1] == by[2] == 1
    assert by[3] == 3 and by[11] == 11 and by[12] == 12 and by[10] == 10
    assert sorted(r[1] is None for r in rows if r[0] is None) == [False, True]  # the empty text has a named copy
    kept = nd.keep_one(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert Counter(ids)[6] == 1 and 7 not in ids and 9 not in ids and 2 not in ids
    assert nd.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    assert nd.near_duplicates(empty(spark)).collect() == []
    assert nd.keep_one(empty(spark)).collect() == []


def test_sampling_estimates_similarity():
    """The share of equal samples is the weighted Jaccard similarity."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    wa[300:], wb[:60] = 0, 0
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    got = []
    for w in (wa, wb):
        own = w > 0
        got.append(nd.sample(keys[own], np.zeros(own.sum(), np.int64), w[own], 1, 3000)[:, 0])
    assert abs((got[0] == got[1]).mean() - true) < 0.04


def test_bits_differ_by_half_of_what_is_not_shared():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.8, 0.9):
        differing = []
        for _ in range(20):
            keys, base = rng.integers(0, 1 << 62, 200).astype(np.uint64), rng.uniform(0.5, 2, 200)
            other = np.concatenate([keys[: int(200 * share)], rng.integers(0, 1 << 62, 200 - int(200 * share)).astype(np.uint64)])
            common = base[: int(200 * share)].sum()
            bits = [nd.sample_bits(g, np.zeros(200, np.int64), base, 1)[0] for g in (keys, other)]
            n = sum(int(a ^ b).bit_count() for a, b in zip(*bits))
            same = common / (2 * base.sum() - common)
            differing.append(n / 1024 - (1 - same) / 2)
            assert same < 0.8 or n <= nd.most_differing(0.8)
        assert abs(np.mean(differing)) < 0.015
    assert nd.most_differing(0.8) == 151 and nd.most_differing(1.0) == 0


@pytest.mark.parametrize("block", [0, 60, 10_000])
def test_components(spark, block):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), ("y", "z")]
    out = connected_components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark), block).collect()
    roots = defaultdict(set)
    for r in out:
        roots[r["root"]].add(r["node"])
    assert sorted(map(len, roots.values())) == [2, 51, 61]


def test_leaders_give_the_same_classes_as_pairs(spark):
    random.seed(3)
    rows = []
    for _ in range(3):
        base = [f"w{random.randrange(9000)}" for _ in range(60)]
        for _ in range(20):
            words = list(base)
            for _ in range(random.randrange(4)):
                words[random.randrange(60)] = f"x{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, nd.near_duplicates(docs).collect()))
    assert sorted(map(tuple, nd.near_duplicates(docs, pairs_per_member=0, spare_pairs=0).collect())) == expected


def edited_copies(n, seed=11, length=90, most=9):
    """Copies of one text with up to ``most`` words changed, some of them copies of copies."""
    rng = random.Random(seed)
    texts = [[f"b{i}" for i in range(length)]]
    for _ in range(n - 1):
        words = list(texts[0] if rng.random() < 0.8 else rng.choice(texts))
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**7)}"
        texts.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("per_member", [0.5])
def test_bounds_lose_no_class(spark, monkeypatch, per_member):
    """With few pairs allowed a hot group goes through a central leader and the bounds; the
    classes are those of all pairs."""
    met = []
    plain = nd.BoundedPairs.pairs
    monkeypatch.setattr(nd.BoundedPairs, "pairs", lambda self: met.append(1) or plain(self))
    rows = edited_copies(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert classes(nd.near_duplicates(docs, pairs_per_member=per_member, spare_pairs=0)) == brute(rows)
    assert met


def test_shared_weights(spark):
    texts = ["a b c d e f", "a b c d e x", "p q r s t u v", "p q r s t u v p q r s t"]
    df = spark.createDataFrame([(f"n{i}", t, 9.0) for i, t in enumerate(texts)], "fp string, text string, w double")
    weigh = lambda nodes: {r["fp"]: r["shared"] for r in nd.shared_weights(nodes.select("fp", "w"), df.select("fp", "text"), (np.zeros(0, np.uint64), np.zeros(0))).collect()}
    # A node's weight without that of the shingles which no other node has.
    assert weigh(df) == {"n0": 8.0, "n1": 8.0, "n2": 9.0, "n3": 9.0 - 4}
    assert weigh(df.filter("fp != 'n0'"))["n1"] == 7.0


def test_bounded_pairs_are_the_pairs_within_the_bounds(spark, monkeypatch):
    """Each pair of different components that the bounds allow, once, whatever the parts."""
    monkeypatch.setattr(nd, "PART_PAIRS", 50)
    rng = random.Random(8)
    rows, nodes = [], {}
    for i in range(120):
        w = rng.uniform(20, 60)
        root = "big" if rng.random() < 0.5 else f"r{i}"
        bits = [-1 if rng.random() < 0.1 else 1 << rng.randrange(40) for _ in range(nd.BIT_WORDS)]
        nodes[f"f{i:03d}"] = (w, root, w * rng.uniform(0.7, 1), rng.sample(range(4), 2), bits)
    rows = [(b, fp, w, root, "big", s, bits) for fp, (w, root, s, buckets, bits) in nodes.items() for b in buckets]
    rest = spark.createDataFrame(rows, "bucket long, fp string, w double, root string, largest string, shared double, bits array<long>")
    got = [tuple(r) for r in nd.BoundedPairs(rest, 0.8, Scratch(spark)).pairs().collect()]
    expected = set()
    unlike = 0
    for a, (wa, ra, sa, ba, xa) in nodes.items():
        for b, (wb, rb, sb, bb, xb) in nodes.items():
            s = min(sa, sb)
            if a < b and ra != rb and set(ba) & set(bb) and min(wa, wb) >= 0.8 * max(wa, wb) and s >= 0.8 * (wa + wb - s):
                differing = sum(((u ^ v) & (1 << 64) - 1).bit_count() for u, v in zip(xa, xb))
                unlike += differing > nd.most_differing(0.8)
                if differing <= nd.most_differing(0.8):
                    expected.add((a, b))
    assert unlike and len(got) == len(set(got)) and set(got) == expected and expected


@pytest.mark.parametrize("sizes", [[400, 1], [60, 50, 3, 1, 1], [1] * 40, [300, 200]])
def test_only_pairs_of_different_components_are_formed(spark, monkeypatch, sizes):
    """A component of a bucket is never joined with itself; the parts of a hot bucket are small."""
    monkeypatch.setattr(nd, "PART_PAIRS", 100)
    rows = [(7, f"c{k}m{i}", 1.0, f"c{k}") for k, n in enumerate(sizes) for i in range(n)]
    placed = spark.createDataFrame(rows, "bucket long, fp string, w double, root string")
    parts = placed.groupBy("bucket", "root").count().withColumnRenamed("count", "n")
    apart = nd.components_apart(parts)
    cost = (sum(sizes) ** 2 - sum(n * n for n in sizes)) // 2
    assert apart.first()["pairs"] == cost
    formed = [(r["x"]["fp"], r["x"]["root"], r["y"]["fp"], r["y"]["root"]) for r in nd.pairs_apart(placed.join(apart, "bucket")).collect()]
    assert len(formed) <= 2 * cost
    expected = {frozenset((a[1], b[1])) for a in rows for b in rows if a[3] != b[3]}
    assert {frozenset((a, b)) for a, ra, b, rb in formed if ra != rb} == expected


def test_unlike_texts_of_one_doc_id_stay(spark):
    text = lambda k: " ".join(f"k{k}n{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (4, text(3)), (4, text(4)), (4, text(4)), (5, text(4)), (6, text(1) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, nd.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(None, text(2)), (4, text(3)), (4, text(4)), (6, text(1) + " end")], key=repr)
