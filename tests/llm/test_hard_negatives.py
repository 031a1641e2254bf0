import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import hard_negatives as hn
from corpuslens.llm.queries import ORACLE_SQL, QUERIES
from tools.check_oracle import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, score string, rank int, a long"


def plain(rows, is_anchor):
    """All pairs with Python's whole numbers."""
    ok = [(i, l, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e, l in rows
          if i is not None and e is not None and l is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, l, e in ok:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(e, o), j, m) for j, m, o in ok)
        for s, j, _ in [x for x in scored if x[2] == l and x[1] != i][:5]:
            band = [x for x in scored if x[2] != l and -30 * s <= -100 * x[0] <= -90 * s][:10]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(band)]
    return sorted(out)


def run(spark, rows, every=10, parts=4, **more):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, hn.mine(df, F.col("id") % every == 0, **more).collect()))


@pytest.mark.parametrize("scale", [1, 1000, 200_000])
def test_scores_are_exact(scale):
    rng = np.random.default_rng(scale)
    for width in (1, 64, 65, 200):
        a, b = rng.integers(-scale, scale + 1, (7, width)), rng.integers(-scale, scale + 1, (9, width))
        primes = hn.primes_for(int(max((a**2).sum(1).max(), (b**2).sum(1).max())))
        assert (hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes) == a @ b.T).all()
    with pytest.raises(ValueError):
        hn.primes_for(1 << 56)


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(6)], rng.randrange(4)) for i in range(300)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(300, 420)]  # one very common vector
    expected = plain(rows, lambda i: i % 10 == 0)
    assert len(expected) > 500 and run(spark, rows) == expected
    assert run(spark, rows, parts=1, block_bytes=400) == expected


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (10, [1.0], 1), (None, [1.0, 2.0], 1), (20, None, 1), (30, [1.0, 2.0], None),
            (40, [1.0, None], 2), (50, [nan, 1.0], 2), (60, [inf, 1.0], 2), (70, [], 2), (1, [0.9, 1.0], 2), (2, [0.9, 1.0], 2),
            (2, [0.9, 1.0], 2), (3, [0.5, 0.1], 3), (4, [0.4, 0.2], 1), (80, [-1.0, -1.0], 2), (5, [3.0, 3.0, 0.0], 1)]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1)]) == []


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_hard_negatives"](spark, sf), connect(sf), ORACLE_SQL["op12_hard_negatives"]) == ""
