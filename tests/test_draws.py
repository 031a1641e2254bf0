"""Ranks, samples and splits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import ranking, sampling
from corpuslens.operators.sampling import share
from corpuslens.operators.skew import hot_key_join, salted_join


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    # Group a holds a third of all rows and more than one bucket of positions.
    return spark.range(900).select(
        (F.col("id") * 997).alias("id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
    )


def test_positions(spark, rows):
    got = ranking.row_position(rows, "id", ["g"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["id"], r["row_no"]))
    for pairs in by_group.values():
        assert [n for _, n in sorted(pairs)] == list(range(len(pairs)))


def test_weighted_offset(spark, rows):
    weighted = rows.withColumn("w", F.col("id") % 4)
    got = ranking.running_offset(weighted, ["id"], ranking.position_bucket("id"), [], F.col("w")).collect()
    total = 0
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["offset"] == total
        total += r["w"]


def test_shuffle_is_a_permutation(spark, rows):
    got = sampling.seeded_shuffle(rows, "id", 42).collect()
    order = [r["id"] for r in sorted(got, key=lambda r: r["position"])]
    assert order == sorted((r["id"] for r in got), key=lambda i: key(42, i))
    assert sorted(r["position"] for r in got) == list(range(900))


def test_splits_are_exact_disjoint_and_repeatable(spark, rows):
    split = sampling.split_rows(rows, "id", [5904, 557], share(85, 100), share(15, 100, "ceil"), ["g"])
    got = [tuple(r) for r in split.select("seed", "g", "id", "split").collect()]
    again = [tuple(r) for r in split.repartition(3).select("seed", "g", "id", "split").collect()]
    assert sorted(got) == sorted(again)
    ids = {}
    for r in rows.collect():
        ids.setdefault(r["g"], []).append(r["id"])
    for seed in (5904, 557):
        for g, members in ids.items():
            order = sorted(members, key=lambda i: key(seed, i))
            k = len(order) * 85 // 100
            assert sorted(i for s, h, i, side in got if (s, h, side) == (seed, g, "train")) == sorted(order[:k])
            assert sorted(i for s, h, i, side in got if (s, h, side) == (seed, g, "test")) == sorted(order[k:])


def test_empty_and_full_cuts(spark, rows):
    none = sampling.sample_rows(rows, "id", [1], lambda n: n * 0)
    every = sampling.sample_rows(rows, "id", [1], lambda n: n)
    assert none.count() == 0
    assert every.count() == 900


def test_sized_split_falls_back(spark, rows):
    rule = sampling.sized_or_share(100, 110, 9, 10, "floor")
    test = sampling.sized_or_share(10, 110, 1, 10, "ceil")
    got = sampling.split_rows(rows, "id", [42], rule, test, ["g"]).groupBy("g", "split").count().collect()
    counts = {(r["g"], r["split"]): r["count"] for r in got}
    assert (counts["a", "train"], counts["a", "test"]) == (100, 10)
    n = rows.where("g = 'g1'").count()
    assert (counts["g1", "train"], counts["g1", "test"]) == (n * 9 // 10, -(-n // 10))


def test_chained_sample_only_permutes(spark, rows):
    got = sampling.sample_rows_chained(rows, "id", [5904, 557], share(1, 100)).collect()
    first = {r["id"] for r in got if r["seed"] == 5904}
    assert len(first) == 9 and first == {r["id"] for r in got if r["seed"] == 557}


def test_head(spark, rows):
    got = sampling.head_percent(rows, "id", 1).collect()
    assert sorted(r["id"] for r in got) == [i * 997 for i in range(9)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_joins_equal_plain_join(spark, rows, how):
    small = rows.groupBy("g").agg(F.count("*").alias("n")).where("g <> 'g2'")
    want = sorted(map(tuple, rows.join(small, "g", how).select("g", "id", "n").collect()), key=repr)
    salted = salted_join(rows, small, ["g"], ["id"], how).select("g", "id", "n").collect()
    hot = hot_key_join(rows, small, "g", ["id"], how).select("g", "id", "n").collect()
    assert sorted(map(tuple, salted), key=repr) == want
    assert sorted(map(tuple, hot), key=repr) == want


def test_chunks_are_computed_once_for_their_split(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chunks = spark.range(100).selectExpr("id % 2 AS source", "id AS batch").mapInArrow(count, "source long, batch long")
    sides = sampling.split_chunks(chunks, ["batch"], [1, 2], sampling.share(85, 100), sampling.share(15, 100, "ceil"), ["source"])
    assert sides.count() == 200 and made.value == 100
