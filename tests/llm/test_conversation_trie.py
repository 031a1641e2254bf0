import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpuslens.llm import conversation_trie as ct
from corpuslens.llm.queries import ORACLE_SQL, QUERIES
from corpuslens.llm.staging import Scratch
from tools.check_oracle import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, rank int, t string, pos string, block string, key int, n int"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), len(text)


def sequences(rows):
    """Turns of each conversation in order, before and after the openings are put in."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    spliced = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        spliced[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return own, spliced


def plain(convs):
    """The trie as a dictionary from prefix to members."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], SCHEMA).repartition(parts)


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def trie(spark, rows, width):
    scratch = Scratch(spark)
    turns = ct.numbered_turns(frame(spark, rows), scratch)
    return result(ct.prefix_trie(turns.withColumnRenamed("rank", "pos"), turns.select("conv_id"), width, scratch))


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([1, 2, 3, 5, 9, 20])
        rows += [(c * rng.choice([1, 1, 1, 50]), k, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "", "çö😀", f"own {c}"])) for k in range(length)]
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_equals_a_dictionary_of_prefixes(spark, width):
    rows = random_rows(width, 150)
    rows += [(1000 + c, k, "user", "the same conversation") for c in range(80) for k in range(7)]  # a hot one
    assert trie(spark, rows, width) == plain(sequences(rows)[0])


def test_one_conversation_with_most_rows(spark):
    rows = [(7, k // 2, "user", f"t{k % 11}") for k in range(3000)] + [(8, k // 2, "user", f"t{k % 11}") for k in range(500)] + random_rows(9, 30)
    assert trie(spark, rows, 8) == plain(sequences(rows)[0])


def test_digest_of_many_ids(spark):
    rows = [(c, 0, "user", "hello") for c in range(-50, 2000)]
    turns = frame(spark, rows)
    found = ct.ids_digest(turns.selectExpr("named_struct('depth', 1L, 'a', conv_id % 2, 'b', 0L) AS key", "conv_id"), string_bytes=60)
    expected = {k: hashlib.sha256(",".join(str(c) for c in range(-50, 2000) if (abs(c) % 2 if c >= 0 else -(abs(c) % 2)) == k).encode()).hexdigest() for k in (-1, 0, 1)}
    assert {r["key"]["a"]: r["sha"] for r in found.collect()} == expected


def query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    return result(QUERIES["op11_conversation_trie"](spark, str(tmp_path)))


def test_openings_and_messy_rows(spark, tmp_path):
    rows = [(None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 1, None, "x"), (0, 1, "user", None), (0, 2, "", ""),
            (100, 0, "user", "short"), (500, 0, "u", "y" * 100_000)]
    rows += [(c, k, "user", f"{c % 3}{k}") for c in (1, 2, 3, 4, 5, 101, 102, 103, 207, 208, 301) for k in range(c % 7)]
    rows += [(9, 1, "user", "repeated row")] * 30 + [(501, 0, "u", "a"), (502, 0, "u", "b"), (503, 0, "u", "a")]
    spliced = sequences(rows)[1]
    assert any(not turns for turns in spliced.values())
    assert query(spark, rows, tmp_path / "a") == plain(spliced)
    assert query(spark, [], tmp_path / "b") == []
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert query(spark, [(lone, 0, "user", "x")], tmp_path / "c") == plain({lone: []})


def test_query_on_the_given_table(spark):
    for sf in ("0.001", "0.01"):
        folder = f"/root/testdata/sf{sf}"
        assert compare(QUERIES["op11_conversation_trie"](spark, folder), connect(folder), ORACLE_SQL["op11_conversation_trie"]) == ""
