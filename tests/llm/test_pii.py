import hashlib
import random
import re

from pyspark.sql import functions as F

from corpuslens.llm import pii, queries

from .messy import TEXTS, docs_of, empty, messy, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else None,
        "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
    }[kind]


def brute(text):
    spans = [
        (m.start(), k, m.end())
        for k, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    return sorted(spans)


def named(spans):
    return ",".join(f"{[*pii.KINDS, pii.SECRET][k]}:{a}:{b}" for a, k, b in spans)


ODD = [
    "a@b.c._x@d.e", "1.2.3.4.5.6.7.8", "1.2.3.4444 1.2.3.4", "x@y@z.com a@b..c", "é😀 a@b.co 😀 +1 (234) 555-1234",
    "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111" * 3, "1" * 20_000 + ".1.1", "a" * 100_000, "a.b@" * 3000,
    "1.1.1.1 " * 2000, "0001.02.3.255", "+1 +2 345-678-9012", "a@b-.c", "@a.b", "..@a.b", "%@a.b.", "ab@c.d@e.f+1@g.h",
]


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("a1.@-+ ()é9b4") for _ in range(rng.randint(5, 60))) for _ in range(2000)]
    out = pii.with_base(docs_of(spark, texts).repartition(8), "doc_id", "text")
    got = {r[0]: r[1] for r in out.select("doc_id", pii.span_text(F.concat(*pii.KINDS))).collect()}
    assert all(got[i] == named(brute(t)) for i, t in enumerate(texts))


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op3(spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents", "0.01").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        spans = brute(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(named(spans).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(named(spans).split(",")) - {""} <= set(rows[i]["spans"].split(","))
    tokens = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t)) for t in texts.values())
    assert tokens and sum(r["n_secret"] for r in rows.values()) >= tokens


def test_patterns_of_seeds_discover_other_values(spark):
    rng = random.Random(2)
    known = [f"we set api_key={rng.getrandbits(80) | 1 << 79:020x} here a1" for _ in range(30)]
    texts = known + ["we set api_key=hunter.two!zz here", "colour=ordinary text follows", "ratio: something else", "ratio: more of this"]
    rows = pii.find_private(docs_of(spark, texts)).collect()
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["secret"]] for r in rows}
    assert found[30] == ["hunter.two!zz"] and not found[31] and not found[32] and not found[33]
    assert all(len(found[i]) == 1 for i in range(30))


def test_learned_spans_keep_off_base_spans(spark):
    texts = [f"mail: user{i}@example.com and so on" for i in range(20)]
    for r in pii.find_private(docs_of(spark, texts)).collect():
        assert len(r["email"]) == 1 and r["secret"] == []


def test_messy_rows(spark):
    out = pii.find_private(messy(spark)).collect()
    assert len(out) == len(TEXTS) and all(not r[k] for r in out for k in pii.KINDS)
    assert pii.find_private(empty(spark)).collect() == []


def test_prefix_sums(spark):
    for n in (0, 1, 511, 512, 513, 1500):
        df = spark.createDataFrame([([3] * n,)], "x array<bigint>")
        assert df.select(pii.prefix_sums(F.col("x"))).first()[0] == [3 * i for i in range(n)]
