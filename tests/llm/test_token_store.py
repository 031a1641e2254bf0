import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries
from corpuslens.llm import token_store as ts
from corpuslens.llm.encoding import default_tokenizer, load
from corpuslens.llm.files import write_file
from corpuslens.llm.staging import Scratch

from .messy import TEXTS, empty, messy, table


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 15, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 70_001).astype("<u4")
    raw = ts.pack_bits(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8) and (ts.unpack_bits(raw, bits, len(ids)) == ids).all()
    assert (ts.unpack_bits(ts.pack_bits(ids[:5], bits), bits, 5) == ids[:5]).all()


def test_bits_for():
    assert [ts.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1000, n).astype("<u4") for n in (0, 1, 9000, 5, 4096, 3)]
    raw = ts.file_bytes([None, 2, 2, 5, 9, 11], [len(p) for p in parts], np.concatenate(parts), 10)
    write_file(f"{tmp_path}/a/x.ids", raw, "one")
    file = ts.TokenFile(f"file:{tmp_path}/a/x.ids")
    assert all((file.document(i) == p).all() for i, p in enumerate(parts))
    assert [len(x) for x in file.find(2)] == [1, 9000] and file.find(3) == [] and len(file.find(11)[0]) == 3
    assert file.key(0) is None and file.key(1) == 2
    write_file(f"{tmp_path}/b.ids", b"x" * 200, "one")
    with pytest.raises(ValueError):
        ts.TokenFile(f"{tmp_path}/b.ids")


def ids_of(text, end=ts.END_ID):
    return np.array(load(default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    rows = sorted(queries.op6(spark, "/root/testdata/sf0.001").collect())
    at = 0
    for r, i in zip(rows, sorted(docs), strict=True):
        ids = ids_of(docs[i])
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_messy_rows_over_many_files(spark):
    scratch = Scratch(spark)
    files = scratch.stage(ts.write_tokens(messy(spark), scratch.path("x"), file_ids=10), "files")
    assert files.count() > 3
    rows = ts.read_tokens(spark, files).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((i, ids_of(t).tobytes()) for i, t in TEXTS)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    none = scratch.stage(ts.write_tokens(empty(spark), scratch.path("y")), "files")
    assert ts.read_tokens(spark, none).collect() == []


def test_rows_without_id_are_dealt_out(spark):
    scratch = Scratch(spark)
    rows = [(None, f"text {i} of nobody") for i in range(3000)] + [(7, f"text {i} of one") for i in range(3000)] + [(i, f"own {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = scratch.stage(ts.write_tokens(docs, scratch.path("tokens")), "files")
        assert files.count() >= 6 and files.agg(F.max("n_docs")).first()[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = ts.read_tokens(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    ends = [r["start"] + len(r["ids"]) // 4 for r in back]
    assert [0, *ends[:-1]] == [r["start"] for r in back]
    plain = load(default_tokenizer())
    expected = sorted(((i is not None, i or 0), tuple([*plain.encode(t, add_special_tokens=False).ids, 2])) for i, t in rows)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back)
    assert got == expected
