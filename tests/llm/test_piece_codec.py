import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from corpuslens.llm import piece_codec as pc
from corpuslens.llm.queries import QUERIES

from .messy import empty, messy, table

ALPHABET = ["a", "B", "the", " ", "  ", "\n", "\t", "é", "é", "漢", "字", "😀", "▁", "▁▁", "<0x0A>", "</s>", "<unk>", " ",
            "　", "Ｈ", "①", "ﬃ", "㍿", "​", "\x00", "\x07", "ำ", "١", "12", "!!", "word", "�", "👩‍💻", "각"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", " ", "   ", "\x07", "\x07 ", " 　 a 　 ", "a  b", "x" * 5000]


@pytest.fixture(scope="module", params=["identity", "nmt_nfkc", "nmt_nfkc_cf", "no bytes", "no prefix"])
def model(request, tmp_path_factory):
    """The public model as it is, and with other rules of normalisation put in."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pc.default_model(), "rb").read())
    if request.param == "no bytes":
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pc.BYTE:
                p.type = pc.UNUSED
    elif request.param == "no prefix":
        proto.normalizer_spec.add_dummy_prefix = False
    elif request.param != "identity":
        rules = sentencepiece.SentencePieceNormalizer(rule_name=request.param)
        kind = sentencepiece_model_pb2.NormalizerSpec()
        kind.ParseFromString(rules.serialized_normalizer_spec())
        proto.normalizer_spec.precompiled_charsmap = kind.precompiled_charsmap
        proto.normalizer_spec.remove_extra_whitespaces = request.param == "nmt_nfkc"
        assert kind.precompiled_charsmap
    path = tmp_path_factory.mktemp("model") / "m.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_ids_and_spans_equal_the_library(model):
    spec, whole = pc.Spec(model), sentencepiece.SentencePieceProcessor(model_file=model)
    rows = texts(1)
    ids, begin, end = pc.encode_column(pa.array(rows), spec)
    for k, text in enumerate(rows):
        assert ids[k].as_py() == whole.encode(text, add_eos=True), repr(text)
        raw = text.encode()
        expected = [(p.begin, p.end) for p in whole.encode(text, return_type="proto").pieces]
        inside = [len(raw[:a].decode(errors="ignore")) for a in begin[k].as_py()], [len(raw[:a].decode(errors="ignore")) for a in end[k].as_py()]
        got = list(zip(*inside))
        assert got[-1] == (len(text), len(text))
        byte = lambda p: (len(raw[: p[0]].decode()), len(raw[: p[1]].decode()))
        assert got[:-1] in (expected, [byte(p) for p in expected if max(p) <= len(raw)]), repr(text)


def test_chunks_are_segmented_once_and_within_bounds(monkeypatch):
    spec = pc.Spec(pc.default_model())
    assert spec.chunked
    rows = texts(2)
    first = [x.to_pylist() for x in pc.encode_column(pa.array(rows), spec)]
    held = len(spec.known.hashes)
    assert held and [x.to_pylist() for x in pc.encode_column(pa.array(rows), spec)] == first and len(spec.known.hashes) == held
    monkeypatch.setattr(pc.Pieces, "LIMIT_BYTES", 100)
    small = pc.Spec(pc.default_model())
    assert [x.to_pylist() for x in pc.encode_column(pa.array(rows), small)] == first and not len(small.known.hashes)


def test_long_rows_decode_in_parts():
    spec = pc.Spec(pc.default_model())
    for text in texts(3):
        ids = np.array(spec.whole.encode(text, add_eos=True))
        assert pc.decode_ids(ids, spec, 3) == spec.whole.decode(ids.tolist())


def test_messy_rows(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    out = pc.encode(messy(spark))
    rows = sorted((repr(r["doc_id"]), r["ids"]) for r in out.collect())
    assert rows == sorted((repr(r["doc_id"]), whole.encode(r["text"] or "", add_eos=True)) for r in messy(spark).collect())
    back = sorted((repr(r["doc_id"]), r["text"]) for r in pc.decode(out).collect())
    assert back == sorted((repr(r["doc_id"]), whole.decode(whole.encode(r["text"] or ""))) for r in messy(spark).collect())
    assert pc.encode(empty(spark)).collect() == pc.decode(pc.encode(empty(spark))).collect() == []
    missing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in pc.decode(missing).collect()] == [""]


def test_query_equals_the_library_row_by_row(spark):
    whole = sentencepiece.SentencePieceProcessor(model_file=pc.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in table(spark, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = whole.encode(r["text"], add_eos=True)
        expected.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids))))
    assert sorted(map(tuple, QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect())) == sorted(expected)
