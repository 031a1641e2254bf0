"""Readers, writers, the stream and batch functions on small files."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.constants import TRAITS
from corpuslens.functions import text as tx
from corpuslens.operators import mapping, runs
from corpuslens.operators.checks import require_empty, size_check, union_same_schema
from corpuslens.sources import readers, writers
from corpuslens.streaming.cleaning import stream_documents, write_cleaned


def test_csv_with_code_page(spark, tmp_path):
    text = 'AUTHID,TEXT,cEXT,cNEU,cAGR,cCON,cOPN\n1,"It’s “fine” café\nnext ""line""",n,y,y,n,y\n'
    path = tmp_path / "essays.csv"
    path.write_bytes(text.encode("cp1252"))
    row = readers.read_csv(spark, str(path), readers.ESSAYS_SCHEMA, encoding="windows-1252").first()
    assert row["TEXT"] == 'It’s “fine” café\nnext "line"'
    assert (row["cEXT"], row["cOPN"]) == ("n", "y")


def test_csv_null_and_json_lines(spark, tmp_path):
    (tmp_path / "talks.csv").write_text("title,transcript\na,Hello\nb,\n")
    talks = readers.read_csv(spark, str(tmp_path / "talks.csv"), readers.TALKS_SCHEMA)
    assert [r["transcript"] for r in talks.where("transcript is not null").collect()] == ["Hello"]
    (tmp_path / "a.json").write_text('{"id": 1, "abstract": "We"}\n{"id": 2}\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "a.json"), readers.ABSTRACTS_SCHEMA).collect()
    assert [r["abstract"] for r in rows] == ["We", None]


def test_documents_and_lines(spark, tmp_path):
    folder = tmp_path / "scripts"
    folder.mkdir()
    (folder / "one.txt").write_text("a\nb\n")
    (folder / "two.txt").write_text("c")
    docs = {r["file"]: r["text"] for r in readers.read_documents(spark, str(folder)).collect()}
    assert docs == {"one.txt": "a\nb\n", "two.txt": "c"}
    rows = readers.read_lines(spark, str(folder)).where("file = 'one.txt'").orderBy("part", "line_no")
    assert [r["text"] for r in rows.collect()] == ["a", "b"]


def test_json_maps(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"1": "I [MASK] x", "2": "y [MASK]"}, indent=1))
    items = {r["item"]: r["sentence"] for r in readers.read_json_map(spark, str(tmp_path / "items.json")).collect()}
    assert items == {1: "I [MASK] x", 2: "y [MASK]"}
    (tmp_path / "ctx.json").write_text(json.dumps({"context": {"k1": "text one", "k2": "two"}}))
    assert readers.read_contexts(spark, str(tmp_path / "ctx.json")).count() == 2
    scores = {"question type": {"extroversion": {"context_keys": {"k1": {"diff": 0.5, "z": 1}, "k2": {"diff": -1}}}}}
    (tmp_path / "scores.json").write_text(json.dumps(scores))
    rows = readers.read_trait_scores(spark, str(tmp_path / "scores.json")).collect()
    assert {(r["key"], r["trait"], r["diff"]) for r in rows} == {("k1", "extroversion", 0.5), ("k2", "extroversion", -1.0)}


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("emotional stability", "positive", "a"), ("emotional stability", "negative", "b")],
        "trait string, polarity string, text string",
    )
    writers.write_lines(df, str(tmp_path / "lines"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]
    writers.write_by_polarity(df, str(tmp_path / "polar"))
    folder = tmp_path / "polar" / "trait=emotional_stability" / "polarity=positive"
    assert [r[0] for r in spark.read.text(str(folder)).collect()] == ["a"]
    writers.write_corpus(df, str(tmp_path / "corpus"))
    assert sorted(r[0] for r in readers.read_corpus(spark, str(tmp_path / "corpus")).collect()) == ["a", "b"]


def test_report_log_and_json_sinks(spark, tmp_path):
    rows = [(run, t, s) for run, s in (("base", 1), ("5904", 2), ("557", 4)) for t in TRAITS]
    scores = spark.createDataFrame(rows, "run string, trait string, score bigint")
    writers.write_report(runs.wide_report(runs.with_statistics(scores)), str(tmp_path / "report"))
    csv = next((tmp_path / "report").glob("*.csv")).read_text().splitlines()
    assert csv[0] == "seed," + ",".join(TRAITS)
    assert [x.split(",")[0] for x in csv[1:]] == ["base", "5904", "557", "mean", "stdev"]
    assert csv[-1].split(",")[1] == "1.0"

    for epoch in (0, 1):
        writers.append_log(scores.where("run = '5904'").withColumn("epoch", F.lit(epoch)), str(tmp_path / "log"))
    lines = {r["line"] for r in writers.log_lines(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert any(x.startswith("Base: {'extroversion': 2") for x in lines)
    assert any(x.startswith("Epoch 1: {'extroversion': 2") for x in lines)

    writers.write_json(spark.createDataFrame([("r", "{}")], "run string, items string"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["run"] == "r"


def test_one_report_file_per_model(spark, tmp_path):
    names = ["src1", "src2", "a b/c", "ext_pos_essays"]
    rows = [(c, run, t, k * 100 + j * 10 + s) for k, c in enumerate(names) for run, s in (("557", 4), ("base", 1), ("5904", 2)) for j, t in enumerate(TRAITS)]
    scores = spark.createDataFrame(rows, "corpus string, run string, trait string, score bigint").repartition(7)
    wide = runs.wide_report(runs.with_statistics(scores, ["corpus"]), ["corpus"])
    for _ in range(2):  # a second time replaces the files
        made = writers.write_reports(wide, str(tmp_path / "out"))
        assert len(made) == 4 and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == [
            "a b_c.csv", "ext_pos_essays.csv", "src1.csv", "src2.csv",
        ]
    for k, name in enumerate(names):
        lines = (tmp_path / "out" / f"{name.replace('/', '_')}.csv").read_text().splitlines()
        assert lines[0] == "seed," + ",".join(TRAITS)
        assert [x.split(",")[0] for x in lines[1:]] == ["base", "5904", "557", "mean", "stdev"]
        assert [float(x.split(",")[2]) for x in lines[1:]] == [k * 100 + 11, k * 100 + 12, k * 100 + 14, k * 100 + 13, 1]


def test_batches_that_change_the_number_of_rows(spark):
    """Every batch is one call, in order, whatever the partitions; a batch may vanish."""

    def halves(batch: pa.Table, least: int) -> pa.Table:
        total = batch.column("n").to_pylist()
        return pa.table({"first": total[:1] * (len(total) // least), "size": [len(total)] * (len(total) // least)})

    rows = [("a" if i % 3 else None, i // 10, i, 1000 - i) for i in range(45)]
    df = spark.createDataFrame(rows, "corpus string, batch bigint, row_no bigint, n bigint")
    results = []
    for parts in (1, 6):
        out = mapping.map_row_batches(df.repartition(parts), halves, "first BIGINT, size BIGINT", ["corpus", "batch"], ["row_no"], {"least": 4})
        assert out.columns == ["corpus", "batch", "first", "size"]
        results.append(sorted(map(tuple, out.collect()), key=repr))
    want = []
    for key in sorted({r[:2] for r in rows}, key=repr):
        own = [r for r in rows if r[:2] == key]
        want += [(*key, own[0][3], len(own))] * (len(own) // 4)
    assert results == [sorted(want, key=repr)] * 2


def test_strict_join(spark):
    from corpuslens.operators.labels import join_text_scores

    texts = spark.createDataFrame([(1, "a"), (2, "b")], "key bigint, text string")
    whole = [(k, t, 0.5) for k in (1, 2) for t in ("x", "y z")]

    def joined(rows, **how):
        scores = spark.createDataFrame(rows, "key bigint, trait string, diff double")
        return sorted(map(tuple, join_text_scores(texts, scores, "key", ["x", "y z"], **how).select("key", "text", "x", "y_z").collect()))

    fail = {"missing_text": "fail", "missing_trait": "fail"}
    assert joined(whole, **fail) == joined(whole) == [(1, "a", 0.5, 0.5), (2, "b", 0.5, 0.5)]
    with pytest.raises(Exception, match="score without a text: 3"):
        joined([*whole, (3, "x", 1.0)], **fail)
    for rows in (whole[:-1], whole[:2]):  # one trait missing; a text without any
        with pytest.raises(Exception, match="text without a score: 2"):
            joined(rows, **fail)
        assert joined(rows, missing_text="fail")[0] == (1, "a", 0.5, 0.5)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        (source / f"{i}.txt").write_text(f"Joey: (hi) number {i}\n\nRoss: yes\n")
        query = write_cleaned(stream_documents(spark, str(source)), tx.clean_script, out, checkpoint)
        query.awaitTermination()
    streamed = {(r["file"], r["text"]) for r in spark.read.parquet(out).collect()}
    docs = readers.read_documents(spark, str(source))
    batch = {(r["file"], r["text"]) for r in docs.select("file", tx.clean_script(F.col("text")).alias("text")).collect()}
    assert streamed == batch and len(batch) == 3


def test_batch_functions(spark):
    def add_length(batch: pd.DataFrame, extra: int) -> pd.DataFrame:
        return pd.DataFrame({"size": batch["text"].str.len().astype("int64") + extra})

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id int, text string").repartition(2)
    got = mapping.map_batches(df, add_length, "size BIGINT", {"extra": 10}, ["text"])
    assert got.columns == ["id", "size"]
    assert sorted(map(tuple, got.collect())) == [(1, 12), (2, 13)]

    def make():
        return lambda x: np.asarray(x, dtype="float64") * 2

    vectors = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert vectors.select(mapping.scorer(make, 2)(F.col("v")).alias("s")).first()["s"] == [2.0, 4.0]


def test_checks(spark):
    a = spark.createDataFrame([("x",)], "text string")
    assert union_same_schema(a, a).count() == 2
    with pytest.raises(TypeError):
        union_same_schema(a, spark.createDataFrame([(1,)], "text int"))
    counts = spark.createDataFrame([("a", 5), ("b", 50)], "corpus string, n int")
    assert {r["corpus"]: r["too_small"] for r in size_check(counts, "n", 20).collect()} == {"a": True, "b": False}
    assert require_empty(a.where("text = 'q'"), "bad").count() == 0
    with pytest.raises(Exception, match="bad rows"):
        require_empty(a, "bad rows").collect()
