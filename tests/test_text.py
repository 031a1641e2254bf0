"""Cleaning rules, against plain Python."""

import re

from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import labels, statements

# text: lines, script, book, news, compact book; each worked by hand
CLEANED = {
    "": ([], "", "", "", ""),
    "one": (["one"], "", "", "one", ""),
    "A: hi (waves) you\n\n \t\nB:  see   it ": (
        ["A: hi (waves) you", "", " \t", "B:  see   it "], "hi  you\nsee it", "B:  see   it ", "A: hi (waves) you\n B:  see   it ", "B:  see   it ",
    ),
    "T\r\nby X\r\rC1\r\n(all gone]\r\nend\r\n": (
        ["T", "by X", "", "C1", "(all gone]", "end"], "\nX\n\ngone]\n",
        "C1\n\n(all gone]\n\nend\n", "T\n by X\n C1\n (all gone]\n end\n", "C1\n(all gone]\nend\n",
    ),
    "J: [laughs] no (a] b) c\n": (["J: [laughs] no (a] b) c"], " no  b) c", "", "J: [laughs] no (a] b) c\n", ""),
    "R: open ( stays\u00a0\n\u2003\nS: x": (
        ["R: open ( stays\u00a0", "\u2003", "S: x"], "open ( stays\nx", "S: x", "R: open ( stays\u00a0\n S: x", "S: x",
    ),
    "a\nb\nc\n\nd": (["a", "b", "c", "", "d"], "\n\n\n", "c\n\nd", "a\n b\n c\n d", "c\nd"),
}


def test_cleaners(spark):
    df = spark.createDataFrame(list(enumerate(CLEANED)), "i int, text string")
    text = F.col("text")
    rows = df.select(
        "i",
        tx.lines(text).alias("lines"),
        tx.clean_script(text).alias("script"),
        tx.clean_book(text).alias("book"),
        tx.clean_news(text).alias("news"),
        tx.clean_book(text, compact=True).alias("compact"),
    ).collect()
    for r in rows:
        assert tuple(r)[1:] == list(CLEANED.values())[r["i"]], list(CLEANED)[r["i"]]


def test_sentences(spark):
    df = spark.createDataFrame([("Hi there. Is it?!  Yes... \n No",)], "text string")
    rows = [r["sentence"] for r in statements.sentence_rows(df).collect()]
    assert rows == ["Hi there.", "Is it?!", "Yes...", "No"]


def test_masked_sentence_and_statements(spark):
    df = spark.createDataFrame([(1, 0, "I, always happy; ALWAYS.")], "item bigint, pos int, sentence string")
    rows = statements.masked_sentences(df, ["always"]).orderBy("spot").collect()
    assert [r["masked"] for r in rows] == ["I, [MASK] happy; ALWAYS.", "I, always happy; [MASK]."]
    assert (rows[0]["left"], rows[0]["right"]) == ("i", "happy")
    assert (rows[1]["left"], rows[1]["right"]) == ("happy", None)

    items = spark.createDataFrame(
        [(i, f"s{i} [MASK]") for i in range(1, 51)], "item bigint, masked string"
    )
    made = statements.answer_statements(items, "original")
    counts = {(r["trait"], r["polarity"]): r["count"] for r in made.groupBy("trait", "polarity").count().collect()}
    assert set(counts.values()) == {20} and len(counts) == 10
    first = {r["statement"]: r["polarity"] for r in made.where("item in (1, 6)").collect()}
    assert first["s1 always"] == "positive" and first["s1 never"] == "negative"
    assert first["s6 never"] == "positive" and first["s6 often"] == "negative"
    copies = statements.replicate(made).groupBy("trait", "polarity").count().collect()
    assert {r["count"] for r in copies} == {2000}


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, "a", "y", "n"), (2, "b", "n", "y"), (3, "c", None, "y")], "id int, text string, cEXT string, cNEU string"
    )
    got = labels.label_split(df, {"extroversion": ("cEXT", False), "emotional stability": ("cNEU", True)})
    rows = {(r["id"], r["trait"]): r["polarity"] for r in got.collect()}
    assert rows == {
        (1, "extroversion"): "positive",
        (2, "extroversion"): "negative",
        (1, "emotional stability"): "positive",
        (2, "emotional stability"): "negative",
        (3, "emotional stability"): "negative",
    }
    scored = spark.createDataFrame([(1, 0.5), (2, -0.1), (3, 0.0)], "id int, diff double")
    signs = {r["id"]: r["polarity"] for r in labels.sign_split(scored).collect()}
    assert signs == {1: "positive", 2: "negative"}
    texts = spark.createDataFrame([(1, "x"), (9, "y")], "id int, text string")
    orphans = {(r["id"], r["missing"]) for r in labels.orphan_keys(texts, scored, "id").collect()}
    assert orphans == {(9, "scores"), (2, "text"), (3, "text")}
