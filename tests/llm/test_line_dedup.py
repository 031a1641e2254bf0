from corpuslens.llm import line_dedup as ld

from .messy import docs_of, empty, messy


def cut(spark, texts):
    return {r["doc_id"]: r["text"] for r in ld.drop_repeated_lines(docs_of(spark, texts).repartition(3)).collect()}


def test_long_line_stays_in_the_first_document_only(spark):
    line = "a passage of at least ten tokens that two documents share"
    out = cut(spark, [f"first own\n{line}\nend", f"{line}\n\nsecond own", "third own"])
    assert out == {0: f"first own\n{line}\nend", 1: "\nsecond own", 2: "third own"}


def test_short_lines_need_ten_documents(spark):
    nine = [f"own text {chr(97 + i)}\nonly three tokens" for i in range(9)]
    assert cut(spark, nine) == dict(enumerate(nine))
    ten = [f"own text {chr(97 + i)}\nonly three tokens\nhi" for i in range(10)] + ["hi\nonly three tokens"]
    out = cut(spark, ten)
    assert out[0] == ten[0] and all(out[i] == f"own text {chr(97 + i)}\nhi" for i in range(1, 10)) and out[10] == "hi"


def test_fields_with_digits_are_variable(spark):
    out = cut(spark, [f"Posted on 2024-01-{i:02d} at {i}:15 by the editor of this page\nbody {chr(97 + i)}" for i in range(3)])
    assert out[1] == "body b" and out[0].startswith("Posted")


def test_rows_of_numbers_are_content(spark):
    rows = [" ".join(str((i * 37 + k * k) % 97) for k in range(10)) for i in range(8)]
    near = [f"1 2 3 4 5 6 7 8 9 {i}" for i in range(4)]
    mixed = [f"row {i} 3 4\t5 6 7 8 9 {i}\nbody {chr(97 + i)}" for i in range(3)]
    texts = [f"{r}\nown {chr(97 + i)}" for i, r in enumerate(rows)] + [f"{rows[0].replace(' ', '  ')}\nown x"] + near + mixed
    out = cut(spark, texts)
    assert [out[i] for i in range(8)] == texts[:8] and out[8] == "own x"
    assert [out[9 + i] for i in range(4)] == near
    assert out[13] == mixed[0] and out[14] == "body b" and out[15] == "body c"


def test_words_that_vary_in_a_leaf_are_variable(spark):
    who = "anna boris carla david".split()
    out = cut(spark, [f"this page was last changed by {w} and is part of the archive\nbody {w}" for w in who])
    assert out[0].startswith("this page") and [out[i] for i in (1, 2, 3)] == [f"body {w}" for w in who[1:]]


def test_unrelated_lines_of_one_leaf_stay(spark):
    texts = [
        "it was the best of times when rain came to town early", "it was the year of plague and we went off seaward",
        "it was the hour at which birds find their roofs again", "it was the age in which iron men fought wars thrice",
    ]
    assert cut(spark, texts) == dict(enumerate(texts))


def test_repeats_inside_one_document_stay(spark):
    text = "one line of more than ten tokens that one document repeats\n" * 3
    assert cut(spark, [text, "other"]) == {0: text, 1: "other"}


def test_hot_line_and_blanks(spark):
    line = "\t all of the  documents\thold this one line of many tokens "
    texts = [f"{line}\nown {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = cut(spark, texts)
    assert out[0] == texts[0] and all(out[i] == texts[i].split("\n")[1] for i in range(1, 300))


def test_messy_rows(spark):
    docs = messy(spark)
    out = ld.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_dropped_lines"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == "   \n\n \t "
    assert by[8]["n_dropped_lines"] == 0 and by[9]["text"] == ""
    assert by[6]["text"] == by[7]["text"]  # five tokens in fewer than ten documents
    assert ld.drop_repeated_lines(empty(spark)).collect() == []
