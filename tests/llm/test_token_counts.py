from collections import Counter

from corpuslens.llm import queries
from corpuslens.llm import token_counts as tc
from corpuslens.llm.encoding import default_tokenizer, load
from corpuslens.llm.staging import Scratch

from .messy import TEXTS, empty, messy, table

SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def totals(rollup):
    return {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_commits_are_idempotent_and_signed(spark):
    folder = Scratch(spark).path("rollup")
    rollup = tc.TokenRollup(spark, folder)
    assert totals(rollup) == {}
    assert rollup.commit("one/1", rows(spark, ("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 7)))
    assert not rollup.commit("one/1", rows(spark, ("a", "en", "v1", 1, 99)))
    assert rollup.commit("two", rows(spark, ("a", "en", "v1", -1, -5), ("a", "en", "v2", 1, 6)))
    expected = {("a", "en", "v1"): (1, 10), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 7)}
    assert totals(rollup) == expected
    rollup.compact()
    assert totals(rollup) == expected
    again = tc.TokenRollup(spark, folder)
    assert not again.commit("two", rows(spark, ("a", "en", "v1", 1, 99)))
    assert again.commit("three", rows(spark, (None, None, "v1", -1, -7)))
    again.compact()
    again.compact()
    del expected[None, None, "v1"]
    assert totals(again) == expected and not again.commit("one/1", rows(spark))


def test_rename_decides_between_two_writers(spark):
    rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
    name = rollup._batch_name("x")
    assert rollup._publish(rows(spark, ("a", "en", "v", 1, 1)), name)
    assert not rollup._publish(rows(spark, ("a", "en", "v", 1, 1)), name)
    assert totals(rollup) == {("a", "en", "v"): (1, 1)}


def one(spark, n):
    return rows(spark, ("a", "en", "v", 1, n))


def test_a_batch_committed_during_a_compaction_counts_once(spark, monkeypatch):
    rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
    rollup.commit("1", one(spark, 5))
    plain = rollup._publish

    def publish(df, name):
        monkeypatch.setattr(rollup, "_publish", plain)
        tc.TokenRollup(spark, rollup.folder).commit("2", one(spark, 10))
        return plain(df, name)

    monkeypatch.setattr(rollup, "_publish", publish)
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (2, 15)}
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (2, 15)}
    assert rollup._names("batch") == [] and len(rollup._names("state")) == 1


def test_a_batch_committed_between_two_listings_counts_once(spark, monkeypatch):
    """Names are listed twice, batches and states; whatever happens in between, nothing counts twice or gets lost."""
    for folded in (False, True):
        rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
        other = tc.TokenRollup(spark, rollup.folder)
        rollup.commit("1", one(spark, 5))
        plain, calls = rollup._names, []

        def names(kind):
            found = plain(kind)
            calls.append(kind)
            if len(calls) == 1:
                other.commit("2", one(spark, 10))
                if folded:
                    other.compact()
            return found

        monkeypatch.setattr(rollup, "_names", names)
        seen = totals(rollup)
        assert seen == {("a", "en", "v"): (2, 15) if folded else (1, 5)} and calls[0] == "batch"
        calls.clear()
        rollup.commit("3", one(spark, 20))
        rollup.compact()
        assert totals(other) == {("a", "en", "v"): (3, 35)}


def test_a_reader_outlives_a_compaction(spark):
    rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
    rollup.commit("1", one(spark, 5))
    early = rollup.totals()
    rollup.compact()
    assert [tuple(r[3:]) for r in early.collect()] == [(1, 5)]
    rollup.commit("2", one(spark, 6))
    middle = rollup.totals()
    rollup.compact()
    assert [tuple(r[3:]) for r in middle.collect()] == [(2, 11)]
    assert not rollup.commit("1", one(spark, 7)) and rollup.committed("2") and not rollup.committed("9")


def test_two_compactions_at_once_and_one_lost_half_way(spark, monkeypatch):
    rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
    other = tc.TokenRollup(spark, rollup.folder)
    rollup.commit("1", one(spark, 5))
    plain = rollup._publish

    def publish(df, name):
        other.compact()
        return plain(df, name)

    monkeypatch.setattr(rollup, "_publish", publish)
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (1, 5)} and len(rollup._names("state")) == 1
    monkeypatch.setattr(rollup, "_publish", plain)
    rollup.commit("2", one(spark, 6))

    def lost(df, name):
        raise RuntimeError("lost")

    monkeypatch.setattr(rollup, "_publish", lost)
    try:
        rollup.compact()
    except RuntimeError:
        pass
    monkeypatch.setattr(rollup, "_publish", plain)
    assert totals(rollup) == {("a", "en", "v"): (2, 11)}
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (2, 11)}


def n_tokens(text):
    return len(load(default_tokenizer()).encode(text or "", add_special_tokens=False).ids)


def test_query(spark):
    import re

    labels = {r["doc_id"]: r for r in table(spark, "labels").collect()}
    expected = Counter()
    for r in table(spark, "documents").collect():
        label = labels.get(r["doc_id"])
        if label and label["quality"] == 0:
            continue
        text = re.sub(r"\s+", " ", r["text"], flags=re.ASCII) if label and label["toxic"] == 1 else r["text"]
        expected[r["source"], r["lang"], "n"] += 1
        expected[r["source"], r["lang"], "t"] += n_tokens(text)
    got = queries.op1(spark, "/root/testdata/sf0.001").collect()
    assert {(r["source"], r["lang"]) for r in got} == {k[:2] for k in expected}
    for r in got:
        assert (r["n_docs"], r["n_tokens"]) == (expected[r["source"], r["lang"], "n"], expected[r["source"], r["lang"], "t"])


def test_messy_rows(spark):
    counted = tc.count_tokens(messy(spark), "v", default_tokenizer())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == Counter((i, n_tokens(t)) for i, t in TEXTS)
    rollup = tc.TokenRollup(spark, Scratch(spark).path("rollup"))
    rollup.commit("in", tc.inserts(counted))
    assert totals(rollup) == {(None, None, "v"): (len(TEXTS), sum(n_tokens(t) for _, t in TEXTS))}
    rollup.commit("none", tc.inserts(tc.count_tokens(empty(spark), "v", default_tokenizer())))
    rollup.commit("out", tc.deletes(counted))
    assert totals(rollup) == {}
