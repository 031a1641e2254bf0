from collections import Counter

import corpus_pipeline as cp
from corpuslens.llm import decontamination, toxicity
from corpuslens.llm.staging import Scratch

from .messy import TEXTS, empty, messy, table
from .test_near_dedup import brute
from .test_packing import check

SF = "/root/testdata/sf0.01"


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_every_stage_against_a_plain_version(spark):
    docs, scratch = table(spark, "documents", "0.01"), Scratch(spark)
    seen = {}
    for name, stage in cp.STAGES:
        out = scratch.stage(stage(spark, docs, SF), "stage")
        seen[name] = (docs, out)
        if name != "best-fit packing":
            assert out.schema == docs.schema and set(ids(out)) <= set(ids(docs))
        docs = out

    before, after = seen["toxicity"]
    model = toxicity.train(before, table(spark, "labels", "0.01"), toxicity.remainder("doc_id") != 0)
    assert ids(after) == ids(toxicity.score(before, model).filter("score < 0.5"))

    before, after = seen["line dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    left = {r["doc_id"]: r for r in after.collect()}
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(line, i)
    for i, r in left.items():
        assert r["n_chars"] == len(r["text"]) or r["text"] == texts[i]
        own = r["text"].split("\n")
        assert not [x for x in own if len(x.split()) >= 10 and first[x] != i]
        assert not Counter(own) - Counter(texts[i].split("\n"))

    before, after = seen["near dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == Counter(min(group) for group in brute(rows))
    assert {(r["doc_id"], r["text"]) for r in after.collect()} <= set(rows)

    before, after = seen["benchmark decontamination"]
    leaked = {r["doc_id"] for r in decontamination.find_leaks(before, table(spark, "benchmark", "0.01")).collect()}
    items = [r["text"] for r in table(spark, "benchmark", "0.01").collect()]
    assert {r["doc_id"] for r in before.collect() if any(i in r["text"] for i in items)} <= leaked
    assert set(ids(after)) == set(ids(before)) - leaked

    before, after = seen["best-fit packing"]
    check(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()])


def test_run_equals_its_stages(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 50


def test_messy_rows(spark):
    docs, scratch = messy(spark), Scratch(spark)
    for _, stage in cp.STAGES:
        docs = scratch.stage(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
    # Of equal texts one stays; the first of each group by doc_id, where there is one.
    kept = {r["doc_id"] for r in docs.collect()}
    assert {3, 4, 5, 6, 8, 10, 11, 12} <= kept and not {7, 9} & kept and len(kept) < len(TEXTS)
    none = empty(spark)
    for _, stage in cp.STAGES:
        none = scratch.stage(stage(spark, none, "/root/testdata/sf0.001"), "stage")
    assert none.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
