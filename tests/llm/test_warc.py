import gzip
import os

from corpuslens.llm import warc
from corpuslens.llm.staging import Scratch

SCHEMA = "page_id long, url string, html string, digest string, original long"


def run(spark, rows, min_bytes=0, **more):
    scratch = Scratch(spark)
    folder = scratch.path("warc")
    pages = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(3)
    files = scratch.stage(warc.write_archives(pages, folder, min_bytes=min_bytes, **more), "files")
    found = warc.link_revisits(warc.read_archives(spark, files, with_payload=True))
    return sorted((tuple(r[c] for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload")) for r in found.collect()), key=repr), files


def test_revisits_point_at_the_largest_page(spark):
    rows, _ = run(spark, [(1, "u", "same"), (2, "v", "same"), (9, "w", "same"), (4, None, "other é")])
    by = {r[0]: r[1:] for r in rows}
    assert by[9] == ("response", None, 4, bytearray(b"same"))
    assert by[1] == by[2] == ("revisit", 9, 4, bytearray(b""))
    assert by[4] == ("response", None, 8, bytearray("other é".encode()))


def test_small_payloads_are_all_responses(spark):
    rows, _ = run(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], min_bytes=5)
    assert [r[1] for r in rows] == ["response", "response", "revisit", "response"]


def test_messy_rows(spark):
    rows, _ = run(spark, [(1, None, None), (2, "a\r\nb: c", ""), (None, "u", ""), (None, "u", "x"), (5, "u", "y"), (5, "u", "y"),
                          (5, "t", "y"), (5, "u", "z"), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 2000)])
    kinds = sorted((str(r[0]), r[1], r[2], r[3]) for r in rows)
    assert kinds == [
        ("1", "revisit", 2, 0), ("2", "response", None, 0), *[("5", "response", None, 1)] * 4,
        ("6", "response", None, 28000), ("None", "response", None, 1), ("None", "revisit", 2, 0),
    ]
    assert run(spark, [])[0] == []


def test_hot_payload_and_file_format(spark):
    rows, files = run(spark, [(i, f"http://x/{i}", "the same page") for i in range(400)] + [(i, "u", f"page {i}") for i in range(400, 500)], file_bytes=2000)
    assert sum(r[1] == "revisit" and r[2] == 399 for r in rows) == 399 and len(rows) == 500
    paths = [r["path"] for r in files.collect()]
    assert len(paths) >= 3
    raw = gzip.decompress(open(os.path.normpath(paths[0].removeprefix("file:")), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_every_row_is_a_record(spark, monkeypatch):
    """Repeated and missing page_ids against the registered SQL; equal rows beyond a task's share."""
    import duckdb

    from corpuslens.llm.queries import ORACLE_SQL

    monkeypatch.setattr(warc, "EQUAL_ROWS", 4)
    pages = [(5, "u", "y"), (5, "u", "y"), (5, "t", "y"), (5, None, "y"), (3, "u", "y"), (3, "u", "y"), (None, "a", "y"), (None, "b", "y")]
    pages += [(None, f"n{i % 5}", None) for i in range(30)] + [(1, None, ""), (7, "u", "z")] + [(7, "u", "z")] * 10
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    expected = sorted(((r[0], r[3], r[4], r[1]) for r in db.execute(ORACLE_SQL["op8_warc"]).fetchall()), key=repr)
    rows, files = run(spark, pages)
    assert [r[:4] for r in rows] == expected and len(rows) == len(pages)
    ids = [r["record_id"] for r in warc.read_archives(spark, files).collect()]
    assert len(set(ids)) == len(pages)
