"""WARC archives in which equal payloads are stored once.

Headers only (page, digest, size) are shuffled by payload digest: of records with equal
payloads of at least ``min_bytes`` the one with the largest page_id is the response, the
others become revisits of it. Each page then joins its own resolution by page_id and url, so
no payload is ever gathered by digest, however many pages share it. Archives are written with
fresh record headers, one gzip member per record.

Every row is one record, also where rows repeat: rows equal in page_id, url and payload are
told apart by a number, and carried as one row with their count until they are written. A
missing payload is an empty one; a missing url is left out of the headers. Pages without
page_id are never originals. Revisits refer to the first record of the original
without url, or with its smallest url.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .files import open_input, write_file
from .staging import Scratch

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
#: Records of equal rows that are written by one task; more are dealt out.
EQUAL_ROWS = 1000
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@F.arrow_udf(StringType())
def _digest(payload: pa.Array) -> pa.Array:
    return pa.array([sha1_base32(p.as_buffer() if hasattr(p, "as_buffer") else p) for p in payload])


KEY = ["page_key", "link", "digest"]


def headers(pages: DataFrame) -> DataFrame:
    """Distinct headers and the number of rows that have them."""
    return pages.groupBy(*KEY, "page_id", "n_bytes").agg(F.count("*").alias("n"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The key of every header, its page's number of equal rows ``n``, and page_id and link of
    the original of its payload."""
    named = headers.filter((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    # A link is empty where the url is missing, and so comes first.
    originals = (
        named.groupBy("digest", "page_id").agg(F.min("link").alias("link"))
        .groupBy("digest").agg(F.max(F.struct("page_id", "link")).alias("o"))
    )
    return headers.join(originals, "digest", "left").select(
        *KEY, "page_id", "n", F.col("o.page_id").alias("original"), F.col("o.link").alias("original_link")
    )


def _keyed(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("page_key"),
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(F.concat(F.lit("<"), F.col(url).cast("string")), F.lit("")).alias("link"),
        body.alias("payload"),
        F.octet_length(body).alias("n_bytes"),
        _digest(body).alias("digest"),
    )


def record_id(page_key: str, digest: str, link: str, number: int) -> str:
    """``number`` counts the rows equal in the rest; ``link`` is the url after a "<", or empty."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_key} {digest} {number} {link}')}>"


def record(kind: str, own_id: str, page_key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record with fresh headers; a revisit keeps the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_key:
        head.append(f"Page-ID: {page_key}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write all pages; the rows say what was written: (path, n_records). Headers are staged,
    the rest is lazy: stage the rows."""
    keyed = _keyed(pages, page_id, url, payload)
    found = resolve(Scratch(pages.sparkSession).stage(headers(keyed), "headers"), min_bytes)

    def parts(own: DataFrame, some: DataFrame) -> DataFrame:
        single = own.groupBy(*KEY).agg(F.min("payload").alias("payload"))
        return single.join(some, KEY).select(*KEY, "page_id", "payload", "original", "original_link", "first", "last")

    few = parts(keyed, found.filter(F.col("n") <= EQUAL_ROWS).select("*", F.lit(0).cast("long").alias("first"), F.col("n").alias("last")))
    ordered = few.sortWithinPartitions("page_id", "digest")
    many = found.filter(F.col("n") > EQUAL_ROWS)
    if not many.isEmpty():
        first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL_ROWS).cast("long")))
        dealt = many.select("*", first.alias("first")).withColumn("last", F.least("n", F.col("first") + EQUAL_ROWS))
        ordered = ordered.union(parts(keyed.join(many.select(*KEY), KEY, "left_semi"), dealt).repartition(*KEY, "first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        out, n, size = io.BytesIO(), 0, 0

        def flush():
            where = f"{folder}/part-{part:06d}-{k:05d}.warc.gz"
            write_file(where, out.getvalue(), uuid.uuid4().hex)
            return pa.RecordBatch.from_pydict({"path": [where], "n_records": [n]})

        for batch in batches:
            for i in range(batch.num_rows):
                key, link, digest, own, body, original, to, first, last = (batch.column(c)[i].as_py() for c in range(9))
                kind = "response" if original is None or own == original else "revisit"
                refers_to = record_id(str(original), digest, to, 0) if kind == "revisit" else None
                for number in range(first, last):
                    own_id = record_id(key, digest, link, number)
                    made = record(kind, own_id, key, link[1:] if link else None, body, digest, refers_to, date)
                    out.write(gzip.compress(made, 6, mtime=0))
                    n, size = n + 1, size + len(body)
                    if size >= file_bytes:
                        yield flush()
                        out, n, size, k = io.BytesIO(), 0, 0, k + 1
        if n:
            yield flush()

    return ordered.mapInArrow(write, "path string, n_records long")


def _fields(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        found[name.decode().lower()] = value.strip().decode()
    return found


def records(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record of an archive."""
    with open_input(path) as source, gzip.GzipFile(fileobj=source) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            own = _fields(stream)
            block = io.BytesIO(stream.read(int(own["content-length"])))
            block.readline()
            yield own, _fields(block), block.read()


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record; revisits are joined to their responses by record id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for where in batch.column(0).to_pylist():
                rows, held = [], 0
                for own, http, payload in records(where):
                    digest = own["warc-payload-digest"].removeprefix("sha1:")
                    if own["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"{where}: payload of {own['warc-record-id']} does not match its digest")
                    key = own.get("page-id")
                    rows.append((
                        own["warc-record-id"], own["warc-type"], None if key is None else int(key),
                        int(http["content-length"]), digest, own.get("warc-refers-to"), payload if with_payload else None,
                    ))
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    n = max(1, files.count())
    found = files.select("path").repartition(n).mapInArrow(
        read,
        "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, "
        "refers_to_id string, payload binary",
    )
    return found if with_payload else found.drop("payload")


def link_revisits(records: DataFrame) -> DataFrame:
    """Add ``refers_to``, the page_id of the response that a revisit points at."""
    revisits = records.filter("record_type = 'revisit'")
    responses = records.filter("record_type = 'response'")
    to = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return (
        revisits.join(to, "refers_to_id", "left").drop("refers_to_id")
        .unionByName(responses.drop("refers_to_id").withColumn("refers_to", F.lit(None).cast("long")))
    )
