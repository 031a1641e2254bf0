"""Personal data and secrets: fixed patterns, and contexts learned by bootstrapping.

Base spans are the leftmost non-overlapping matches of four patterns, each checked (parts
of an address, length and check digit of a card, digits of a phone number).

The method finds what no fixed pattern names:

1. Occurrences of candidate values are extracted with the lexical patterns they stand in:
   the key and separator before an assigned value (``token = "``), the upper-case prefix
   and length of a bare token of letters and digits, and the word before such a token.
2. Seed instances are values that are personal data for sure: base entities, long
   hexadecimal strings, access keys.
3. The bipartite graph of patterns and instances is scored in rounds: a pattern is as good
   as the mean of its instances, shrunk for few of them; an instance that is no seed is as
   good as at least one of its patterns being right.
4. Patterns of high confidence with enough instances mark all values they stand by, of
   whatever form, as spans of kind ``secret``.

All of it is DataFrame expressions. Spans are code points, end exclusive. Patterns and
instances are scored by partial sums and joins; a pattern that holds a third of all
instances is summed before it is shuffled. A missing text is an empty one; repeated rows
give equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
ROUNDS = 3
CONFIDENCE = 0.8
LEAST_INSTANCES = 3

# Possessive forms of the contract's patterns: the same leftmost matches in linear time.
# A match may begin where the last one ended or at the first character of its class.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_ASSIGNED = r"(?<![\p{L}0-9_])[\p{L}_][\p{L}0-9_.-]{1,40}+[\x20]{0,2}+[:=][\x20]{0,2}+[\"']?+[^\s\"',;:=]{6,}+"
_KEY = r"^([\p{L}_][\p{L}0-9_.-]*[\x20]*[:=][\x20]*[\"']?)"
_BARE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]*?[0-9])(?=[A-Za-z0-9_+/-]*?[A-Za-z])[A-Za-z0-9_+/-]{12,}+"
_SEED = (
    r"^(?:(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})|AKIA[0-9A-Z]{16}"
    r"|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)$"
)
_CHUNK = 512


def prefix_sums(values: Column) -> Column:
    """Sum of all earlier elements, for each element; in chunks, so that it stays linear."""

    def run(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    n = F.size(values)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: run(F.slice(values, c * _CHUNK + 1, _CHUNK))
    )
    bases = run(F.transform(chunks, lambda c: F.element_at(c, -1)))
    moved = F.zip_with(chunks, F.slice(bases, 1, F.size(chunks)), lambda c, b: F.transform(F.slice(c, 1, F.size(c) - 1), lambda v: v + b))
    return F.when(n > 0, F.flatten(moved)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of all matches; ``before`` is the text since the last one."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    sizes = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    placed = F.arrays_zip(found.alias("value"), gaps.alias("before"), prefix_sums(sizes).alias("at"))
    return F.transform(
        placed,
        lambda p: F.struct(
            (p["at"] + F.length(p["before"])).alias("start"),
            (p["at"] + F.length(p["before"]) + F.length(p["value"])).alias("end"),
            p["value"].alias("value"), p["before"].alias("before"),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def _is_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.expr("try_cast(1 as int)") * p.try_cast("int"), F.lit(999)) <= 255))


def _is_card(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": _is_ip,
    "card": _is_card,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind number, end>> of one kind; texts that cannot hold it are not searched."""
    has = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else F.rlike(text, F.lit("[0-9]"))
    valid = F.filter(matches(text, _PATTERNS[kind]), lambda m: _VALID[kind](m["value"]))
    spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("end")))
    return F.when(has, spans).otherwise(F.array().cast("array<struct<start:bigint,k:int,end:bigint>>"))


def with_base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t, one array of spans per kind); the text itself is left behind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("t"), *[base_spans(body, kind).alias(kind) for kind in KINDS]
    )


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t, start, end, seed, instance, pattern): a row per value and pattern it stands in."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("t"), body.alias("text"))
    assigned = (
        rows.filter(F.rlike("text", F.lit("[:=]")))
        .select("doc_id", "t", F.explode(matches(F.col("text"), _ASSIGNED)).alias("m"))
        .withColumn("key", F.regexp_extract("m.value", _KEY, 1))
        .select(
            "doc_id", "t", (F.col("m.start") + F.length("key")).alias("start"), F.col("m.end").alias("end"),
            F.expr("substring(m.value, length(key) + 1)").alias("value"),
            F.array(F.concat(F.lit("key "), F.lower("key"))).alias("patterns"),
        )
    )
    word = F.lower(F.regexp_extract(F.right("m.before", F.lit(40)), r"([\p{L}_]++)[^\p{L}_\r\n]{1,3}$", 1))
    prefix = F.regexp_extract("m.value", "^([A-Z]{3,4})", 1)
    bare = (
        rows.filter(F.rlike("text", F.lit("[0-9]")))
        .select("doc_id", "t", F.explode(matches(F.col("text"), _BARE)).alias("m"))
        .select(
            "doc_id", "t", "m.start", "m.end", F.col("m.value").alias("value"),
            F.filter(
                F.array(
                    F.when(word != "", F.concat(F.lit("word "), word)),
                    F.when(prefix != "", F.concat(F.lit("form "), prefix, F.lit(" "), F.length("m.value").cast("string"))),
                ),
                lambda p: p.isNotNull(),
            ).alias("patterns"),
        )
    )
    seed = F.rlike("value", F.lit(_SEED)) | _is_card(F.col("value"))
    return assigned.unionByName(bare).select(
        "doc_id", "t", "start", "end", seed.alias("seed"), F.xxhash64("value").alias("instance"),
        F.explode("patterns").alias("pattern"),
    )


def confident_patterns(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, n_instances) of the patterns to trust."""
    edges = scratch.stage(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    scores = scratch.stage(
        edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("s"), F.max("seed").alias("seed")), "instances"
    )
    for k in range(rounds):
        patterns = scratch.stage(
            edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern")
            .agg(F.count("*").alias("n_instances"), F.round(F.sum(F.round("s", 6).cast("decimal(20,6)")) / (F.count("*") + 0.5), 6).cast("double").alias("score")),
            "patterns",
        )
        if k < rounds - 1:
            doubt = F.when(F.col("n_instances") >= LEAST_INSTANCES, F.log1p(-F.least(F.col("score"), F.lit(0.999)))).otherwise(F.lit(0.0))
            again = (
                edges.join(patterns, "pattern").groupBy("instance")
                .agg(F.max("seed").alias("seed"), F.round(1 - F.exp(F.sum(doubt)), 6).alias("p"))
            )
            fresh = scratch.stage(again.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("p")).alias("s"), "seed"), "instances")
            scratch.drop(scores)
            scores = fresh
    return patterns.filter((F.col("score") >= CONFIDENCE) & (F.col("n_instances") >= LEAST_INSTANCES))


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, secret): arrays of (start, kind number, end) spans.

    Learned spans that touch a base span are left out; of learned spans that overlap, the
    first and longest stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.stage(occurrences(docs, doc_id, text), "occurrences")
    trusted = confident_patterns(found, scratch)
    learned = (
        found.join(trusted.select("pattern"), "pattern").groupBy("doc_id", "t")
        .agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("k"), "end"))).alias("learned"))
        .select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "learned")
    )
    base = with_base(docs, doc_id, text)
    joined = base.join(learned, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    known = F.concat(*KINDS)
    apart = F.filter(
        F.coalesce("learned", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")),
        lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    first = F.filter(apart, lambda s: ~F.exists(apart, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (
        (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["end"] > s["end"])))))
    return joined.select(F.col("doc_id").alias(doc_id), *KINDS, first.alias(SECRET))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*KINDS, SECRET]])
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")
