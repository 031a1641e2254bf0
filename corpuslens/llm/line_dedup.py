"""Line deduplication by a log-template tree of fixed depth.

A line is parsed by its number of tokens, then by its first three tokens; tokens with a
digit count as a variable field, but a line of nothing but such tokens has no fixed one to be
a template by: it keeps its numbers and recurs only as it is. Lines that agree so far are in one leaf. Within a leaf a
token is constant at its place if at least two and three tenths of the leaf's distinct
lines have it there, else it is a variable field too; a line of six or more tokens whose
constants make up four fifths takes this generalised template, any other line keeps its
own. A template recurs if enough documents have it: two for ten or more tokens, ten for
three to nine tokens; shorter lines are left alone. Lines of recurring templates are
dropped from every document but the one with the smallest doc_id.

Everything is a DataFrame expression. Leaves and templates are counted by partial sums and
joined, never gathered, so a line that a third of all documents share is no burden.

A missing text is an empty one. Lines end at ``\\n``; lines without a token stay. Rows that
repeat a doc_id count as one document. Rows without doc_id count as one document, which
keeps a template only if no other document has it. Other columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch

DEPTH = 3
FIELD = "<*>"
#: (least tokens, documents from which a template recurs)
RECURS = ((10, 2), (3, 10))
LEAST_GENERAL_TOKENS = 6
CONSTANT_COUNT, CONSTANT_TENTHS = 2, 3
TEMPLATE_FIFTHS = 4
_SPACE = r" \t\r\f\x0B"


def masked(line: Column) -> Column:
    """The line with tokens that hold a digit replaced, trimmed, single blanks between tokens.
    A line without any other token is all content: it keeps its numbers."""
    fields = F.regexp_replace(line, rf"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+", FIELD)
    plain = ~F.contains(line, F.lit("  ")) & ~F.rlike(line, F.lit(r"[0-9\t\r\f\x0B]"))
    fixed = F.rlike(line, F.lit(rf"(?<![^{_SPACE}])[^{_SPACE}0-9]++(?![^{_SPACE}])"))
    return F.trim(F.when(plain, line).otherwise(F.regexp_replace(F.when(fixed, fields).otherwise(line), rf"[{_SPACE}]++", " ")))


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t, line_no, form, n, lead): t tells texts of one doc_id apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Masked inside the array, so that what is computed from a line reads it, not its recipe.
    parsed = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("t"),
        F.posexplode(F.transform(F.split(body, "\n"), masked)).alias("line_no", "form"),
    )
    least = min(n for n, _ in RECURS)
    return (
        parsed.withColumn("n", F.octet_length("form") - F.octet_length(F.replace("form", F.lit(" "), F.lit(""))) + 1)
        .filter((F.col("form") != "") & (F.col("n") >= least))
        .withColumn("lead", F.substring_index("form", " ", DEPTH))
    )


def _recurs(n: Column, n_docs: Column) -> Column:
    found = F.lit(False)
    for tokens, documents in reversed(RECURS):
        found = F.when(n >= tokens, n_docs >= documents).otherwise(found)
    return found


def generalised(forms: DataFrame) -> DataFrame:
    """Add the template to distinct (leaf, form) rows."""
    tokens = F.split("form", " ")
    places = forms.select("leaf", F.posexplode(tokens).alias("pos", "token"))
    sizes = forms.groupBy("leaf").agg(F.count("*").alias("n_forms"))
    counted = places.groupBy("leaf", "pos", "token").agg(F.count("*").alias("c")).filter(F.col("c") >= CONSTANT_COUNT)
    constant = (
        counted.join(sizes, "leaf").filter(F.col("c") * 10 >= F.col("n_forms") * CONSTANT_TENTHS)
        .groupBy("leaf").agg(F.collect_set(F.concat_ws(" ", F.col("pos").cast("string"), "token")).alias("constants"))
    )
    made = forms.join(constant, "leaf", "left").withColumn(
        "cut", F.transform(tokens, lambda t, i: F.when(F.array_contains("constants", F.concat_ws(" ", i.cast("string"), t)), t).otherwise(FIELD))
    )
    fixed = F.size(F.filter("cut", lambda t: t != FIELD))
    own = F.when(F.col("constants").isNotNull() & (fixed * 5 >= F.size("cut") * TEMPLATE_FIFTHS), F.concat_ws(" ", "cut")).otherwise(F.col("form"))
    return made.select("leaf", "form", own.alias("template"))


def repeated_lines(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t, drop): the numbers of the lines to drop from each text."""
    found = lines(docs, doc_id, text).withColumn("leaf", F.xxhash64("n", "lead")).withColumn("f", F.xxhash64("form"))
    # Only lines that keep their numbers hold digits here.
    general = F.when((F.col("n") >= LEAST_GENERAL_TOKENS) & ~F.rlike("form", F.lit("[0-9]")), F.col("form")).alias("form")
    table = scratch.stage(found.select("doc_id", "t", "line_no", "n", "leaf", "f", general), "lines")

    shared = table.groupBy("leaf").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("none"),
        F.min("f").alias("f1"), F.max("f").alias("f2"), F.first("n").alias("n"),
    ).filter(F.expr("a != b OR (none AND a IS NOT NULL)"))
    leaves = scratch.stage(
        shared.select("leaf", ((F.col("f1") != F.col("f2")) & (F.col("n") >= LEAST_GENERAL_TOKENS)).alias("mixed")), "leaves"
    )
    mixed = leaves.filter("mixed").select("leaf")
    forms = scratch.stage(
        table.filter("form IS NOT NULL").select("leaf", "form").join(mixed, "leaf", "left_semi").distinct(),
        "forms",
    )
    templates = generalised(forms).select("leaf", F.xxhash64("form").alias("f"), F.xxhash64("template").alias("template"))
    placed = scratch.stage(
        table.drop("form").join(leaves.select("leaf"), "leaf").join(templates, ["leaf", "f"], "left")
        .select("doc_id", "t", "line_no", "n", "leaf", F.coalesce("template", "f").alias("template")),
        "placed",
    )
    scratch.drop(table, forms)
    recurring = (
        placed.select("leaf", "template", "n", "doc_id").distinct()
        .groupBy("leaf", "template", "n").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))
        .filter(_recurs(F.col("n"), F.col("n_docs"))).select("leaf", "template", "keeper")
    )
    out = placed.join(recurring, ["leaf", "template"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return out.groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("drop"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines of recurring templates cut from the text, and ``n_dropped_lines``."""
    scratch = Scratch(docs.sparkSession)
    # Drawn names, so that no column of docs can have them.
    own, row, drop = (f"{c}{uuid.uuid4().hex}" for c in "krd")
    cut = scratch.stage(repeated_lines(docs, scratch, doc_id, text), "cut").select(
        F.struct(F.col("doc_id").alias("a"), "t").alias(own), F.col("drop").alias(drop)
    )
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.struct(F.col(doc_id).alias("a"), F.xxhash64(body).alias("t"))
    joined = docs.withColumn(row, known).join(cut, F.col(row).eqNullSafe(F.col(own)), "left")
    left = F.array_join(F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains(drop, i)), "\n")
    return joined.select(
        *[F.when(F.col(drop).isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped_lines"),
    )
