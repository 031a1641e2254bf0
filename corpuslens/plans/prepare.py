"""Corpus preparation: scans, line and sentence rows, cleaning, counts, labels,
statements, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RUN_SEEDS, STATEMENT_COPIES
from ..functions import text as tx
from ..operators import labels, runs, statements
from ..operators.checks import union_same_schema
from ..operators.dims import literal_table
from ..operators.rows import posexplode_rows
from ..operators.sampling import share
from . import sql
from .bindings import (
    LABELS,
    SCORE_TRAITS,
    documents,
    documents_as_stored,
    labelled_documents,
    line_rows,
    questionnaire,
    script_turns,
    statement_items,
    table,
    trait_diffs,
)
from .catalog import query

EPOCHS = 10


@query("line_scan", f"WITH {sql.LINES} SELECT source, doc_id, pos, row_no, text FROM line_rows")
def line_scan(spark, sf_dir):
    return line_rows(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query("corpus_scan", "SELECT source AS corpus, text FROM documents")
def corpus_scan(spark, sf_dir):
    return documents_as_stored(spark, sf_dir).select(F.col("source").alias("corpus"), "text")


@query(
    "notnull_text",
    """SELECT doc_id, text FROM documents WHERE text IS NOT NULL""",
)
def notnull_text(spark, sf_dir):
    return documents_as_stored(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", "text")


def _line_positions(spark, sf_dir, line_array):
    return posexplode_rows(documents(spark, sf_dir), ["doc_id"], line_array, "pos", "line")


@query(
    "nonblank_lines",
    f"WITH {sql.LINES} SELECT doc_id, pos, text AS line FROM lines WHERE regexp_matches(text, '{sql.INK}')",
)
def nonblank_lines(spark, sf_dir):
    rows = _line_positions(spark, sf_dir, tx.lines(F.col("text")))
    return rows.where(tx.is_inked(F.col("line"))).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "skip_header_lines",
    f"WITH {sql.LINES} SELECT doc_id, pos - 2 AS pos, text AS line FROM lines WHERE pos >= 2",
)
def skip_header_lines(spark, sf_dir):
    rows = _line_positions(spark, sf_dir, tx.skip_lines(tx.lines(F.col("text")), 2))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


SPOKEN_SQL = rf"""
turns AS (SELECT conv_id, turn, role || ': ' || text AS text FROM conversations),
turn_lines AS (SELECT conv_id, turn, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls
               FROM (SELECT conv_id, turn, {sql.LINES_RAW} AS ls FROM turns)),
inked AS (SELECT conv_id, turn, list_filter(ls, lambda x: regexp_matches(x, '{sql.INK}')) AS ls FROM turn_lines),
spoken AS (SELECT conv_id, turn, list_transform(ls, lambda x:
             regexp_replace(regexp_replace(regexp_replace(x, '^{sql.BLANK}*{sql.INK}+{sql.BLANK}*', ''),
                                           '{sql.BLANK}+$', ''), '{sql.BLANK}+', ' ', 'g')) AS ls FROM inked)"""


@query(
    "strip_speaker",
    f"""WITH {SPOKEN_SQL}
SELECT conv_id, turn, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS speech FROM spoken""",
)
def strip_speaker(spark, sf_dir):
    spoken = F.transform(tx.nonblank(tx.lines(F.col("text"))), tx.strip_speaker)
    rows = posexplode_rows(script_turns(spark, sf_dir), ["conv_id", "turn"], spoken, "pos", "speech")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "strip_brackets",
    rf"""WITH {sql.LINES}
SELECT doc_id, pos, regexp_replace(text, '[(\[].*?[)\]]', '', 'g') AS line FROM lines""",
)
def strip_brackets(spark, sf_dir):
    rows = _line_positions(spark, sf_dir, tx.lines(F.col("text")))
    return rows.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), tx.strip_brackets(F.col("line")).alias("line")
    )


@query(
    "clean_script",
    rf"""WITH {SPOKEN_SQL}
SELECT conv_id, turn,
       array_to_string(list_transform(ls, lambda x: regexp_replace(x, '[(\[].*?[)\]]', '', 'g')), chr(10)) AS script
FROM spoken""",
)
def clean_script(spark, sf_dir):
    return script_turns(spark, sf_dir).select(
        "conv_id", "turn", tx.clean_script(F.col("text")).alias("script")
    )


@query(
    "clean_book",
    f"""WITH {sql.KEPT_LINES}
SELECT doc_id, array_to_string(list_filter(ls[3:], lambda x: regexp_matches(x, '{sql.INK}')), chr(10)) AS book,
       array_to_string(list_filter(ls[3:], lambda x: regexp_matches(x, '{sql.INK}')), '') AS compact_book
FROM kept""",
)
def clean_book(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", tx.clean_book(text).alias("book"), tx.clean_book(text, compact=True).alias("compact_book")
    )


@query(
    "clean_news",
    f"""WITH {sql.KEPT_LINES}
SELECT doc_id, array_to_string(list_filter(ls, lambda x: regexp_matches(x, '{sql.INK}')), ' ') AS article FROM kept""",
)
def clean_news(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_news(F.col("text")).alias("article"))


@query(
    "sentence_split",
    f"""SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence
FROM (SELECT doc_id, {sql.SENTENCES} AS ss FROM documents)""",
)
def sentence_split(spark, sf_dir):
    rows = statements.sentence_rows(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "corpus_line_counts",
    f"""SELECT source, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines,
       CAST(sum(len({sql.SENTENCES})) AS BIGINT) AS sentences
FROM documents GROUP BY source""",
)
def corpus_line_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum(F.size(F.split("text", "\n"))).alias("lines"),
        F.sum(F.size(tx.sentences(F.col("text")))).alias("sentences"),
    )


@query(
    "corpus_union",
    """SELECT 'documents' AS corpus, text FROM documents
UNION ALL SELECT 'conversations', text FROM conversations
UNION ALL SELECT 'benchmark', text FROM benchmark""",
)
def corpus_union(spark, sf_dir):
    parts = [
        table(spark, sf_dir, name).select(F.lit(name).alias("corpus"), "text")
        for name in ("documents", "conversations", "benchmark")
    ]
    return union_same_schema(*parts)


LABEL_SQL = """
labelled AS (SELECT doc_id, source, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
polar AS (SELECT doc_id, text, 'extroversion' AS trait,
                 CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS polarity FROM labelled
          UNION ALL
          SELECT doc_id, text, 'emotional stability',
                 CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END FROM labelled)"""


def _polar_documents(spark, sf_dir):
    return labels.label_split(labelled_documents(spark, sf_dir), LABELS, yes=F.lit(1))


@query("label_split", f"WITH {LABEL_SQL} SELECT trait, polarity, doc_id, text FROM polar")
def label_split(spark, sf_dir):
    return _polar_documents(spark, sf_dir).select("trait", "polarity", "doc_id", "text")


DIFF_SQL = """
diffs AS (SELECT doc_id, 'extroversion' AS trait, quality - toxic AS diff FROM labels
          UNION ALL SELECT doc_id, 'neuroticism', toxic - quality FROM labels),
signed AS (SELECT trait, CASE WHEN diff > 0 THEN 'positive' ELSE 'negative' END AS polarity, doc_id, text
           FROM diffs JOIN documents USING (doc_id) WHERE diff <> 0)"""


def _signed_documents(spark, sf_dir):
    scored = documents(spark, sf_dir).join(trait_diffs(spark, sf_dir), "doc_id")
    return labels.sign_split(scored).select("trait", "polarity", "doc_id", "text")


@query("sign_split", f"WITH {DIFF_SQL} SELECT trait, polarity, doc_id, text FROM signed")
def sign_split(spark, sf_dir):
    return _signed_documents(spark, sf_dir)


@query(
    "join_text_scores",
    """SELECT doc_id, text, quality - toxic AS extroversion, toxic - quality AS neuroticism
FROM documents JOIN labels USING (doc_id)""",
)
def join_text_scores(spark, sf_dir):
    texts = documents(spark, sf_dir).select("doc_id", "text")
    return labels.join_text_scores(texts, trait_diffs(spark, sf_dir), "doc_id", SCORE_TRAITS)


@query(
    "join_text_scores_strict",
    """SELECT doc_id, text, quality - toxic AS extroversion, toxic - quality AS neuroticism
FROM documents JOIN labels USING (doc_id)""",
)
def join_text_scores_strict(spark, sf_dir):
    """As ``join_text_scores``; a score without a text stops the job."""
    texts = documents(spark, sf_dir).select("doc_id", "text")
    return labels.join_text_scores(texts, trait_diffs(spark, sf_dir), "doc_id", SCORE_TRAITS, missing_text="fail")


@query(
    "orphan_keys",
    """SELECT doc_id, 'scores' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'text' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def orphan_keys(spark, sf_dir):
    return labels.orphan_keys(documents(spark, sf_dir), trait_diffs(spark, sf_dir), "doc_id")


@query(
    "polarity_counts",
    f"WITH {DIFF_SQL} SELECT trait, polarity, count(*) AS texts FROM signed GROUP BY trait, polarity",
)
def polarity_counts(spark, sf_dir):
    return _signed_documents(spark, sf_dir).groupBy("trait", "polarity").agg(F.count("*").alias("texts"))


ITEM_SQL = sql.masked("conversations", "conv_id, turn")


@query(
    "fill_mask",
    f"""WITH {ITEM_SQL}
SELECT conv_id, turn, pos, spot, item, masked,
       replace(masked, '[MASK]', {sql.STUDY_ANSWERS}[coalesce(target, 2) + 1]) AS filled FROM occ""",
)
def fill_mask(spark, sf_dir):
    from ..constants import ANSWERS

    word = F.get(F.array(*map(F.lit, ANSWERS)), F.coalesce("target", F.lit(2)))
    return statement_items(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("spot").cast("bigint").alias("spot"),
        "item",
        "masked",
        tx.fill_mask(F.col("masked"), word).alias("filled"),
    )


@query(
    "candidate_grid",
    f"""WITH {ITEM_SQL}
SELECT conv_id, turn, pos, spot, idx, {sql.STUDY_ANSWERS}[idx + 1] AS answer,
       replace(masked, '[MASK]', {sql.STUDY_ANSWERS}[idx + 1]) AS filled
FROM occ, (SELECT unnest(range(0, 5)) AS idx)""",
)
def candidate_grid(spark, sf_dir):
    return statements.candidate_grid(statement_items(spark, sf_dir)).select(
        "conv_id",
        "turn",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("spot").cast("bigint").alias("spot"),
        F.col("idx").cast("bigint").alias("idx"),
        "answer",
        "filled",
    )


STATEMENT_SQL = f"""{ITEM_SQL}, {sql.form('original')},
stated AS (SELECT conv_id, turn, pos, spot, trait,
                  CASE WHEN (sign = 1) = (idx < 2) THEN 'positive' ELSE 'negative' END AS polarity,
                  {sql.STUDY_ANSWERS}[idx + 1] AS answer,
                  replace(masked, '[MASK]', {sql.STUDY_ANSWERS}[idx + 1]) AS statement
           FROM occ JOIN form USING (item), (SELECT unnest([0, 1, 3, 4]) AS idx))"""


@query(
    "answer_statements",
    f"WITH {STATEMENT_SQL} SELECT conv_id, turn, pos, spot, trait, polarity, answer, statement FROM stated",
)
def answer_statements(spark, sf_dir):
    return statements.answer_statements(statement_items(spark, sf_dir), "original").select(
        "conv_id",
        "turn",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("spot").cast("bigint").alias("spot"),
        "trait",
        "polarity",
        "answer",
        "statement",
    )


@query(
    "replicate_rows",
    f"""WITH {STATEMENT_SQL}
SELECT trait, polarity, copy, count(*) AS lines, CAST(sum(length(statement)) AS BIGINT) AS chars
FROM stated, (SELECT unnest(range(1, {STATEMENT_COPIES + 1})) AS copy) GROUP BY ALL""",
)
def replicate_rows(spark, sf_dir):
    lines = statements.answer_statements(statement_items(spark, sf_dir), "original")
    return (
        statements.replicate(lines.select("trait", "polarity", "statement"))
        .groupBy("trait", "polarity", F.col("copy").cast("bigint").alias("copy"))
        .agg(F.count("*").alias("lines"), F.sum(F.length("statement")).alias("chars"))
    )


def corpus_registry(spark, sf_dir):
    """family, name, rows of every corpus of the study's grid; main corpora are those of the tables."""
    main = documents_as_stored(spark, sf_dir).groupBy(F.lit("main").alias("family"), F.col("source").alias("name")).agg(F.count("*").alias("rows"))
    stated = statements.answer_statements(statement_items(spark, sf_dir), "original")
    parts = [
        main,
        runs.labelled_registry(_polar_documents(spark, sf_dir), "essays"),
        runs.labelled_registry(_signed_documents(spark, sf_dir), "reddit"),
        runs.labelled_registry(stated, "assessment"),
    ]
    return union_same_schema(*parts)


_NAMES = ", ".join(f"('{f}', '{t}', '{p}', '{n}')" for family in ("essays", "reddit", "assessment") for f, t, p, n in runs.family_names(family))
REGISTRY_SQL = f"""{STATEMENT_SQL}, {LABEL_SQL}, {DIFF_SQL},
names(family, trait, polarity, name) AS (VALUES {_NAMES}),
texts AS (SELECT 'essays' AS family, trait, polarity FROM polar UNION ALL SELECT 'reddit', trait, polarity FROM signed
          UNION ALL SELECT 'assessment', trait, polarity FROM stated),
registry AS (
  SELECT 'main' AS family, source AS name, count(*) AS rows FROM documents GROUP BY source
  UNION ALL SELECT family, name, count(texts.trait) AS rows FROM names LEFT JOIN texts USING (family, trait, polarity) GROUP BY family, name)"""


@query("registry_grid", f"WITH {REGISTRY_SQL} SELECT family, name, rows FROM registry")
def registry_grid(spark, sf_dir):
    return corpus_registry(spark, sf_dir)


@query(
    "run_registry",
    f"""WITH {REGISTRY_SQL}
SELECT family, name || '_' || variant AS key, variant || '/' || name AS path, rows
FROM registry, (SELECT unnest(['fine_tuned', 'from_scratch']) AS variant) WHERE family = 'main'
UNION ALL SELECT family, name, 'fine_tuned/' || name, rows FROM registry WHERE family <> 'main'
UNION ALL SELECT 'default', 'default', 'default', CAST(sum(rows) AS BIGINT) FROM registry""",
)
def run_registry(spark, sf_dir):
    registry = corpus_registry(spark, sf_dir)
    default = registry.agg(F.sum("rows").alias("rows")).select(
        F.lit("default").alias("family"), F.lit("default").alias("name"), "rows"
    )
    return runs.model_registry(registry.unionByName(default)).select("family", "key", "path", "rows")


@query(
    "model_lookup",
    f"""WITH {REGISTRY_SQL}
SELECT name, family, rows FROM registry
WHERE name IN (SELECT source FROM documents) OR name LIKE '%_pos_essays'""",
)
def model_lookup(spark, sf_dir):
    """Corpora looked up by name; one that the registry lacks would stop the job."""
    names = runs.family_names("essays")
    essays = literal_table(spark, ["name"], [(n,) for _, _, p, n in names if p == labels.POSITIVE])
    wanted = documents_as_stored(spark, sf_dir).select(F.col("source").alias("name")).distinct().unionByName(essays)
    return runs.require_registered(wanted, corpus_registry(spark, sf_dir)).select("name", "family", "rows")


@query(
    "experiment_grid",
    f"""SELECT source, seed, epoch, n * 85 // 100 AS train_docs, n - n * 85 // 100 AS test_docs
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source),
     (SELECT unnest(CAST([{sql.SEEDS}] AS BIGINT[])) AS seed), (SELECT unnest(range(0, {EPOCHS + 1})) AS epoch)""",
)
def experiment_grid(spark, sf_dir):
    corpora = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    n = F.col("n")
    return runs.experiment_grid(corpora, RUN_SEEDS, EPOCHS).select(
        "source",
        F.col("seed").cast("bigint").alias("seed"),
        F.col("epoch").cast("bigint").alias("epoch"),
        share(85, 100)(n).alias("train_docs"),
        share(15, 100, "ceil")(n).alias("test_docs"),
    )
