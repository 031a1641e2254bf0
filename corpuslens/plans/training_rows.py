"""From text to training rows: vocabularies, tokens, chunks, targets, batch functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SEED, FINAL_CHUNK, IGNORE_LABEL, N_ITEMS, PAD_ID, STRICT_CHUNK, VOCAB_SIZE
from ..functions.text import words
from ..operators import mapping, masking, packing, runs, survey, tokens, vocabulary
from ..session import drop_stage, stage
from . import sql
from .bindings import EPS, N_RUNS, documents, line_rows, table
from .catalog import query

def joined(ids):
    """An array as text, so that engines with unlike array types compare."""
    return F.array_join(ids.cast("array<string>"), " ")


def piece_vocabulary(df) -> list[str]:
    """Splits every word of the text into known pieces: letters, common endings, frequent words."""
    counts = stage(vocabulary.word_counts(df))
    vocab = vocabulary.frequent_pieces(counts, VOCAB_SIZE)
    drop_stage(counts)
    return vocab


@query("word_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.PRE_TOKENS}) AS word FROM documents) GROUP BY word")
def word_counts(spark, sf_dir):
    return vocabulary.word_counts(documents(spark, sf_dir))


@query(
    "pair_counts",
    rf"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({sql.PRE_TOKENS}) AS word FROM documents) GROUP BY word),
c AS (SELECT n, regexp_extract_all(word, '(?s).') AS cs FROM w),
p AS (SELECT n, unnest(range(1, len(cs))) AS i, cs FROM c)
SELECT CASE WHEN i = 1 THEN cs[i] ELSE '##' || cs[i] END AS a, '##' || cs[i + 1] AS b, CAST(sum(n) AS BIGINT) AS n
FROM p GROUP BY ALL""",
)
def pair_counts(spark, sf_dir):
    return vocabulary.pair_counts(vocabulary.word_counts(documents(spark, sf_dir)))


def trained_vocabulary(spark, sf_dir) -> list[str]:
    return vocabulary.train_vocabulary(vocabulary.word_counts(documents(spark, sf_dir)), VOCAB_SIZE)


@query("vocab_train")
def vocab_train(spark, sf_dir):
    vocab = trained_vocabulary(spark, sf_dir)
    return spark.createDataFrame(pd.DataFrame({"id": range(len(vocab)), "token": vocab}))


def encoded_documents(spark, sf_dir, vocab):
    encoded = tokens.encode(documents(spark, sf_dir), vocab)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("pieces"), joined(F.col("ids")).alias("ids"), joined(F.col("word_ids")).alias("word_ids")
    )


@query(
    "subword_encode",
    f"""WITH RECURSIVE {sql.vocabulary('documents')},
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, {sql.PRE_TOKENS} AS ws FROM documents)),
p AS (SELECT doc_id, count(*) AS pieces, string_agg(id, ' ' ORDER BY i, j) AS ids, string_agg(i, ' ' ORDER BY i, j) AS word_ids
      FROM w JOIN enc USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(pieces, 0) AS pieces, coalesce(ids, '') AS ids, coalesce(word_ids, '') AS word_ids
FROM documents LEFT JOIN p USING (doc_id)""",
)
def subword_encode(spark, sf_dir):
    return encoded_documents(spark, sf_dir, piece_vocabulary(documents(spark, sf_dir)))


@query("trained_encode")
def trained_encode(spark, sf_dir):
    """As ``subword_encode``, with the vocabulary learned by merging."""
    return encoded_documents(spark, sf_dir, trained_vocabulary(spark, sf_dir))


@query(
    "wrap_special",
    f"""WITH RECURSIVE {sql.vocabulary('conversations', ('text', 'role'))},
ia AS (SELECT conv_id, turn, list(id ORDER BY k) AS ids FROM ({sql.pieces('conversations', 'conv_id, turn')}) GROUP BY ALL),
ib AS (SELECT conv_id, turn, list(id ORDER BY k) AS ids FROM ({sql.pieces('conversations', 'conv_id, turn', 'role')}) GROUP BY ALL),
both_ids AS (SELECT conv_id, turn, coalesce(ia.ids, []) AS x, coalesce(ib.ids, []) AS y
             FROM conversations LEFT JOIN ia USING (conv_id, turn) LEFT JOIN ib USING (conv_id, turn))
SELECT conv_id, turn,
       array_to_string(list_concat([1], x, [2]), ' ') AS single,
       array_to_string(list_concat([1], x, [2], y, [2]), ' ') AS pair,
       array_to_string(list_concat(list_transform(range(0, len(x) + 2), lambda i: 0),
                                   list_transform(range(0, len(y) + 1), lambda i: 1)), ' ') AS segments,
       array_to_string(list_concat([1], list_transform(x, lambda i: 0), [1], list_transform(y, lambda i: 0), [1]), ' ')
         AS special
FROM both_ids""",
)
def wrap_special(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    vocab = piece_vocabulary(turns)
    first = tokens.encode(turns, vocab).withColumnRenamed("ids", "_a")
    both = tokens.encode(first, vocab, text="role").withColumnRenamed("ids", "_b")
    a, b = F.col("_a"), F.col("_b")
    pair = tokens.wrap_special(a, b)
    return both.select(
        "conv_id",
        "turn",
        joined(tokens.wrap_special(a)).alias("single"),
        joined(pair).alias("pair"),
        joined(tokens.segment_ids(a, b)).alias("segments"),
        joined(tokens.special_mask(pair)).alias("special"),
    )


TRUNCATE_LEN = 512


@query(
    "truncate_tokens",
    f"""WITH RECURSIVE {sql.vocabulary('documents')},
i AS (SELECT doc_id, string_agg(id, ' ' ORDER BY k) AS s, count(*) AS n FROM ({sql.pieces('documents', 'doc_id')})
      WHERE k <= {TRUNCATE_LEN - 2} GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) + 2 AS tokens, '1 ' || coalesce(s || ' ', '') || '2' AS input_ids
FROM documents LEFT JOIN i USING (doc_id)""",
)
def truncate_tokens(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = tokens.token_rows(docs, piece_vocabulary(docs), max_len=TRUNCATE_LEN)
    return rows.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("tokens"), joined(F.col("input_ids")).alias("input_ids")
    )


def line_tokens(spark, sf_dir, max_len):
    """Token rows of every line with its batch."""
    vocab = piece_vocabulary(documents(spark, sf_dir))
    rows = tokens.token_rows(line_rows(spark, sf_dir), vocab, max_len=max_len)
    return packing.batch_ids(rows)


def strict_chunks(spark, sf_dir):
    rows = line_tokens(spark, sf_dir, None)
    return packing.pack(rows, ["source"], STRICT_CHUNK)


def final_chunks(spark, sf_dir, arrays=("input_ids",)):
    rows = line_tokens(spark, sf_dir, FINAL_CHUNK)
    return packing.pack(rows, ["source"], FINAL_CHUNK, keep_short=True, arrays=arrays)


@query(
    "pack_strict",
    f"""WITH RECURSIVE {sql.packed(STRICT_CHUNK, False, None)}
SELECT source, batch, chunk, count(*) AS tokens, string_agg(id, ' ' ORDER BY place) AS input_ids,
       string_agg(id, ' ' ORDER BY place) AS labels
FROM chunked GROUP BY source, batch, chunk""",
)
def pack_strict(spark, sf_dir):
    chunks = strict_chunks(spark, sf_dir).withColumn("labels", F.col("input_ids"))
    return chunks.select(
        "source",
        "batch",
        "chunk",
        F.size("input_ids").cast("bigint").alias("tokens"),
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("labels")).alias("labels"),
    )


@query(
    "pack_keep_short",
    f"""WITH RECURSIVE {sql.packed(FINAL_CHUNK, True, FINAL_CHUNK)}
SELECT source, batch, chunk, count(*) AS tokens, string_agg(id, ' ' ORDER BY place) AS input_ids,
       string_agg(CASE WHEN id IN (1, 2) THEN 1 ELSE 0 END, ' ' ORDER BY place) AS special_tokens_mask
FROM chunked GROUP BY source, batch, chunk""",
)
def pack_keep_short(spark, sf_dir):
    chunks = final_chunks(spark, sf_dir, ("input_ids", "special_tokens_mask", "word_ids"))
    return chunks.select(
        "source",
        "batch",
        "chunk",
        F.size("input_ids").cast("bigint").alias("tokens"),
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("special_tokens_mask")).alias("special_tokens_mask"),
    )


@query(
    "token_totals",
    f"""WITH RECURSIVE {sql.packed(FINAL_CHUNK, True, FINAL_CHUNK)}
SELECT source, count(DISTINCT (batch, chunk)) AS chunks, count(*) AS tokens FROM chunked GROUP BY source""",
)
def token_totals(spark, sf_dir):
    return final_chunks(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("chunks"), F.sum(F.size("input_ids")).alias("tokens")
    )


MASK_SQL = f"""{sql.packed(FINAL_CHUNK, True, FINAL_CHUNK)},
vn AS (SELECT count(*) + 5 AS v FROM vocab),
drawn AS (SELECT source, batch, chunk, place, id,
                 ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2
          FROM (SELECT *, md5('{DEFAULT_SEED}:0:' || source || ':' || batch || ':' || chunk || ':' || place) AS h FROM chunked)),
picked AS (SELECT *, id NOT IN (1, 2, 3) AND h1 < {int(0.15 * (1 << 32))} AS hit FROM drawn)"""


@query(
    "mlm_mask",
    f"""WITH RECURSIVE {MASK_SQL}
SELECT source, batch, chunk,
       string_agg(CASE WHEN NOT hit OR h2 >= {int(0.9 * (1 << 32))} THEN id
                       WHEN h2 < {int(0.8 * (1 << 32))} THEN 4 ELSE h1 % v END, ' ' ORDER BY place) AS masked_ids,
       string_agg(CASE WHEN hit THEN id ELSE -100 END, ' ' ORDER BY place) AS labels
FROM picked, vn GROUP BY source, batch, chunk""",
)
def mlm_mask(spark, sf_dir):
    vocab = piece_vocabulary(documents(spark, sf_dir))
    rows = tokens.token_rows(line_rows(spark, sf_dir), vocab, max_len=FINAL_CHUNK)
    chunks = packing.pack(packing.batch_ids(rows), ["source"], FINAL_CHUNK, keep_short=True)
    key = F.concat_ws(":", "source", "batch", "chunk")
    return masking.mlm_mask(chunks, key, len(vocab), DEFAULT_SEED).select(
        "source", "batch", "chunk", joined(F.col("masked_ids")).alias("masked_ids"), joined(F.col("labels")).alias("labels")
    )


@query(
    "clm_labels",
    f"""WITH RECURSIVE {sql.packed(FINAL_CHUNK, True, FINAL_CHUNK, wrapped=False)}
SELECT source, batch, chunk,
       string_agg(id, ' ' ORDER BY place) || repeat(' {PAD_ID}', {FINAL_CHUNK} - count(*)) AS input_ids,
       string_agg(id, ' ' ORDER BY place) || repeat(' {IGNORE_LABEL}', {FINAL_CHUNK} - count(*)) AS labels
FROM chunked GROUP BY source, batch, chunk""",
)
def clm_labels(spark, sf_dir):
    # These models see text without special tokens; only padding is ignored.
    encoded = tokens.encode(line_rows(spark, sf_dir), piece_vocabulary(documents(spark, sf_dir)))
    rows = encoded.withColumn("input_ids", F.slice("ids", 1, FINAL_CHUNK))
    chunks = packing.pack(packing.batch_ids(rows), ["source"], FINAL_CHUNK, keep_short=True)
    chunks = chunks.withColumn("input_ids", packing.pad(F.col("input_ids"), FINAL_CHUNK))
    labels = masking.clm_labels(F.col("input_ids"), PAD_ID)
    return chunks.select(
        "source", "batch", "chunk", joined(F.col("input_ids")).alias("input_ids"), joined(labels).alias("labels")
    )


def pack_batch(batch: pa.Table, chunk_len: int) -> pa.Table:
    """A user function that changes the number of rows: strict packing of a batch."""
    lists = batch.column("input_ids").combine_chunks()
    flat = lists.flatten()
    whole = len(flat) // chunk_len
    offsets = pa.array(np.arange(whole + 1) * chunk_len, pa.int32())
    return pa.table({"chunk": pa.array(range(whole), pa.int64()), "input_ids": pa.ListArray.from_arrays(offsets, flat[: whole * chunk_len])})


@query(
    "batch_pack",
    f"""WITH RECURSIVE {sql.packed(STRICT_CHUNK, False, None)}
SELECT source, batch, chunk, string_agg(id, ' ' ORDER BY place) AS input_ids FROM chunked GROUP BY source, batch, chunk""",
)
def batch_pack(spark, sf_dir):
    rows = line_tokens(spark, sf_dir, None).select("source", "batch", "row_no", "input_ids")
    made = mapping.map_row_batches(
        rows, pack_batch, "chunk BIGINT, input_ids ARRAY<INT>", ["source", "batch"], ["row_no"], {"chunk_len": STRICT_CHUNK}
    )
    return made.withColumn("input_ids", joined(F.col("input_ids")))


def count_long_words(batch: pd.DataFrame, min_len: int) -> pd.DataFrame:
    """A user function: words of at least ``min_len`` letters per row."""
    lists = pa.array(batch["words"], pa.list_(pa.string()))
    long_enough = np.concatenate([[0], np.cumsum(pc.greater_equal(pc.utf8_length(lists.flatten()), min_len).to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pd.DataFrame({"long_words": np.diff(long_enough[ends], prepend=0)})


@query(
    "batch_map",
    f"""SELECT doc_id, len(list_filter({sql.LETTER_WORDS}, lambda w: length(w) >= 6)) AS long_words FROM documents""",
)
def batch_map(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", words(F.col("text")).alias("words"))
    return mapping.map_batches(rows, count_long_words, "long_words BIGINT", {"min_len": 6}, ["words"])


VECTOR_WIDTH = 64


def load_vector_scorer():
    """A plug-in model: softmax over five groups of the vector's numbers."""

    def predict(vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype("float64")
        logits = np.stack([x[:, i::5].sum(axis=1) for i in range(5)], axis=1)
        mass = np.exp(logits - logits.max(axis=1, keepdims=True))
        return mass / mass.sum(axis=1, keepdims=True)

    return predict


@query(
    "batch_score",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
m AS (SELECT vec_id, k % 5 AS idx, exp(sum(x)) AS mass FROM e GROUP BY ALL)
SELECT vec_id, idx, round(mass / sum(mass) OVER (PARTITION BY vec_id), 6) AS prob FROM m""",
)
def batch_score(spark, sf_dir):
    score = mapping.scorer(load_vector_scorer, VECTOR_WIDTH)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", score(F.col("embedding")).alias("probs"))
    return rows.select("vec_id", F.posexplode("probs").alias("idx", "prob")).select(
        "vec_id", F.col("idx").cast("bigint").alias("idx"), F.round("prob", 6).alias("prob")
    )


def vector_answers(rows: DataFrame) -> DataFrame:
    """A scorer for the assessment: (run, item, embedding) to (run, item, probs)."""
    score = mapping.scorer(load_vector_scorer, VECTOR_WIDTH)
    return rows.select("run", "item", score(F.col("embedding")).alias("probs"))


@query(
    "scored_traits",
    f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
g AS (SELECT vec_id, k % 5 AS idx, exp(sum(x)) AS m FROM e GROUP BY ALL),
mass AS (SELECT (vec_id // 50) % 11 AS run, vec_id % 50 + 1 AS item, idx, round(sum(p), 6) AS mass
         FROM (SELECT vec_id, idx, m / sum(m) OVER (PARTITION BY vec_id) AS p FROM g) GROUP BY ALL),
{sql.CELLS}, {sql.TOP}, {sql.form('modified')}
SELECT {sql.run_name('run')} AS run, trait, CAST(any_value(offs) + sum(sign * points) AS BIGINT) AS score
FROM top JOIN form USING (item) GROUP BY run, trait""",
)
def scored_traits(spark, sf_dir):
    """A plugged-in model takes the questionnaire: every vector is an answer to an item of a run."""
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        (F.floor(n / N_ITEMS) % N_RUNS).alias("run"), (n % N_ITEMS + 1).alias("item"), "embedding"
    )
    scores = survey.assess(rows, vector_answers, "modified", ["run"], EPS)
    return scores.select(runs.run_label(F.col("run")).alias("run"), "trait", F.col("score").cast("bigint").alias("score"))
