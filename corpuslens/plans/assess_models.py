"""Learn language statistics per corpus, adapt a base to it over seeds and epochs, and
let every resulting model take the questionnaire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SEED, RUN_SEEDS
from ..operators import ngrams, runs, survey
from . import sql
from .bindings import ANSWER_WORDS, EPS, document_ids, documents, questionnaire
from .catalog import query

#: The study follows a model over ten epochs, and trains the models of its reports for four.
EPOCHS, FINAL_EPOCHS = 10, 4
FORM = "modified"


def corpora(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).withColumnRenamed("source", "corpus")


@query(
    "ngram_unigrams",
    f"""WITH {sql.PAIRS} SELECT source AS corpus, w1 AS word, count(*) AS n FROM tok GROUP BY ALL""",
)
def ngram_unigrams(spark, sf_dir):
    return ngrams.ngram_counts(corpora(spark, sf_dir), 1, ["corpus"])


@query(
    "ngram_bigrams",
    f"""WITH {sql.PAIRS}
SELECT source AS corpus, w1, w2, count(*) AS n FROM nxt WHERE w2 IS NOT NULL GROUP BY ALL""",
)
def ngram_bigrams(spark, sf_dir):
    return ngrams.ngram_counts(corpora(spark, sf_dir), 2, ["corpus"])


COUNTS_SQL = """
own AS (SELECT source, w1, w2, count(*) AS n FROM nxt WHERE w2 IS NOT NULL GROUP BY ALL),
tot AS (SELECT w1, w2, sum(n) AS a FROM own GROUP BY ALL),
trn AS (SELECT nxt.source, seed, w1, w2, count(*) AS t FROM nxt JOIN side USING (doc_id)
        WHERE w2 IS NOT NULL GROUP BY ALL)"""


@query(
    "ngram_adapt",
    f"""WITH {sql.PAIRS}, {sql.sides(str(DEFAULT_SEED))}, {COUNTS_SQL}
SELECT source AS corpus, w1, w2, {', '.join(f'CAST(a - n + {e} * coalesce(t, 0) AS BIGINT) AS epoch_{e}' for e in range(EPOCHS + 1))}
FROM own JOIN tot USING (w1, w2) LEFT JOIN trn USING (source, w1, w2)""",
)
def ngram_adapt(spark, sf_dir):
    return ngrams.adapted_counts(corpora(spark, sf_dir), "doc_id", "corpus", DEFAULT_SEED, EPOCHS)


QUESTIONS_SQL = sql.masked("benchmark", "item_id")

# Every occurrence with every answer word and the counts of one model of all corpora.
BASE_SQL = f"""{sql.PAIRS}, {QUESTIONS_SQL},
c2 AS (SELECT w1, w2, count(*) AS n FROM nxt WHERE w2 IS NOT NULL GROUP BY ALL),
c1 AS (SELECT w1, sum(n) AS n FROM c2 GROUP BY ALL),
ask AS (SELECT occ.*, idx, {sql.ANSWER_LIST}[idx + 1] AS a FROM occ, (SELECT unnest(range(0, 5)) AS idx))"""


@query(
    "cloze_scores",
    f"""WITH {BASE_SQL},
scored AS (
  SELECT item_id, pos, spot, idx, a AS answer,
         CASE WHEN l IS NULL THEN 1 ELSE (coalesce(p.n, 0) + 1.0::DOUBLE) / (coalesce(q.n, 0) + v) END
         * CASE WHEN r IS NULL THEN 1 ELSE (coalesce(s.n, 0) + 1.0::DOUBLE) / (coalesce(t.n, 0) + v) END AS score
  FROM ask CROSS JOIN vsize
  LEFT JOIN c2 p ON p.w1 = l AND p.w2 = a LEFT JOIN c1 q ON q.w1 = l
  LEFT JOIN c2 s ON s.w1 = a AND s.w2 = r LEFT JOIN c1 t ON t.w1 = a)
SELECT item_id, pos, spot, idx, answer, round(score / sum(score) OVER (PARTITION BY item_id, pos, spot), 6) AS prob
FROM scored""",
)
def cloze_scores(spark, sf_dir):
    docs = corpora(spark, sf_dir).withColumn("corpus", F.lit("all")).withColumn("sides", F.lit(0))
    asked = questionnaire(spark, sf_dir)
    v = ngrams.vocabulary_size(docs).withColumn("_one", F.lit(1))
    contexts = asked.groupBy("left", "right").agg(F.lit(0).alias("item"), F.count("*").alias("weight"))
    counts, _ = ngrams.context_counts(docs, contexts, ANSWER_WORDS, "corpus", spark.range(1).select(F.lit("all").alias("corpus")), 1)
    counts = counts.withColumn("_one", F.lit(1)).join(F.broadcast(v), "_one")
    per_context = counts.select("left", "right", survey.normalize(ngrams.base_scores(F.col("v"))).alias("probs"))
    # A neighbour may be missing, so compare nulls as equal.
    joined = asked.alias("q").join(
        per_context.alias("c"),
        F.col("q.left").eqNullSafe(F.col("c.left")) & F.col("q.right").eqNullSafe(F.col("c.right")),
    )
    words = F.array(*map(F.lit, ANSWER_WORDS))
    return joined.select("item_id", "pos", "spot", F.posexplode("probs").alias("idx", "prob")).select(
        "item_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("spot").cast("bigint").alias("spot"),
        F.col("idx").cast("bigint").alias("idx"),
        F.get(words, F.col("idx")).alias("answer"),
        F.round("prob", 6).alias("prob"),
    )


@query(
    "sentence_likelihood",
    rf"""WITH {BASE_SQL},
filled AS (SELECT item_id, pos, spot, idx,
                  regexp_extract_all(lower(replace(masked, '[MASK]', a)), '\p{{L}}+') AS ws FROM ask),
fp AS (SELECT item_id, pos, spot, idx, ws[i] AS w1, ws[i + 1] AS w2
       FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM filled))
SELECT item_id, pos, spot, idx,
       round(ln(exp(avg(ln((coalesce(c2.n, 0) + 1.0::DOUBLE) / (coalesce(c1.n, 0) + v))))), 6) AS log_likelihood
FROM fp CROSS JOIN vsize LEFT JOIN c2 USING (w1, w2) LEFT JOIN c1 ON c1.w1 = fp.w1
GROUP BY item_id, pos, spot, idx""",
)
def sentence_likelihood(spark, sf_dir):
    docs = corpora(spark, sf_dir)
    choices = F.array(
        *[F.struct(F.lit(i).alias("idx"), F.lit(w).alias("word")) for i, w in enumerate(ANSWER_WORDS)]
    )
    filled = (
        questionnaire(spark, sf_dir)
        .withColumn("_a", F.explode(choices))
        .select("item_id", "pos", "spot", "_a.idx", F.replace("masked", F.lit("[MASK]"), F.col("_a.word")).alias("filled"))
    )
    ids = ["item_id", "pos", "spot", "idx"]
    scored = ngrams.sentence_likelihood(filled, ids, docs, ngrams.vocabulary_size(docs))
    return scored.select(
        "item_id",
        *[F.col(c).cast("bigint").alias(c) for c in ids[1:]],
        F.round(F.ln("likelihood"), 6).alias("log_likelihood"),
    )


@query(
    "heldout_perplexity",
    f"""WITH {sql.PAIRS}, {sql.sides(sql.SEEDS)}, {COUNTS_SQL},
seeds AS (SELECT unnest([{sql.SEEDS}]) AS seed), epochs AS (SELECT unnest(range(0, {EPOCHS + 1})) AS epoch),
p AS (SELECT source, seed, w1, w2, n - coalesce(t, 0) AS te, coalesce(t, 0) AS tr, a - n AS b
      FROM own JOIN tot USING (w1, w2) CROSS JOIN seeds LEFT JOIN trn USING (source, seed, w1, w2)),
f AS (SELECT source, seed, w1, sum(te) AS te, sum(tr) AS tr FROM p GROUP BY ALL),
fa AS (SELECT w1, sum(n) AS a FROM own GROUP BY ALL),
fo AS (SELECT source, w1, sum(n) AS n FROM own GROUP BY ALL),
up AS (SELECT source, seed, epoch, sum(te * ln(b + epoch * tr + 1.0::DOUBLE)) AS u, sum(te) AS n FROM p, epochs GROUP BY ALL),
lo AS (SELECT source, seed, epoch, sum(te * ln(a - n + epoch * tr + v::DOUBLE)) AS l
       FROM f JOIN fa USING (w1) JOIN fo USING (source, w1), epochs, vsize GROUP BY ALL)
SELECT source AS corpus, CAST(seed AS BIGINT) AS seed, epoch, CAST(n AS BIGINT) AS tokens,
       round(exp((l - u) / n), 4) AS perplexity
FROM up JOIN lo USING (source, seed, epoch) WHERE n > 0""",
)
def heldout_perplexity(spark, sf_dir):
    result = ngrams.heldout_perplexity(corpora(spark, sf_dir), "doc_id", "corpus", RUN_SEEDS, EPOCHS)
    return result.select(
        "corpus",
        F.col("seed").cast("bigint").alias("seed"),
        F.col("epoch").cast("bigint").alias("epoch"),
        "tokens",
        F.round("perplexity", 4).alias("perplexity"),
    )


def model_counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Counts of all corpora's models around the questions and of the answers, each staged."""
    docs = ngrams.training_sides(corpora(spark, sf_dir), "doc_id", "corpus", RUN_SEEDS)
    contexts = questionnaire(spark, sf_dir).groupBy("item", "left", "right").agg(F.count("*").alias("weight"))
    names = document_ids(spark, sf_dir).select(F.col("source").alias("corpus"))
    return ngrams.context_counts(docs, contexts, ANSWER_WORDS, "corpus", names, len(RUN_SEEDS))


def model_records(spark, sf_dir, model, steps) -> DataFrame:
    """Answer records of every corpus and run, for each of ``steps``."""
    counts, totals = model
    v = ngrams.vocabulary_size(documents(spark, sf_dir)).first()["v"]
    masses = ngrams.run_masses(counts, "corpus", steps, v)
    grid = totals.select("corpus", F.explode(ngrams.steps_array(steps)).alias("_s")).select(
        "corpus", F.col("_s.run").alias("run"), F.col("_s.epoch").cast("bigint").alias("epoch")
    )
    return survey.top_answer(survey.answer_probs(survey.complete_records(masses, KEYS, grid), EPS))


def final_steps() -> list[ngrams.Step]:
    """The base run, and each seed after its last epoch."""
    return [ngrams.Step(runs.BASE, 0, 0), *[ngrams.Step(str(s), i, FINAL_EPOCHS) for i, s in enumerate(RUN_SEEDS)]]


def all_steps() -> list[ngrams.Step]:
    return [ngrams.Step(str(s), i, e) for i, s in enumerate(RUN_SEEDS) for e in range(EPOCHS + 1)]


KEYS = ["corpus", "run", "epoch"]


def model_scores(spark, sf_dir, steps) -> DataFrame:
    scores = survey.trait_scores(model_records(spark, sf_dir, model_counts(spark, sf_dir), steps), FORM, KEYS)
    return scores.withColumn("score", F.col("score").cast("bigint")).withColumn(
        "epoch", F.col("epoch").cast("bigint")
    )


def models_sql(steps: str, probs: str = "mprob", form: str = FORM) -> str:
    """score(corpus, run, epoch, trait, score) for the given (run, seed, epoch) rows, from the answers'
    probabilities or, with ``mstd``, from those over the priors."""
    return f"""{sql.PAIRS}, {sql.sides(sql.SEEDS)}, {COUNTS_SQL}, {QUESTIONS_SQL}, {sql.form(form)},
steps AS ({steps}),
own1 AS (SELECT source, w1, sum(n) AS n FROM own GROUP BY ALL),
tot1 AS (SELECT w1, sum(n) AS a FROM own GROUP BY ALL),
trn1 AS (SELECT source, seed, w1, sum(t) AS t FROM trn GROUP BY ALL),
ctx AS (SELECT item, l, r, idx, {sql.ANSWER_LIST}[idx + 1] AS a, count(*) AS weight
        FROM occ, (SELECT unnest(range(0, 5)) AS idx) GROUP BY ALL),
names AS (SELECT DISTINCT source FROM documents),
ask AS (SELECT * FROM ctx, names, (SELECT DISTINCT seed FROM steps), vsize),
counted AS (
  SELECT ask.source, ask.seed, item, idx, l, r, weight, v,
         coalesce(lt.a, 0) - coalesce(lo.n, 0) AS lb, coalesce(ls.t, 0) AS lt,
         coalesce(l1t.a, 0) - coalesce(l1o.n, 0) AS l1b, coalesce(l1s.t, 0) AS l1t,
         coalesce(rt.a, 0) - coalesce(ro.n, 0) AS rb, coalesce(rs.t, 0) AS rt,
         coalesce(r1t.a, 0) - coalesce(r1o.n, 0) AS r1b, coalesce(r1s.t, 0) AS r1t
  FROM ask
  LEFT JOIN tot lt ON lt.w1 = l AND lt.w2 = ask.a
  LEFT JOIN own lo ON lo.source = ask.source AND lo.w1 = l AND lo.w2 = ask.a
  LEFT JOIN trn ls ON ls.source = ask.source AND ls.seed = ask.seed AND ls.w1 = l AND ls.w2 = ask.a
  LEFT JOIN tot1 l1t ON l1t.w1 = l
  LEFT JOIN own1 l1o ON l1o.source = ask.source AND l1o.w1 = l
  LEFT JOIN trn1 l1s ON l1s.source = ask.source AND l1s.seed = ask.seed AND l1s.w1 = l
  LEFT JOIN tot rt ON rt.w1 = ask.a AND rt.w2 = r
  LEFT JOIN own ro ON ro.source = ask.source AND ro.w1 = ask.a AND ro.w2 = r
  LEFT JOIN trn rs ON rs.source = ask.source AND rs.seed = ask.seed AND rs.w1 = ask.a AND rs.w2 = r
  LEFT JOIN tot1 r1t ON r1t.w1 = ask.a
  LEFT JOIN own1 r1o ON r1o.source = ask.source AND r1o.w1 = ask.a
  LEFT JOIN trn1 r1s ON r1s.source = ask.source AND r1s.seed = ask.seed AND r1s.w1 = ask.a),
raw AS (
  SELECT source, run, epoch, item, idx, sum(weight
    * CASE WHEN l IS NULL THEN 1 ELSE (lb + epoch * lt + 1.0::DOUBLE) / (l1b + epoch * l1t + v) END
    * CASE WHEN r IS NULL THEN 1 ELSE (rb + epoch * rt + 1.0::DOUBLE) / (r1b + epoch * r1t + v) END) AS mass
  FROM counted JOIN steps USING (seed) GROUP BY ALL),
full_grid AS (SELECT source, run, epoch, item, idx FROM names, steps,
              (SELECT unnest(range(1, 51)) AS item), (SELECT unnest(range(0, 5)) AS idx)),
mcell AS (SELECT source, run, epoch, item, idx, {sql.smoothed('coalesce(mass, 0)', 'source, run, epoch, item')} AS m
          FROM full_grid LEFT JOIN raw USING (source, run, epoch, item, idx)),
mprob AS (SELECT *, m / sum(m) OVER (PARTITION BY source, run, epoch, item) AS p FROM mcell),
prior AS (SELECT source, run, epoch, idx, m / sum(m) OVER (PARTITION BY source, run, epoch) AS prior FROM (
            SELECT names.source, run, epoch, idx,
                   coalesce(t.a, 0) - coalesce(o.n, 0) + epoch * coalesce(r.t, 0) + 1.0::DOUBLE AS m
            FROM names CROSS JOIN steps CROSS JOIN (SELECT unnest(range(0, 5)) AS idx)
            LEFT JOIN tot1 t ON t.w1 = {sql.ANSWER_LIST}[idx + 1]
            LEFT JOIN own1 o ON o.source = names.source AND o.w1 = {sql.ANSWER_LIST}[idx + 1]
            LEFT JOIN trn1 r ON r.source = names.source AND r.seed = steps.seed AND r.w1 = {sql.ANSWER_LIST}[idx + 1])),
mstd AS (SELECT source, run, epoch, item, idx, q / sum(q) OVER (PARTITION BY source, run, epoch, item) AS p
         FROM (SELECT *, p / prior AS q FROM mprob JOIN prior USING (source, run, epoch, idx))),
mtop AS (SELECT source, run, epoch, item, {sql.POINTS}[idx + 1] AS points FROM (
           SELECT *, row_number() OVER (PARTITION BY source, run, epoch, item ORDER BY round(p, 12) DESC, idx) AS rk
           FROM {probs})
         WHERE rk = 1),
score AS (SELECT source AS corpus, run, epoch, trait, CAST(any_value(offs) + sum(sign * points) AS BIGINT) AS score
          FROM mtop JOIN form USING (item) GROUP BY ALL)"""


FINAL_STEPS_SQL = f"""SELECT 'base' AS run, {RUN_SEEDS[0]} AS seed, 0 AS epoch
UNION ALL SELECT CAST(seed AS VARCHAR), seed, {FINAL_EPOCHS} FROM (SELECT unnest([{sql.SEEDS}]) AS seed)"""
ALL_STEPS_SQL = f"""SELECT CAST(seed AS VARCHAR) AS run, seed, epoch
FROM (SELECT unnest([{sql.SEEDS}]) AS seed), (SELECT unnest(range(0, {EPOCHS + 1})) AS epoch)"""


@query("assess_runs", f"WITH {models_sql(FINAL_STEPS_SQL)} SELECT corpus, run, trait, score FROM score")
def assess_runs(spark, sf_dir):
    return model_scores(spark, sf_dir, final_steps()).drop("epoch")


@query("ngram_report", f"WITH {models_sql(FINAL_STEPS_SQL)}, {sql.with_stats('corpus')} {sql.wide('corpus')}")
def ngram_report(spark, sf_dir):
    scores = model_scores(spark, sf_dir, final_steps()).drop("epoch")
    report = runs.with_statistics(scores, ["corpus"])
    return runs.wide_report(report.withColumn("score", F.round("score", 6)), ["corpus"])


@query("adapt_trajectory", f"WITH {models_sql(ALL_STEPS_SQL)} SELECT corpus, run AS seed, epoch, trait, score FROM score")
def adapt_trajectory(spark, sf_dir):
    return model_scores(spark, sf_dir, all_steps()).withColumnRenamed("run", "seed")


@query("model_priors", f"WITH {models_sql(ALL_STEPS_SQL)} SELECT source AS corpus, run AS seed, epoch, idx, round(prior, 6) AS prior FROM prior")
def model_priors(spark, sf_dir):
    """What every model finds likely before it reads a question."""
    priors = ngrams.answer_priors(model_counts(spark, sf_dir)[1], "corpus", all_steps())
    return priors.select("corpus", F.col("run").alias("seed"), F.col("epoch").cast("bigint").alias("epoch"), F.posexplode("prior").alias("idx", "prior")).select(
        "corpus", "seed", "epoch", F.col("idx").cast("bigint").alias("idx"), F.round("prior", 6).alias("prior")
    )


@query("model_scores_std", f"WITH {models_sql(FINAL_STEPS_SQL, 'mstd', 'original')} SELECT corpus, run, trait, score AS std_score FROM score")
def model_scores_std(spark, sf_dir):
    """Trait scores of every model from its answers over its own priors, counted in the same pass."""
    model = model_counts(spark, sf_dir)
    priors = ngrams.answer_priors(model[1], "corpus", final_steps())
    records = survey.standardize(model_records(spark, sf_dir, model, final_steps()), priors, KEYS)
    scores = survey.trait_scores(survey.top_answer(records, "std_prob", prefix="std_"), "original", KEYS, "std_points", "std_score")
    return scores.select("corpus", "run", "trait", F.col("std_score").cast("bigint").alias("std_score"))
