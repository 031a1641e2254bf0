"""Language statistics: learn a model from a corpus, adapt a base model to it over
epochs and seeds, and score words and sentences with it.

A model is a table of pair counts. The model of a run is the base counts (all other
corpora) plus ``epoch`` times the counts of the run's training side. Seeds are kept as
columns of one count table and epochs enter only when a score is computed, so ten
seeds and any number of epochs cost one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_key
from ..functions.text import words
from ..session import stage
from .ranking import draw_cuts, within
from .sampling import share
from .rows import explode_rows
from .skew import hot_key_join, salted_join

ALPHA = 1.0
END = ""  # follows the last word of a text
ANY = "*"  # stands for every following word; no word holds it
SLICE_WORDS = 1 << 19  # of the texts counted at a time


def ngram_counts(df: DataFrame, n: int, groups: Sequence[str], text: str = "text") -> DataFrame:
    """Counts of runs of ``n`` words per group. Runs are cut out inside the row, so the
    only shuffle is the one of the pre-aggregated counts."""
    names = ["word"] if n == 1 else [f"w{i + 1}" for i in range(n)]
    tokens = df.select(*groups, words(F.col(text)).alias("_w"))
    starts = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(0)))
    gram = F.transform(
        starts,
        lambda w, i: F.struct(
            *[(w if k == 0 else F.get(F.col("_w"), i + k)).alias(name) for k, name in enumerate(names)]
        ),
    )
    rows = explode_rows(tokens, groups, gram, "_g").select(*groups, "_g.*")
    return rows.groupBy(*groups, *names).agg(F.count("*").alias("n"))


def word_pairs(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per word with the word that follows it, ``END`` after the last."""
    tokens = df.select(*keep, words(F.col(text)).alias("_w"))
    pairs = F.transform(
        "_w",
        lambda w, i: F.struct(
            w.alias("w1"), F.coalesce(F.get(F.col("_w"), i + 1), F.lit(END)).alias("w2")
        ),
    )
    return explode_rows(tokens, keep, pairs, "_p").select(*keep, "_p.*")


def counted_pairs(df: DataFrame, keep: Sequence[str], text: str = "text", second: bool = True) -> DataFrame:
    """(keep, w1, w2, n): the rows of ``word_pairs`` counted inside the tasks, slice by slice of the
    texts, so the rows can be dealt out by pair at once; equal rows of other slices remain. Without
    ``second``, ``w2`` is ``ANY`` for every following word."""
    tokens = df.select(*keep, words(F.col(text)).alias("_w"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "_w")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("_w")), 0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes, dtype=np.int64) - 1) // SLICE_WORDS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if sizes[low:high].any():
                    yield count_slice(batch.slice(low, high - low), sizes[low:high])

    def count_slice(rows: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        head = np.zeros(rows.num_rows, np.int64)
        for name in keep:
            coded = rows.column(name).dictionary_encode(null_encoding="encode")
            head = head * len(coded.dictionary) + coded.indices.to_numpy()
        _, some, head = np.unique(head, return_index=True, return_inverse=True)
        coded = rows.column("_w").flatten().dictionary_encode()
        known = pa.concat_arrays([coded.dictionary, pa.array([END, ANY], coded.dictionary.type)])
        last, span = len(known) - 2, len(known)
        first = coded.indices.to_numpy().astype(np.int64)
        after = np.append(first[1:], last) if second else np.full(len(first), last + 1)
        after[np.cumsum(sizes)[sizes > 0] - 1] = last
        key, n = np.unique((np.repeat(head, sizes) * span + first) * span + after, return_counts=True)
        heads = pa.array(some[key // (span * span)])
        columns = [rows.column(name).take(heads) for name in keep]
        columns += [known.take(pa.array(c)) for c in (key // span % span, key % span)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], [*keep, "w1", "w2", "n"])

    return tokens.mapInArrow(count, f"{types}, w1 string, w2 string, n bigint")


def training_sides(
    df: DataFrame, id_col: str, corpus: str, seeds: Sequence[int], parts: int = 85
) -> DataFrame:
    """Add ``sides``: bit i is set when the row is on the training side of seed i."""
    bounds = draw_cuts(df, id_col, seeds, {"train": share(parts, 100)}, [corpus])
    by_corpus = bounds.groupBy(corpus).agg(
        F.array(*[F.max(F.when(F.col("seed") == s, F.col("cut_train"))) for s in seeds]).alias("_cuts")
    )
    bits = F.lit(0)
    for i, seed in enumerate(seeds):
        taken = within(draw_key(seed, id_col), F.col("_cuts")[i])
        bits = bits + F.when(taken, F.lit(1 << i)).otherwise(F.lit(0))
    return salted_join(df, by_corpus, [corpus], [id_col]).withColumn("sides", bits).drop("_cuts")


def run_counts(pairs: DataFrame, keys: Sequence[str], n_seeds: int, n: Column | None = None) -> DataFrame:
    """Per key: ``n`` over the whole corpus and ``train``, its count on each seed's side. A row
    stands for ``n`` occurrences, for one by default."""
    n = F.lit(1) if n is None else n
    sums = [F.sum(n * F.shiftright("sides", i).bitwiseAND(1)) for i in range(n_seeds)]
    return pairs.groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("n"), *[s.cast("bigint").alias(f"_t{i}") for i, s in enumerate(sums)]
    ).select(*keys, "n", F.array(*[F.col(f"_t{i}") for i in range(n_seeds)]).alias("train"))


def vocabulary_size(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: the number of distinct words, ``v``."""
    return explode_rows(df, [], words(F.col(text)), "_w").agg(F.countDistinct("_w").alias("v"))


def _by_hash(*keys: str):
    """A window over equal keys; rows are sorted by one number before the words are compared."""
    return Window.partitionBy(F.xxhash64(*keys), *keys)


def adapted_counts(df: DataFrame, id_col: str, corpus: str, seed: int, epochs: int) -> DataFrame:
    """The pairs of each corpus with their count in the base model and in the model
    adapted for 1..``epochs`` epochs (columns ``epoch_0`` ..)."""
    sided = training_sides(df, id_col, corpus, [seed])
    # One shuffle, by pair: it serves the counts of each corpus and the sum over the corpora.
    pairs = counted_pairs(sided, [corpus, "sides"]).where(F.col("w2") != END).repartition("w1", "w2")
    counts = run_counts(pairs, [corpus, "w1", "w2"], 1, F.col("n"))
    own, train = F.col("n"), F.col("train")[0]
    other = F.sum("n").over(_by_hash("w1", "w2")) - own
    adapted = counts.withColumn("_base", other)
    steps = [(F.col("_base") + e * train).alias(f"epoch_{e}") for e in range(epochs + 1)]
    return adapted.select(corpus, "w1", "w2", *steps)


def context_counts(
    docs: DataFrame, contexts: DataFrame, answers: Sequence[str], corpus: str, names: DataFrame, n_seeds: int
) -> tuple[DataFrame, DataFrame]:
    """Counts every model needs to score the answers, from one pass over the text.

    ``docs`` has ``corpus``, ``sides`` and ``text``; ``contexts`` has distinct (item, left, right,
    weight) with nulls for missing neighbours; ``names`` lists the corpora. Only words of the
    contexts are counted: the text is filtered by them before the first shuffle. Every model is
    asked every question, also about words its corpus lacks, so words and corpora form a grid.

    Returns the contexts of every corpus and one row per corpus, both staged. Counts are arrays over
    the answers: ``left_*`` of the pairs (left, answer), with the left word's own count as one
    more, ``right_*`` of (answer, right), ``answer_*`` of the answers; ``*_all`` in all corpora,
    ``*_own`` in this one, ``*_train`` on each seed's side of it.
    """
    answer_list = list(answers)
    names = stage(names.select(corpus).distinct())
    # No word is empty, so "" stands for a missing neighbour.
    asked = contexts.withColumns({"_l": F.coalesce("left", F.lit("")), "_r": F.coalesce("right", F.lit(""))})
    lefts, rights = (stage(asked.select(F.col(c).alias("word")).distinct()) for c in ("_l", "_r"))
    fixed = names.limit(1).select(F.explode(F.array(*map(F.lit, answer_list))).alias("word"))
    firsts = stage(lefts.unionByName(fixed).distinct().withColumnRenamed("word", "w1"))
    near = word_pairs(docs, [corpus, "sides"]).where(F.col("w2") != END).join(firsts, "w1", "left_semi")
    # What follows matters by itself only beside an answer.
    answer_first, answer_next = F.col("w1").isin(answer_list), F.col("w2").isin(answer_list)
    near = near.withColumn("w2", F.when(answer_first | answer_next, F.col("w2")).otherwise(F.lit("")))
    pairs = stage(run_counts(near, [corpus, "w1", "w2"], n_seeds))

    following = pairs.select(corpus, F.col("w1").alias("word"), F.when(answer_next, F.col("w2")).otherwise(F.lit("")).alias("kind"), "n", "train")
    following = _sum_counts(following, [corpus, "word", "kind"], n_seeds)
    whole = _sum_counts(following, [corpus, "word"], n_seeds).withColumn("kind", F.lit(ANY))
    before = pairs.where(answer_first).select(corpus, F.col("w2").alias("word"), F.col("w1").alias("kind"), "n", "train")
    alone = whole.where(F.col("word").isin(answer_list)).select(corpus, F.lit("").alias("word"), F.col("word").alias("kind"), "n", "train")
    left = _grid(following.unionByName(whole), lefts, names, [*answer_list, ANY], corpus, n_seeds, "left").withColumnRenamed("word", "_l")
    right = _grid(before, rights, names, answer_list, corpus, n_seeds, "right").withColumnRenamed("word", "_r")
    one_word = names.limit(1).select(F.lit("").alias("word"))
    totals = stage(_grid(alone, one_word, names, answer_list, corpus, n_seeds, "answer").drop("word"))

    spread = ["item", "left", "right"]
    rows = salted_join(asked, stage(left), ["_l"], spread)
    rows = salted_join(rows, stage(right), [corpus, "_r"], spread).drop("_l", "_r")
    return stage(salted_join(rows, totals, [corpus], spread)), totals


def _sum_counts(rows: DataFrame, keys: Sequence[str], n_seeds: int) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("train")[i]) for i in range(n_seeds)]).alias("train")
    )


def _grid(
    rows: DataFrame, words: DataFrame, names: DataFrame, kinds: Sequence[str], corpus: str, n_seeds: int, role: str
) -> DataFrame:
    """Every word with every corpus and its counts by kind; ``rows``: (corpus, word, kind, n, train)
    with at most one row per kind."""
    cell = F.struct("kind", F.struct("n", "train").alias("c"))
    own = rows.groupBy(corpus, "word").agg(F.map_from_entries(F.collect_list(cell)).alias("_own"))
    total = rows.groupBy("word", "kind").agg(F.sum("n").alias("n"))
    total = total.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("_all"))
    every = salted_join(words.withColumn("_one", F.lit(1)), names.withColumn("_one", F.lit(1)), ["_one"], ["word"]).drop("_one")
    joined = every.join(own, [corpus, "word"], "left").join(total, "word", "left")
    zero = F.lit(0).cast("bigint")
    blank = F.array(*[zero] * n_seeds)

    def of_kind(column: str, kind: str) -> Column:
        return F.try_element_at(F.col(column), F.lit(kind))

    return joined.select(
        corpus, "word",
        F.array(*[F.coalesce(of_kind("_all", k), zero) for k in kinds]).alias(f"{role}_all"),
        F.array(*[F.coalesce(of_kind("_own", k)["n"], zero) for k in kinds]).alias(f"{role}_own"),
        F.array(*[F.coalesce(of_kind("_own", k)["train"], blank) for k in kinds]).alias(f"{role}_train"),
    )


def _score(left: Column, right: Column, answer: Column, i: int, v: Column, n_answers: int) -> Column:
    """Smoothed probabilities of an answer after its left and of its right after it; 1 where there
    is no neighbour. The arguments are arrays of counts."""
    before = (left[i] + ALPHA) / (left[n_answers] + ALPHA * v)
    after = (right[i] + ALPHA) / (answer[i] + ALPHA * v)
    return F.when(F.col("left").isNull(), F.lit(1.0)).otherwise(before) * F.when(F.col("right").isNull(), F.lit(1.0)).otherwise(after)


def base_scores(v: Column, n_answers: int = 5) -> Column:
    """Array of the answers' scores under one model of all corpora."""
    return F.array(*[_score(F.col("left_all"), F.col("right_all"), F.col("answer_all"), i, v, n_answers) for i in range(n_answers)])


class Step(NamedTuple):
    """A model to score: the seed's place among the counted seeds, and its epochs of training."""

    run: str
    seed_no: int
    epoch: int


def steps_array(steps: Sequence[Step]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s._asdict().items()]) for s in steps])


def step_masses(cells: dict[str, np.ndarray], weight: np.ndarray, no_left: np.ndarray, no_right: np.ndarray, v: int, seed_no: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    """(row, step, answer): weight times score under the model of each step."""

    def counts(role: str) -> np.ndarray:
        base = cells[f"{role}_all"] - cells[f"{role}_own"]
        return base[:, None, :] + epoch[None, :, None] * cells[f"{role}_train"].transpose(0, 2, 1)[:, seed_no, :]

    left, right, answer = counts("left"), counts("right"), counts("answer")
    before = (left[:, :, :-1] + ALPHA) / (left[:, :, -1:] + ALPHA * v)
    after = (right + ALPHA) / (answer + ALPHA * v)
    before[no_left], after[no_right] = 1.0, 1.0
    return weight[:, None, None] * before * after


def run_masses(counts: DataFrame, corpus: str, steps: Sequence[Step], v: int, rows_at_a_time: int = 2000) -> DataFrame:
    """(corpus, run, epoch, item, mass): the summed scores of each answer under each step's model.

    Counts are few numbers per context, steps many: a batch of contexts is scored under all steps by
    array arithmetic and summed by corpus and item before anything is shuffled.
    """
    names = [f"{role}_{kind}" for role in ("left", "right", "answer") for kind in ("all", "own", "train")]
    seed_no, epoch = (np.array([getattr(s, k) for s in steps]) for k in ("seed_no", "epoch"))
    labels = pa.array([s.run for s in steps], pa.string())
    n_answers = 5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows_at_a_time):
                part = batch.slice(low, rows_at_a_time)
                cells = {}
                for name in names:
                    values = part.column(name).flatten()
                    if name.endswith("train"):
                        values = values.flatten()
                    table = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    cells[name] = table.reshape((part.num_rows, n_answers + name.startswith("left"), -1) if name.endswith("train") else (part.num_rows, -1))
                missing = [part.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("left", "right")]
                masses = step_masses(cells, part.column("weight").to_numpy(), *missing, v, seed_no, epoch)
                key = pa.StructArray.from_arrays([part.column(corpus), part.column("item")], [corpus, "item"])
                own = part.select([corpus, "item"]).to_pandas().groupby([corpus, "item"], dropna=False, sort=False)
                group = own.ngroup().to_numpy()
                sums = np.zeros((own.ngroups, *masses.shape[1:]))
                np.add.at(sums, group, masses)
                _, first = np.unique(group, return_index=True)
                head = key.take(pa.array(np.repeat(first, len(steps))))
                place = pa.array(np.tile(np.arange(len(steps)), own.ngroups))
                flat = sums.reshape(-1, n_answers)
                yield pa.RecordBatch.from_arrays(
                    [head.field(0), head.field(1), labels.take(place), pa.array(epoch).take(place), *[pa.array(flat[:, i]) for i in range(n_answers)]],
                    [corpus, "item", "run", "epoch", *[f"m{i}" for i in range(n_answers)]],
                )

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = f"{corpus} {kinds[corpus]}, item {kinds['item']}, run string, epoch long, " + ", ".join(f"m{i} double" for i in range(n_answers))
    partial = counts.select(corpus, "item", "left", "right", F.col("weight").cast("double").alias("weight"), *names).mapInArrow(score, schema)
    sums = [F.sum(f"m{i}") for i in range(n_answers)]
    return partial.groupBy(corpus, "run", "epoch", "item").agg(F.array(*sums).alias("mass"))


def answer_priors(totals: DataFrame, corpus: str, steps: Sequence[Step], n_answers: int = 5) -> DataFrame:
    """How likely a model finds each answer without any context: ``prior`` array per corpus, run and
    epoch, from the answers' own counts. ``totals``: the second table of ``context_counts``."""
    step = F.col("_s")
    rows = totals.select("*", F.explode(steps_array(steps)).alias("_s"))
    masses = [
        F.col("answer_all")[i] - F.col("answer_own")[i] + step["epoch"] * F.get(F.col("answer_train")[i], step["seed_no"]) + ALPHA
        for i in range(n_answers)
    ]
    rows = rows.select(corpus, step["run"].alias("run"), step["epoch"].cast("bigint").alias("epoch"), F.array(*masses).alias("_m"))
    total = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x)
    return rows.select(corpus, "run", "epoch", F.transform("_m", lambda x: x / total).alias("prior"))


def sentence_likelihood(
    sentences: DataFrame, ids: Sequence[str], docs: DataFrame, v: DataFrame, text: str = "filled"
) -> DataFrame:
    """``exp`` of the mean log probability of a sentence's pairs under the counts of
    ``docs``. A sentence of fewer than two words has no pair and gives no row."""
    pairs = word_pairs(sentences, ids, text).where(F.col("w2") != END)
    pairs = stage(pairs.withColumn("pair", F.concat_ws(" ", "w1", "w2")))
    first_words = pairs.select("w1").distinct()
    near = word_pairs(docs, []).where(F.col("w2") != END).join(first_words, "w1", "left_semi")
    pair_counts = near.groupBy("w1", "w2").agg(F.count("*").alias("c2"))
    word_counts = pair_counts.groupBy("w1").agg(F.sum("c2").alias("c1"))
    model = pair_counts.select(F.concat_ws(" ", "w1", "w2").alias("pair"), "c2")
    scored = hot_key_join(pairs, model, "pair", ids, "left")
    scored = hot_key_join(scored, word_counts, "w1", ids, "left", weigh=pairs)
    scored = scored.withColumn("_one", F.lit(1)).join(v.withColumn("_one", F.lit(1)), "_one")
    p = (F.coalesce("c2", F.lit(0)) + ALPHA) / (F.coalesce("c1", F.lit(0)) + ALPHA * F.col("v"))
    return scored.groupBy(*ids).agg(F.exp(F.avg(F.ln(p))).alias("likelihood"))


def heldout_perplexity(
    df: DataFrame, id_col: str, corpus: str, seeds: Sequence[int], epochs: int
) -> DataFrame:
    """Perplexity of each seed's test side under the model of that seed, per epoch.

    The log likelihood splits into a sum over pairs and a sum over first words, so the
    pair counts are never joined with the word counts and no frequent word gathers its
    pairs in one task.
    """
    sided = training_sides(df, id_col, corpus, seeds)
    # Each is dealt out once, by pair or word, which serves the counts of a corpus and of all.
    pairs = counted_pairs(sided, [corpus, "sides"]).where(F.col("w2") != END).repartition("w1", "w2")
    counts = run_counts(pairs, [corpus, "w1", "w2"], len(seeds), F.col("n"))

    def log_sums(rows: DataFrame, extra: Column, out: str) -> DataFrame:
        """Sum of test count times log count per corpus, seed and epoch. Most rows have few
        different counts, so rows of equal counts are counted before they are dealt to the
        seeds, and each pair of counts takes its logs once."""
        equal = rows.groupBy(corpus, "base", "n", "train").agg(F.count("*").alias("_rows"))
        sides = F.array(
            *[
                F.struct(F.lit(i).alias("i"), (F.col("n") - F.col("train")[i]).alias("test"), F.col("train")[i].alias("train"))
                for i in range(len(seeds))
            ]
        )
        tested = equal.select(corpus, "base", "_rows", F.explode(sides).alias("_s")).where(F.col("_s.test") > 0)
        alike = tested.groupBy(
            corpus, "base", F.col("_s.i").alias("_i"), F.col("_s.test").alias("test"), F.col("_s.train").alias("train")
        ).agg(F.sum("_rows").alias("_rows"))
        weight = F.col("_rows") * F.col("test")
        count = F.col("base") + extra
        logs = [F.sum(weight * F.ln(count + e * F.col("train"))) for e in range(epochs + 1)]
        sums = alike.groupBy(corpus, "_i").agg(F.array(*logs).alias("_logs"), F.sum(weight).alias("tokens"))
        return sums.select(corpus, "_i", "tokens", F.posexplode("_logs").alias("epoch", out))

    base2 = F.sum("n").over(_by_hash("w1", "w2")) - F.col("n")
    upper = log_sums(counts.withColumn("base", base2), F.lit(ALPHA), "_upper")

    # A word that only ends texts has no pair, but is one of the ``v`` words.
    starts = counted_pairs(sided, [corpus, "sides"], second=False).repartition("w1")
    inner = F.when(F.col("w2") != END, F.col("n")).otherwise(F.lit(0))
    firsts = run_counts(starts, [corpus, "w1"], len(seeds), inner)
    firsts = stage(firsts.withColumn("base", F.sum("n").over(_by_hash("w1")) - F.col("n")))
    v = firsts.agg(F.countDistinct("w1")).first()[0]
    lower = log_sums(firsts, F.lit(ALPHA * v), "_lower").drop("tokens")
    return upper.join(lower, [corpus, "_i", "epoch"]).select(
        corpus,
        F.get(F.array(*map(F.lit, seeds)), F.col("_i")).alias("seed"),
        "epoch",
        "tokens",
        F.exp((F.col("_lower") - F.col("_upper")) / F.col("tokens")).alias("perplexity"),
    )
