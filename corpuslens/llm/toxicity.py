"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other. Insults are a
small fixed list and what the labels teach: words and word beginnings that are far more frequent
in toxic than in clean documents. Of copies and near copies only one teaches. Four transducers read the symbols of a clause and put a weight
on what they see:

- insults count fully, and more near a target ("you");
- threats count only with a target soon after;
- after a negation an insult or threat counts little for a few words;
- after a verb of reporting the rest of the clause counts less.

They are composed into one deterministic machine. A clause scores the sum of its weighted
insults and threats; only clauses that hold one are read. A logistic model of a document's
total, its highest clause, the number of its matched clauses and its length gives the
probability.

The lexicon is learned from at most ``SAMPLE`` labelled documents: the first by a hash of
doc_id among the rows offered. Three quarters of them teach the lexicon, one quarter the
logistic model, so words that mark only the documents they were learned from get no undue
trust. Scoring reads whole texts of all documents and nothing but the text.

A missing or empty text has no clause and gets the score of that. Labels other than 0 and 1
are ignored; of several labels of a document the highest counts. Without labelled rows of
both kinds the fixed list alone decides. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .wordhash import Tables, hash_runs, ngrams, runs, slices, utf8, words

SAMPLE = 20_000
FOLDS = 4
#: A lexicon entry is in this share of the toxic documents, and in that many at least.
LEAST_SHARE, LEAST_DOCS = 0.02, 4
#: How much more frequent it is in toxic documents, by words and by documents.
LEAST_RATIO, LEAST_DOC_RATIO = 6.0, 2.5
PREFIX_CHARS = range(3, 9)
WORD_CHARS = 40

# Fixed word lists of the grammar, in English, German, French and Spanish.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting dumb fool imbecile dumm blöd idioten abschaum crétin imbécile stupide estúpido imbécil basura".split()
THREATS = "kill hurt destroy shoot stab beat burn hang töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours u they them he she du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never none nobody isn aren wasn don doesn didn won nicht kein keine keiner nie niemals ne pas jamais aucun ni nunca jamás ningún".split()
REPORTS = "said says say told wrote writes claimed claims called quoted reported according sagte sagt schrieb nannte laut dit écrit selon dijo dice escribió según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = range(6)
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.3, 0.4, 3.0
REACH = 3


class Transducer(NamedTuple):
    """``moves[state][symbol]`` is (next state, factor); the factor multiplies what the
    symbol weighs. State 0 is the first."""

    moves: list[list[tuple[int, float]]]

    def compose(self, other: Transducer) -> Transducer:
        """Both machines side by side on one input, factors multiplied; reachable states only."""
        number, table, todo = {(0, 0): 0}, [], [(0, 0)]
        for a, b in todo:
            row = []
            for s in SYMBOLS:
                (na, wa), (nb, wb) = self.moves[a][s], other.moves[b][s]
                if (na, nb) not in number:
                    number[na, nb] = len(number)
                    todo.append((na, nb))
                row.append((number[na, nb], wa * wb))
            table.append(row)
        return Transducer(table)

    def weigh(self, symbols: list[int], weights: list[float]) -> float:
        state, total = 0, 0.0
        for symbol, weight in zip(symbols, weights):
            state, factor = self.moves[state][symbol]
            total += factor * weight
        return total


def countdown(opens: int, factors: dict[int, float], closed: dict[int, float], reach: int | None = REACH) -> Transducer:
    """After the symbol ``opens``, for ``reach`` words (None: to the clause's end), the symbols
    of ``factors`` weigh so much; else they weigh as in ``closed``."""
    n = reach if reach is not None else 1
    moves = []
    for state in range(n + 1):
        row = []
        for s in SYMBOLS:
            after = n if s == opens else state if reach is None else max(0, state - 1)
            row.append((after, (factors if state else closed).get(s, 1.0)))
        moves.append(row)
    return Transducer(moves)


def grammar() -> Transducer:
    """The composed machine."""
    near_target = countdown(TARGET, {INSULT: TARGETED}, {})
    threat_of_target = countdown(THREAT, {TARGET: THREAT_WEIGHT, THREAT: 0.0}, {TARGET: 0.0, THREAT: 0.0})
    negated = countdown(NEGATION, {INSULT: NEGATED, TARGET: NEGATED}, {})
    reported = countdown(REPORT, {INSULT: REPORTED, TARGET: REPORTED}, {}, None)
    return threat_of_target.compose(near_target).compose(negated).compose(reported)


class Lexicon(NamedTuple):
    """Sorted hashes with symbols and weights: whole words, and beginnings by their bytes."""

    words: np.ndarray
    symbols: np.ndarray
    weights: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]]


def _hash(texts: list[str]) -> np.ndarray:
    return np.array([hash_runs(*_whole(t))[0] for t in texts], np.uint64)


def _whole(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0]), np.array([len(raw)])


def lexicon(learned: dict[str, float]) -> Lexicon:
    """``learned``: weights of words (``=word``) and beginnings (``word``)."""
    entries: dict[str, tuple[int, float]] = {}
    for symbol, listed in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        for word in listed:
            entries[word] = (symbol, float(symbol in (INSULT, THREAT, TARGET)))
    for word, weight in learned.items():
        if word[0] == "=":
            entries[word[1:]] = (INSULT, weight)
    names = sorted(entries)
    hashes = _hash(names)
    order = np.argsort(hashes)
    prefixes: dict[int, list[tuple[str, float]]] = {}
    for word, weight in learned.items():
        if word[0] != "=":
            prefixes.setdefault(len(word.encode()), []).append((word, weight))
    return Lexicon(
        hashes[order],
        np.array([entries[names[i]][0] for i in order]),
        np.array([entries[names[i]][1] for i in order]),
        {k: _sorted_pairs(v) for k, v in sorted(prefixes.items())},
    )


def _sorted_pairs(pairs: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, weights = _hash([p for p, _ in pairs]), np.array([w for _, w in pairs])
    order = np.argsort(hashes)
    return hashes[order], weights[order]


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[sorted_hashes & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(sieve[wanted & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(sorted_hashes, wanted[maybe]), len(sorted_hashes) - 1)
    hit = sorted_hashes[at] == wanted[maybe]
    return maybe[hit], at[hit]


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:\n()\"")] = True


def clause_features(column: pa.Array, lex: Lexicon, machine: Transducer) -> np.ndarray:
    """Per text: the total of all clauses, the highest one, how many matched, and its words."""
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends, bounds = runs(Tables.get().word[data], offsets)
    symbol, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
    hit, at = _find(lex.words, hash_runs(data, starts, ends))
    symbol[hit], weight[hit] = lex.symbols[at], lex.weights[at]
    for size, (hashes, weights) in lex.prefixes.items():
        hit, at = _find(hashes, hash_runs(data, starts, np.minimum(starts + size, ends)))
        better = (symbol[hit] == OTHER) | (symbol[hit] == INSULT) & (weight[hit] < weights[at])
        hit, at = hit[better], at[better]
        symbol[hit], weight[hit] = INSULT, weights[at]
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    closed = np.cumsum(_ENDS[data])
    clause = np.concatenate([[0], closed])[starts] + row  # another row is another clause
    out = np.zeros((len(column), 4))
    out[:, 3] = np.diff(bounds)
    matched = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
    low, high = np.searchsorted(clause, matched), np.searchsorted(clause, matched, "right")
    for a, b in zip(low, high):
        score = machine.weigh(symbol[a:b].tolist(), weight[a:b].tolist())
        r = row[a]
        out[r] += (score, 0, 1, 0)
        out[r, 1] = max(out[r, 1], score)
    return out


class Model(NamedTuple):
    learned: dict[str, float]
    coefficients: list[float]

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.log1p(np.maximum(features, 0))
        z = self.coefficients[0] + x @ np.array(self.coefficients[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_features(text: str) -> tuple[Counter, int]:
    """How often each word (``=word``) and word beginning occurs, and the number of words."""
    data, offsets = utf8(pc.utf8_lower(pa.array([text])))
    starts, ends, _ = runs(Tables.get().word[data], offsets)
    raw = data.tobytes()
    out: Counter = Counter()
    for word, n in Counter(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())).items():
        plain = word.decode()
        if len(plain) <= WORD_CHARS:
            out["=" + plain] += n
        for k in PREFIX_CHARS:
            if k < len(plain):
                out[plain[:k]] += n
    return out, len(starts)


@F.arrow_udf(LongType())
def _sketch(column: pa.Array) -> pa.Array:
    """The smallest hash of five words in a row: near copies mostly share it."""
    out = np.zeros(len(column), np.int64)
    for first, part in slices(column):
        found = words(part)
        gram, row, _ = ngrams(found.hashes, found.bounds, 5)
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        if len(at):
            out[first + row[at]] = np.minimum.reduceat(gram, at).view(np.int64)
    return pa.array(out)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weights of the words and beginnings that mark toxic documents. Input: (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = word_features(text)
                found[""] = n
                docs[toxic].update(found.keys())
                tokens[toxic].update(found)
        for toxic in (0, 1):
            names = list(docs[toxic])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()), pa.array(np.full(len(names), toxic), pa.int32()),
                    pa.array([docs[toxic][x] for x in names], pa.int64()), pa.array([tokens[toxic][x] for x in names], pa.int64()),
                ],
                ["w", "toxic", "docs", "tokens"],
            )

    single = labelled.withColumn("sketch", _sketch("text")).dropDuplicates(["toxic", "sketch"]).select("text", "toxic")
    found = single.mapInArrow(count, "w string, toxic int, docs long, tokens long")
    one = F.col("toxic") == 1
    sums = found.groupBy("w").agg(
        *[F.coalesce(F.sum(F.when(one if t else ~one, F.col(c))), F.lit(0)).alias(f"{c}{t}") for c in ("docs", "tokens") for t in (0, 1)]
    )
    sums = sums.filter(F.col("docs1") >= LEAST_DOCS)
    whole = sums.filter(F.col("w") == "").collect()
    if not whole:
        return {}
    _, c_docs, t_docs, c_words, t_words = whole[0]
    ratio = (F.col("tokens1") / t_words) / ((F.col("tokens0") + 0.5) / (c_words + 1))
    doc_ratio = (F.col("docs1") / t_docs) / ((F.col("docs0") + 0.5) / (c_docs + 1))
    rows = sums.filter(
        (F.col("w") != "") & (F.col("docs1") >= LEAST_SHARE * t_docs) & (ratio >= LEAST_RATIO) & (doc_ratio >= LEAST_DOC_RATIO)
    ).select("w", F.log(ratio).alias("weight"), "tokens1").collect()
    weights, toxic = {r["w"]: r["weight"] for r in rows}, {r["w"]: r["tokens1"] for r in rows}
    chosen: dict[str, float] = {}
    for word in sorted(weights, key=lambda w: (len(w.lstrip("=")), w[0] == "=", w)):
        plain = word.lstrip("=")
        shorter = [plain[:k] for k in PREFIX_CHARS if k < len(plain) and plain[:k] in chosen]
        if not any(chosen[x] >= weights[word] - 1 for x in shorter):
            chosen[word] = weights[word]
    # A beginning whose longer forms say nearly all it says, and better, is left out.
    for word in [w for w in chosen if w[0] != "="]:
        longer = [w for w in chosen if w != word and w.lstrip("=").startswith(word) and chosen[w] > chosen[word]]
        if sum(toxic[w] for w in longer) >= 0.8 * toxic[word]:
            del chosen[word]
    top = max(chosen.values(), default=1.0)
    return {w: v / top for w, v in chosen.items()}


def fit_logistic(features: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> list[float]:
    """Newton steps for logistic regression on log(1 + features)."""
    x = np.column_stack([np.ones(len(y)), np.log1p(np.maximum(features, 0))])
    ridge = np.diag([1e-6] + [penalty] * features.shape[1])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b.tolist()


#: Without labels: two plain insults, or one at a target, are more likely toxic than not.
DEFAULT = [-2.0, 2.0, 1.0, 0.0, 0.0]


def _scored(column: pa.Array, lex: Lexicon, machine: Transducer) -> np.ndarray:
    out = [np.zeros((0, 4))]
    for _, part in slices(column):
        out.append(clause_features(part, lex, machine))
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled documents. ``allowed``: a condition on doc_id that rows must meet."""
    spark = docs.sparkSession
    own = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    own = own.filter(allowed) if allowed is not None else own
    order = F.xxhash64(doc_id, F.lit(7))
    chosen = own.groupBy(doc_id).agg(F.max(label).cast("int").alias("toxic")).orderBy(order, doc_id).limit(SAMPLE)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(FOLDS)))
    # At most SAMPLE short rows.
    rows = docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), doc_id
    )
    sizes: dict[tuple[bool, int], int] = {}
    for r in rows.groupBy("fold", "toxic").count().collect():
        key = (r["fold"] == 0, r["toxic"])
        sizes[key] = sizes.get(key, 0) + r["count"]
    learned: dict[str, float] = {}
    if sizes.get((False, 0)) and sizes.get((False, 1)):
        learned = learn_lexicon(rows.filter("fold != 0").select("text", "toxic"))
    if not (sizes.get((True, 0)) and sizes.get((True, 1))):
        return Model(learned, DEFAULT)
    held = spark.sparkContext.broadcast((tuple(lexicon(learned)), tuple(grammar())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, machine = Lexicon(*held.value[0]), Transducer(*held.value[1])
        for batch in batches:
            f = _scored(batch.column(0), lex, machine)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(4)), batch.column(1), batch.column(2)], ["a", "b", "c", "d", "toxic", "id"])

    kind = docs.schema[doc_id].dataType.simpleString()
    table = rows.filter("fold = 0").select("text", "toxic", doc_id).mapInArrow(
        score, f"a double, b double, c double, d double, toxic int, id {kind}"
    ).toPandas().sort_values(["id", "a"])
    return Model(learned, fit_logistic(table[["a", "b", "c", "d"]].to_numpy(), table["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((tuple(lexicon(model.learned)), tuple(grammar()), tuple(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, machine, own = Lexicon(*held.value[0]), Transducer(*held.value[1]), Model(*held.value[2])
        for batch in batches:
            p = own.probability(_scored(batch.column(1), lex, machine))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [doc_id, "score"])

    return docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"{doc_id} {kind}, score double")


def remainder(doc_id: str | Column) -> Column:
    """crc32 of doc_id as text, modulo 5."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")) % 5


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    model = train(docs, labels, remainder("doc_id") != 0, doc_id, text)
    held = docs.sparkSession.sparkContext.broadcast((tuple(lexicon(model.learned)), tuple(grammar()), tuple(model)))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, machine, own = Lexicon(*held.value[0]), Transducer(*held.value[1]), Model(*held.value[2])
        for batch in batches:
            p = own.probability(_scored(batch.column(at).cast(pa.string()), lex, machine))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)
