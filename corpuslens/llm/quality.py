"""Document quality by weak supervision: rules vote, EM weighs them, a posterior decides.

Each rule looks at one measure of a text and votes good, bad or abstains. Nobody says how
reliable a rule is: expectation-maximisation over all documents estimates, for either
class, how often each rule votes good, bad or not at all, and the share of good documents.
A document is kept when its posterior probability of being good is high enough; no rule
alone decides, except the two base limits of the caller's query.

Only the number of documents per vote pattern reaches the driver: at most 3^11 patterns,
whatever the number of documents.

A missing or empty text has no words; all measures are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import hash_runs, ngrams, runs, slices, utf8

GOOD, ABSTAIN, BAD = 1, 0, -1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further measures of a text, all counts too.
MORE = ["n_lines", "n_upper", "n_letters", "n_digits", "n_ended_lines", "n_distinct_words", "n_marked_words", "n_dup_line_words"]
SYMBOLS = b"#*$%&|<>"


class Rule(NamedTuple):
    """Votes bad at or beyond ``bad``, good at or within ``good``; larger is worse unless
    ``bad`` is below ``good``."""

    name: str
    bad: float
    good: float


#: Measures are ratios of the counts; see ``measures``.
RULES = [
    Rule("symbols_per_word", 0.10, 0.005),
    Rule("duplicate_line_share", 0.50, 0.10),
    Rule("repeated_trigram_share", 0.25, 0.06),
    Rule("upper_share", 0.40, 0.10),
    Rule("digit_share", 0.20, 0.05),
    Rule("long_word_length", 12.0, 9.0),
    Rule("short_word_length", 2.5, 3.2),
    Rule("distinct_word_share", 0.15, 0.25),
    Rule("ended_line_share", 0.30, 0.80),
    Rule("marked_word_share", 0.30, 0.08),
    Rule("few_words", 30, 60),
]


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, members in (
        ("space", b" \t\n\x0b\x0c\r"), ("symbol", SYMBOLS), ("upper", bytes(range(65, 91))),
        ("letter", bytes([*range(65, 91), *range(97, 123), *range(192, 256)])), ("digit", b"0123456789"),
        ("mark", b"!?#*$%&|<>~^=+@"), ("end", b".!?\"')"),
    ):
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = table
    out["first"] = np.ones(256, bool)
    out["first"][128:192] = False  # continuation bytes of UTF-8
    return out


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _sum_rows(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether an equal one is in its row at all, and whether before it."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    any_, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order] = same
    twin = same.copy()
    twin[:-1] |= same[1:]
    any_[order] = twin
    return any_, before


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column."""
    kinds = _classes()
    data, offsets = utf8(column)
    n = len(column)
    inside = ~kinds["space"][data]
    starts, ends, bounds = runs(inside, offsets)
    hashes = hash_runs(data, starts, ends)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _per_row(inside & kinds["first"][data], offsets),
        "n_symbols": _per_row(kinds["symbol"][data], offsets),
        "n_upper": _per_row(kinds["upper"][data], offsets),
        "n_letters": _per_row(kinds["letter"][data], offsets),
        "n_digits": _per_row(kinds["digit"][data], offsets),
    }
    rows = np.repeat(np.arange(n), np.diff(bounds))
    gram, gram_rows, first = ngrams(hashes, bounds, 3, whole_short=False)
    twice, _ = _repeats(gram, gram_rows)
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[first[twice] + k] = True
    out["n_repeat_words"] = _sum_rows(covered[: len(hashes)], bounds)
    _, again = _repeats(hashes, rows)
    out["n_distinct_words"] = _sum_rows(~again, bounds)
    last = ends - 1
    marked = kinds["mark"][data[starts]] | kinds["mark"][data[last]] if len(starts) else np.zeros(0, bool)
    out["n_marked_words"] = _sum_rows(marked, bounds)

    line_starts, line_ends, line_bounds = runs(data != 10, offsets)
    line_rows = np.repeat(np.arange(n), np.diff(line_bounds))
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    worded = line_words > 0
    _, dup = _repeats(hash_runs(data, line_starts, line_ends)[worded], line_rows[worded])
    own = np.searchsorted(line_rows[worded], np.arange(n + 1))
    out["n_lines"] = np.diff(own)
    out["n_dup_lines"] = _sum_rows(dup, own)
    out["n_dup_line_words"] = _sum_rows(dup * line_words[worded], own)
    final = np.searchsorted(starts, line_ends[worded]) - 1
    out["n_ended_lines"] = _sum_rows(kinds["end"][data[ends[final] - 1]] if len(final) else np.zeros(0, bool), own)
    return out


def measures(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    def share(a, b):
        return np.where(c[b] > 0, c[a] / np.maximum(c[b], 1), 0.0)

    length = share("word_chars", "n_words")
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeated_trigram_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "digit_share": share("n_digits", "word_chars"),
        "long_word_length": length,
        "short_word_length": length,
        "distinct_word_share": share("n_distinct_words", "n_words"),
        "ended_line_share": share("n_ended_lines", "n_lines"),
        "marked_word_share": share("n_marked_words", "n_words"),
        "few_words": c["n_words"],
    }


def votes(c: dict[str, np.ndarray], rules: list[Rule] = RULES) -> np.ndarray:
    """Rules by documents of GOOD, ABSTAIN, BAD. Without words every rule abstains but few_words."""
    found, m, none = [], measures(c), c["n_words"] == 0
    for rule in rules:
        x = m[rule.name]
        worse, better = (x >= rule.bad, x <= rule.good) if rule.bad > rule.good else (x <= rule.bad, x >= rule.good)
        vote = np.where(worse, BAD, np.where(better, GOOD, ABSTAIN))
        if rule.name == "distinct_word_share":
            vote = np.where(c["n_words"] >= 200, ABSTAIN, vote)  # the share falls with length
        found.append(vote if rule.name == "few_words" else np.where(none, ABSTAIN, vote))
    return np.stack(found)


def with_votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, the counts, pattern): the pattern has one letter per rule, ``+``, ``0`` or ``-``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [*COUNTS, *MORE]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array(["-", "0", "+"])
        for batch in batches:
            for first, part in slices(batch.column(1)):
                c = text_counts(part)
                marks = letters[votes(c, rules) + 1]
                pattern = ["".join(marks[:, i]) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), *(pa.array(c[x].astype(np.int64)) for x in names), pa.array(pattern)],
                    [doc_id, *names, "pattern"],
                )

    return docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(
        count, f"{doc_id} {kind}, " + ", ".join(f"{x} long" for x in names) + ", pattern string"
    )


class Model(NamedTuple):
    """``tables[k, y, v]``: probability that rule k votes v - 1 on class y (0 bad, 1 good)."""

    prior: float
    tables: np.ndarray

    def posterior(self, marks: np.ndarray) -> np.ndarray:
        """Probability of good for patterns (rows of 0, 1, 2)."""
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(marks), 1))
        for k in range(marks.shape[1]):
            score += np.log(self.tables[k][:, marks[:, k]]).T
        return 1 / (1 + np.exp(score[:, 0] - score[:, 1]))


def decode(patterns: list[str], n_rules: int) -> np.ndarray:
    lookup = {"-": 0, "0": 1, "+": 2}
    return np.array([[lookup[c] for c in p] for p in patterns], np.int64).reshape(len(patterns), n_rules)


def fit(patterns: list[str], counts: np.ndarray, n_rules: int, rounds: int = 200, smooth: float = 1.0) -> Model:
    """EM for two classes of independently voting rules. It starts from the majority vote, so
    that class 1 is the one most rules call good; ends when the posteriors settle."""
    if not len(patterns):
        return Model(0.5, np.full((n_rules, 2, 3), 1 / 3))
    marks, n = decode(patterns, n_rules), counts.astype(float)
    bad, good = (marks == 0).sum(1), (marks == 2).sum(1)
    p = np.clip((good - 2 * bad + 1) / (good + 2 * bad + 1), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        weight = np.stack([n * (1 - p), n * p])
        tables = np.empty((n_rules, 2, 3))
        for k in range(n_rules):
            for v in range(3):
                tables[k, :, v] = weight[:, marks[:, k] == v].sum(1) + smooth
        tables /= tables.sum(2, keepdims=True)
        # A bad vote may not speak for quality, nor a good one against it.
        for k in range(n_rules):
            if tables[k, 1, 0] > tables[k, 0, 0]:
                tables[k, :, 0] = tables[k, :, 0].mean()
            if tables[k, 0, 2] > tables[k, 1, 2]:
                tables[k, :, 2] = tables[k, :, 2].mean()
            tables[k, :, 1] = np.maximum(1 - tables[k, :, 0] - tables[k, :, 2], 1e-9)
        prior = min(max((weight[1].sum() + 1) / (n.sum() + 2), 0.05), 0.99)
        model = Model(prior, tables)
        new = model.posterior(marks)
        settled = np.abs(new - p).max() < 1e-9
        p = new
        if settled:
            break
    return model


def judge(voted: DataFrame, n_rules: int = len(RULES)) -> tuple[DataFrame, Model]:
    """Add ``quality``, the posterior probability of being good, to the rows of ``with_votes``."""
    table = voted.groupBy("pattern").count().toPandas().sort_values("pattern")
    patterns = table["pattern"].tolist()
    model = fit(patterns, table["count"].to_numpy(), n_rules)
    p = model.posterior(decode(patterns, n_rules)) if patterns else []
    scores = voted.sparkSession.createDataFrame(
        [(a, float(b)) for a, b in zip(patterns, p)], "pattern string, quality double"
    )
    # At most 3^11 short rows.
    return voted.join(F.broadcast(scores), "pattern"), model
