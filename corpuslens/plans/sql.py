"""Pieces of SQL shared by the queries' oracle statements."""

from __future__ import annotations

from ..constants import RUN_SEEDS, TRAIT_OFFSETS, form_rows
from ..functions.text import SPACE
from ..operators.tokens import WORD
from .bindings import ANSWER_WORDS, EVENT_ANSWERS

BLANK = f"[{SPACE}]"
INK = f"[^{SPACE}]"
SEEDS = ", ".join(map(str, RUN_SEEDS))
ANSWER_LIST = "[" + ", ".join(f"'{a}'" for a in ANSWER_WORDS) + "]"
EVENT_LIST = "[" + ", ".join(f"'{a}'" for a in EVENT_ANSWERS) + "]"
POINTS = "[5, 4, 3, 2, 1]"
WORDS_IN = ["always", "often", "sometimes", "rarely", "never"]
STUDY_ANSWERS = "[" + ", ".join(f"'{a}'" for a in WORDS_IN) + "]"
SENTENCES = (
    rf"list_filter(string_split(regexp_replace(text, '([.!?]+){BLANK}+', '\1' || chr(1), 'g'), chr(1)), "
    rf"lambda x: regexp_matches(x, '{INK}'))"
)
LINES_RAW = r"string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))"
LETTER_WORDS = r"regexp_extract_all(lower(text), '\p{L}+')"
PRE_TOKENS = f"regexp_extract_all(lower(text), '[{WORD}]+|[^{WORD}{SPACE}]+')"


def form(name: str) -> str:
    rows = ", ".join(f"({i}, '{t}', {s}, {TRAIT_OFFSETS[name][t]})" for i, t, s in form_rows(name))
    return f"form(item, trait, sign, offs) AS (VALUES {rows})"


def run_name(run: str) -> str:
    return "['base', " + ", ".join(f"'{s}'" for s in RUN_SEEDS) + f"][{run} + 1]"


def smoothed(mass: str, group: str) -> str:
    """A mass with a small share of its group's total; equal masses where the total is zero."""
    total = f"sum({mass}) OVER (PARTITION BY {group})"
    return f"{mass} + CASE WHEN {total} > 0 THEN 1e-9 * {total} ELSE 1 END"


# run, item, idx, m (smoothed mass), p (probability) for every item of the runs of ``mass``
CELLS = f"""
grid AS (SELECT run, item, idx FROM (SELECT DISTINCT run FROM mass),
         (SELECT unnest(range(1, 51)) AS item), (SELECT unnest(range(0, 5)) AS idx)),
cell AS (SELECT run, item, idx, coalesce(mass, 0) AS mass, {smoothed('coalesce(mass, 0)', 'run, item')} AS m
         FROM grid LEFT JOIN mass USING (run, item, idx)),
prob AS (SELECT *, m / sum(m) OVER (PARTITION BY run, item) AS p FROM cell)"""

TOP = f"""
top AS (SELECT run, item, idx, p, {POINTS}[idx + 1] AS points
        FROM (SELECT *, row_number() OVER (PARTITION BY run, item ORDER BY round(p, 12) DESC, idx) AS rk
              FROM prob) WHERE rk = 1)"""

EVENT_CELLS = f"""
ev AS (SELECT (event_id // 50) % 11 AS run, event_id % 50 + 1 AS item,
              list_position({EVENT_LIST}, event_type) - 1 AS idx, value,
              day(ts) // 10 AS epoch
       FROM events),
mass AS (SELECT run, item, idx, round(sum(value), 6) AS mass FROM ev GROUP BY ALL),{CELLS}"""

EVENT_TOP = f"""{EVENT_CELLS},{TOP}"""


def event_scores(form_name: str) -> str:
    return f"""{EVENT_TOP},
{form(form_name)},
score AS (SELECT {run_name('run')} AS run, trait, CAST(any_value(offs) + sum(sign * points) AS BIGINT) AS score
          FROM top JOIN form USING (item) GROUP BY run, trait)"""


def with_stats(groups: str = "") -> str:
    g = groups + ", " if groups else ""
    return f"""
stats AS (SELECT {g}trait, avg(score) AS mean, stddev_pop(score) AS stdev, count(*) AS runs
          FROM score WHERE run <> 'base' GROUP BY {g}trait),
report AS (SELECT {g}run, trait, CAST(score AS DOUBLE) AS score FROM score
           UNION ALL SELECT {g}'mean', trait, mean FROM stats
           UNION ALL SELECT {g}'stdev', trait, stdev FROM stats)"""


def wide(groups: str = "") -> str:
    g = groups + ", " if groups else ""
    order = "['base', " + ", ".join(f"'{s}'" for s in RUN_SEEDS) + ", 'mean', 'stdev']"
    cols = ", ".join(
        f"round(max(CASE WHEN trait = '{t}' THEN score END), 6) AS {t.replace(' ', '_')}"
        for t in TRAIT_OFFSETS["original"]
    )
    return f"""SELECT {g}run AS seed, {cols}, CAST(list_position({order}, run) - 1 AS BIGINT) AS ord
FROM report GROUP BY {g}run"""


LINES = f"""
raw_lines AS (SELECT source, doc_id, {LINES_RAW} AS ls FROM documents),
cut_lines AS (SELECT source, doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM raw_lines),
lines AS (SELECT source, doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS text FROM cut_lines),
line_rows AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS row_no FROM lines)"""

KEPT_LINES = f"""
raw_lines AS (SELECT doc_id, {LINES_RAW} AS ls FROM documents),
kept AS (SELECT doc_id, list_filter(list_transform(ls, lambda x, i: CASE WHEN i < len(ls) THEN x || chr(10) ELSE x END),
                                    lambda x: x <> '') AS ls FROM raw_lines)"""


def masked(table: str, ids: str) -> str:
    """ids, pos, spot, target, l, r, masked, sentence pieces from a table's text."""
    total = " + ".join(c.strip() for c in ids.split(","))
    return rf"""
sent AS (SELECT {ids}, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS s
         FROM (SELECT {ids}, {SENTENCES} AS ss FROM {table})),
piece AS (SELECT {ids}, pos, ps, unnest(range(0, len(ps))) AS spot
          FROM (SELECT {ids}, pos, regexp_extract_all(s, '\p{{L}}+|[^\p{{L}}]+') AS ps FROM sent)),
words_of AS (SELECT *, CASE WHEN regexp_matches(ps[1], '\p{{L}}') THEN 0 ELSE 1 END AS f0,
                    len(list_filter(ps, lambda x: list_contains({ANSWER_LIST}, lower(x)))) AS hits FROM piece),
occ AS (SELECT {ids}, pos, spot, nullif(list_position({ANSWER_LIST}, lower(ps[spot + 1])), 0) - 1 AS target,
               CASE WHEN spot >= 2 THEN lower(ps[spot - 1]) END AS l, lower(ps[spot + 3]) AS r,
               array_to_string(ps[1:spot], '') || '[MASK]' || array_to_string(ps[spot + 2:], '') AS masked,
               ({total} + pos + spot) % 50 + 1 AS item
        FROM words_of WHERE list_contains({ANSWER_LIST}, lower(ps[spot + 1]))
          OR hits = 0 AND len(ps) > f0 AND spot = f0 + 2 * ((len(ps) - f0 + 1) // 2 // 2))"""


def vocabulary(table: str, texts: tuple[str, ...] = ("text",), size: int = 32000, endings: int = 2000, longest: int = 32) -> str:
    """vocab: piece -> id, ids 0..4 being the special tokens; enc: the pieces (j, id) of each
    distinct word of the columns ``texts``, the longest known piece at each place. Recursive."""
    used = " UNION ".join(f"SELECT unnest({PRE_TOKENS.replace('text', t)}) AS word FROM {table}" for t in texts)
    return f"""
word_n AS (SELECT word, count(*) AS n FROM (SELECT unnest({PRE_TOKENS}) AS word FROM {table}) GROUP BY word),
letters AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS c FROM word_n),
alphabet AS (SELECT c AS piece, 0 AS n, 1 AS kind FROM letters UNION ALL SELECT '##' || c, 0, 1 FROM letters),
tails AS (SELECT piece, count(*) AS n, 2 AS kind
          FROM (SELECT '##' || substr(word, unnest(range(greatest(2, length(word) - {longest - 1}), length(word)))) AS piece FROM word_n)
          GROUP BY piece ORDER BY n DESC, piece LIMIT {endings}),
common AS (SELECT word AS piece, n, 3 AS kind FROM word_n WHERE length(word) BETWEEN 2 AND {longest}
           ORDER BY n DESC, word LIMIT (SELECT {size - 5} - (SELECT count(*) FROM (SELECT piece FROM alphabet UNION SELECT piece FROM tails)))),
vocab AS (SELECT piece, 4 + row_number() OVER (ORDER BY kind, n DESC, piece) AS id
          FROM (SELECT piece, min(kind) AS kind, arg_min(n, kind) AS n
                FROM (SELECT * FROM alphabet UNION ALL SELECT * FROM tails UNION ALL SELECT * FROM common) GROUP BY piece)),
used AS ({used}),
starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS spot FROM used),
spans AS (SELECT word, spot, unnest(range(1, least({longest}, length(word) - spot + 1) + 1)) AS len FROM starts),
steps AS (SELECT word, spot, max(len) AS len, arg_max(id, len) AS id
          FROM spans JOIN vocab ON piece = CASE WHEN spot > 1 THEN '##' ELSE '' END || substr(word, spot, len) GROUP BY word, spot),
walk AS (SELECT word, spot, 1 AS j, len, id FROM steps WHERE spot = 1
         UNION ALL SELECT s.word, s.spot, j + 1, s.len, s.id FROM walk w JOIN steps s ON s.word = w.word AND s.spot = w.spot + w.len),
ended AS (SELECT word FROM walk WHERE spot + len > length(word)),
enc AS (SELECT word, j, id FROM walk SEMI JOIN ended USING (word) UNION ALL SELECT word, 1, 0 FROM used ANTI JOIN ended USING (word))"""


def pieces(rows: str, ids: str, text: str = "text") -> str:
    """{ids}, k (from 1), id: the pieces of a text in order."""
    tokens = PRE_TOKENS.replace("text", text)
    return f"""SELECT {ids}, row_number() OVER (PARTITION BY {ids} ORDER BY i, j) AS k, id
FROM (SELECT {ids}, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT {ids}, {tokens} AS ws FROM {rows}))
JOIN enc USING (word)"""


def line_tokens(max_len: int | None, wrapped: bool = True) -> str:
    """Tokens of every line, with [CLS] and [SEP] if wrapped: source, row_no, k, id."""
    most = 2**40 if max_len is None else max_len - 2 * wrapped
    ends = """
        UNION ALL SELECT source, row_no, 0, 1 FROM line_rows
        UNION ALL SELECT source, row_no, coalesce(n, 0) + 1, 2
        FROM line_rows LEFT JOIN (SELECT source, row_no, count(*) AS n FROM toks GROUP BY ALL) USING (source, row_no)"""
    return f"""{LINES},{vocabulary('documents')},
toks AS (SELECT * FROM ({pieces('line_rows', 'source, row_no')}) WHERE k <= {most}),
ids AS (SELECT source, row_no, k, id FROM toks{ends * wrapped})"""


def packed(chunk: int, keep_short: bool, max_len: int | None, wrapped: bool = True) -> str:
    short = f" OR tot < {chunk}" if keep_short else ""
    return f"""{line_tokens(max_len, wrapped)},
flat AS (SELECT source, row_no // 1000 AS batch, id,
                row_number() OVER (PARTITION BY source, row_no // 1000 ORDER BY row_no, k) - 1 AS p,
                count(*) OVER (PARTITION BY source, row_no // 1000) AS tot
         FROM ids),
chunked AS (SELECT source, batch, p // {chunk} AS chunk, p % {chunk} AS place, id FROM flat
            WHERE p // {chunk} < tot // {chunk}{short})"""


PAIRS = f"""
doc_words AS (SELECT source, doc_id, {LETTER_WORDS} AS ws FROM documents),
tok AS (SELECT source, doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM doc_words),
nxt AS (SELECT source, doc_id, w1, lead(w1) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM tok),
vsize AS (SELECT count(DISTINCT w1) AS v FROM tok)"""


def sides(seeds: str) -> str:
    """Training documents per seed."""
    return f"""
side AS (SELECT source, doc_id, seed
         FROM (SELECT source, doc_id, seed,
                      row_number() OVER (PARTITION BY source, seed ORDER BY md5(seed || ':' || doc_id)) AS rk,
                      count(*) OVER (PARTITION BY source, seed) AS n
               FROM documents, (SELECT unnest([{seeds}]) AS seed))
         WHERE rk <= n * 85 // 100)"""
