"""Text cleaning as column expressions. Nothing here shuffles or calls Python per
row, so every function also runs on a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MASK

# Fixed value: the characters Python's str.split() and str.strip() treat as blank.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[{SPACE}]"
INK = f"[^{SPACE}]"

# One separator that no text holds marks sentence ends before the split.
_BOUNDARY = "\u0001"


def unix_newlines(text: Column) -> Column:
    """\\r\\n and \\r become \\n, as when a file is opened in text mode."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(text: Column) -> Column:
    """Lines without their newline; a final newline opens no further line."""
    unix = unix_newlines(text)
    body = F.when(F.endswith(unix, F.lit("\n")), F.substring(unix, F.lit(1), F.length(unix) - 1)).otherwise(unix)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def lines_keep_ends(text: Column) -> Column:
    """Lines that keep their own newline."""
    return F.regexp_extract_all(unix_newlines(text), F.lit(r"[^\n]*\n|[^\n]+"), 0)


def is_inked(text: Column) -> Column:
    """True when something other than white space is there."""
    return text.rlike(INK)


def nonblank(line_array: Column) -> Column:
    return F.filter(line_array, is_inked)


def skip_lines(line_array: Column, n: int = 2) -> Column:
    return F.slice(line_array, n + 1, F.greatest(F.size(line_array), F.lit(1)))


def strip_speaker(line: Column) -> Column:
    """Drop the first word and collapse the white space between the others."""
    rest = F.regexp_replace(line, f"^{BLANK}*{INK}+{BLANK}*", "")
    rest = F.regexp_replace(rest, f"{BLANK}+$", "")
    return F.regexp_replace(rest, f"{BLANK}+", " ")


def strip_brackets(text: Column) -> Column:
    """Remove stage directions: shortest span from any opener to any closer."""
    return F.regexp_replace(text, r"[(\[].*?[)\]]", "")


def clean_script(text: Column) -> Column:
    """Spoken words only. A line that was all stage direction stays as an empty line."""
    spoken = F.transform(nonblank(lines(text)), lambda x: strip_brackets(strip_speaker(x)))
    return F.array_join(spoken, "\n")


def clean_book(text: Column, compact: bool = False) -> Column:
    """Without the two header lines and blank lines. Lines keep their newline and are
    joined by another one, unless ``compact``."""
    body = nonblank(skip_lines(lines_keep_ends(text), 2))
    return F.array_join(body, "" if compact else "\n")


def clean_news(text: Column) -> Column:
    """Without blank lines, joined by a space; the newlines survive."""
    return F.array_join(nonblank(lines_keep_ends(text)), " ")


def sentences(text: Column) -> Column:
    """Split after closing punctuation that is followed by white space."""
    marked = F.regexp_replace(text, f"([.!?]+){BLANK}+", "$1" + _BOUNDARY)
    return nonblank(F.split(marked, _BOUNDARY))


def words(text: Column) -> Column:
    """Lower-case runs of letters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def fill_mask(text: Column, word: Column) -> Column:
    """Put a word in the mask's place; plain text, not a pattern."""
    return F.replace(text, F.lit(MASK), word)


def slug(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def corpus_file_name(trait: Column, polarity: Column, family: Column | str) -> Column:
    fam = family if isinstance(family, Column) else F.lit(family)
    return F.concat_ws("_", slug(trait), polarity, fam)
