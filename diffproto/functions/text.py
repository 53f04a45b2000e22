"""Text helpers (Column -> Column), all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket tokens of the claim corpus and their replacements,
# applied in this order, case-sensitive.
BRACKET_TOKENS = [
    ("-LRB-", "("),
    ("-RRB-", ")"),
    ("-LSB-", "["),
    ("-RSB-", "]"),
]

# Characters removed at both ends by ``strip_text``: the whitespace set of
# Python's str.strip (ASCII blanks, U+001C..U+001F, U+0085 and the Unicode
# separators).  The same class works in Java regex and RE2 (DuckDB).
STRIP_CLASS = r"[\s\x0B\p{Z}\x1c-\x1f\x85]"
STRIP_PATTERN = rf"^{STRIP_CLASS}+|{STRIP_CLASS}+$"

# A line is blank when it holds nothing but these characters.
NON_BLANK_PATTERN = r"[^ \t\r\f\x0B]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_brackets(c) -> Column:
    out = _col(c)
    for token, repl in BRACKET_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(repl))
    return out


def strip_text(c) -> Column:
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def normalize_evidence(c) -> Column:
    """Evidence text: brackets cleaned first, then lower-cased and stripped."""
    return strip_text(F.lower(clean_brackets(c)))


def normalize_claim(c, fix_order: bool = False) -> Column:
    """Claim text: lower-cased and stripped *before* the bracket cleaning.

    Upper-case bracket tokens are therefore no longer matched and survive as
    ``-lrb-``; pass ``fix_order=True`` to clean them like the evidence.
    """
    if fix_order:
        return normalize_evidence(c)
    return clean_brackets(strip_text(F.lower(_col(c))))


def non_blank_lines(c) -> Column:
    """Lines of a text that hold a non-blank character, in order."""
    return F.filter(F.split(_col(c), "\n"), lambda line: line.rlike(NON_BLANK_PATTERN))


def checked_index(arr: Column, i: Column) -> Column:
    """``arr[i]`` for a 0-based index; out-of-range or negative raises."""
    return F.when((i >= 0) & (i < F.size(arr)), F.element_at(arr, i + 1)).otherwise(
        F.raise_error(F.concat(F.lit("sentence index out of range: "), i.cast("string"))))


def join_selected(sentences, indexes) -> Column:
    """Sentences picked by a list of 0-based indexes, joined by one blank.

    Order and repeats of the index list are kept; an empty list gives ''.
    """
    s = _col(sentences)
    return F.array_join(F.transform(_col(indexes), lambda i: checked_index(s, i)), " ")


def merge_sentences(sentences) -> Column:
    return F.array_join(_col(sentences), " ")


def to_doc_id(c) -> Column:
    """Text key to integer (``int(doc_id)``); anything else raises."""
    c = _col(c)
    v = c.cast("string").try_cast("bigint")
    return F.when(v.isNotNull() | c.isNull(), v).otherwise(
        F.raise_error(F.concat(F.lit("not an integer document id: "), c.cast("string"))))
