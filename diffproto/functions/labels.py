"""Label words, codes and letters (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words of the two claim sets and their codes
# (0 = support, 1 = not enough info, 2 = refute / contradict).
CLAIM_LABELS = {"SUPPORTS": 0, "NOT ENOUGH INFO": 1, "REFUTES": 2}
CORPUS_LABELS = {"SUPPORT": 0, "NOT ENOUGH INFO": 1, "CONTRADICT": 2}

# Report letters of the three-way and the binary task, in
# code order, and the names of the drift table columns.
THREE_WAY_LETTERS = ["s", "n", "c"]
BINARY_LETTERS = ["s", "not"]
DRIFT_NAMES = ["Support", "Neutral", "Contradict"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label(c, mapping: dict[str, int] = CLAIM_LABELS) -> Column:
    """Label word -> code; an unknown word raises."""
    c = _col(c)
    out = None
    for word, code in mapping.items():
        out = F.when(c == F.lit(word), F.lit(code)) if out is None else out.when(c == F.lit(word), F.lit(code))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label word: "), F.coalesce(c, F.lit("NULL")))))


def decode_three(c) -> Column:
    """0 -> s, 1 -> n, anything else -> c."""
    c = _col(c)
    return F.when(c == 0, F.lit("s")).when(c == 1, F.lit("n")).otherwise(F.lit("c"))


def decode_binary(c) -> Column:
    """0 -> s, anything else -> not."""
    c = _col(c)
    return F.when(c == 0, F.lit("s")).otherwise(F.lit("not"))


def label_to_binary(c) -> Column:
    """Merge classes 1 and 2; codes outside 0..2 raise."""
    c = _col(c)
    return (F.when(c == 0, F.lit(0)).when(c.isin(1, 2), F.lit(1))
            .otherwise(F.raise_error(F.concat(F.lit("label code outside 0..2: "),
                                              F.coalesce(c.cast("string"), F.lit("NULL"))))))


def letter_order(letters: list[str]) -> Column:
    """A map letter -> position, for ordering report rows."""
    return F.create_map(*[x for i, l in enumerate(letters) for x in (F.lit(l), F.lit(i))])
