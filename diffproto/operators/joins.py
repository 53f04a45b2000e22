"""A join whose frequent keys are split over several tasks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000  # a key is frequent if a SHARE-th of the rows hold it
COPIES = 32  # of a frequent key's row


def frequent_keys(rows: DataFrame, key: str, share: int = SHARE) -> list:
    """The keys that at least a ``share``-th of the rows hold, at most
    ``share``: found in one pass by a frequent-items sketch of bounded size
    (merged map-side, so no shuffle by key), whose estimates may add rarer
    ones but miss none."""
    got = rows.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {share}, {16 * share})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in got["top"] or [] if x["count"] * share >= got["n"] and x["count"] > 1]


def skew_join(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str], how: str = "inner", frequent: list | None = None,
              copies: int = COPIES) -> DataFrame:
    """``rows`` joined with ``table`` (one row per ``key``) in one shuffle.

    A frequent key's row is copied, and its rows are dealt over the copies by
    a hash of the columns ``spread``; all other keys, with less than a
    ``SHARE``-th of the rows each, are joined plainly.  ``frequent`` defaults
    to ``frequent_keys(rows)``, which reads ``rows`` once more; null keys
    match nothing and stay in a left join."""
    frequent = frequent_keys(rows, key) if frequent is None else frequent
    if not frequent:
        return rows.join(table, key, how)
    hot = F.col(key).isin(frequent)
    left = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int")).otherwise(F.lit(0)))
    right = table.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
