"""Seeded hashing: reproducible order, picks and buckets.

md5 is used because the same hex string comes out of Spark and DuckDB, so
every split can be checked by the SQL oracle.  ``xxhash64`` would be faster
but has no twin there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(seed, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...`` -- the shuffle order of a row."""
    parts = [_col(seed).cast("string")] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hex8_to_int(hex_col: Column) -> Column:
    """First 8 hex digits as a non-negative integer."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def seeded_index(seed, n, *keys) -> Column:
    """A reproducible index in [0, n) from the seed and the row keys.

    ``n = 0`` raises, as sampling from an empty list does.
    """
    n = _col(n)
    return F.when(n > 0, F.pmod(hex8_to_int(seeded_hash(seed, *keys)), n)).otherwise(
        F.raise_error(F.lit("cannot pick from an empty list")))


def token_bucket(token, d: int) -> Column:
    """Hash bucket in [0, d) of a token (first 8 hex digits of md5)."""
    return F.pmod(hex8_to_int(F.md5(_col(token))), F.lit(d))
