"""Size-checked broadcast.

A side is broadcast only when a bound on its size is *proven* from the
parameters (grid size, number of classes, vector length) and that bound
fits under the session's broadcast threshold.  Otherwise the DataFrame is
returned unchanged and Spark plans a shuffle join (AQE may still turn it
into a broadcast from runtime statistics).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}

# Fallback when the session disables auto broadcast (-1): bounded tables of
# parameters (prototypes, label grids, fit keys) are still safe below this.
MIN_BROADCAST_BYTES = 8 << 20


def parse_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", str(text))
    if not m:
        raise ValueError(f"cannot parse size {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2).lower()]


def broadcast_limit(spark: SparkSession) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")
    limit = parse_bytes(raw)
    return max(limit, MIN_BROADCAST_BYTES)


def fits_broadcast(spark: SparkSession, max_rows: int, row_bytes: int) -> bool:
    return max_rows * row_bytes <= broadcast_limit(spark)


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """``broadcast(df)`` if ``max_rows * row_bytes`` fits, else ``df``."""
    if fits_broadcast(df.sparkSession, max_rows, row_bytes):
        return F.broadcast(df)
    return df
