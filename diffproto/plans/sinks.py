"""Sinks: error tables, drift tables and summary tables.

The reference writes each table with pandas from one process.  Here each
sink is one distributed write: right and wrong rows of a scored table go out
in one pass split by ``partitionBy('is_correct')``; summaries of many models
in one pass split by ``partitionBy('dataset', 'model')``.  Numbers are
formatted to the reference's decimals (``%.3f``) in the writer only.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import manifest
from ..sources.runlogs import read_drift

ERROR_COLUMNS = ["dataset_index", "claim", "evidence", "y_truth", "y_pred"]


# Quotes inside a value are doubled; blanks at its ends, empty values and line ends stay as they are; null is \\N.
TSV = {"sep": "\t", "header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
       "ignoreTrailingWhiteSpace": "false"}
NULL = "\\N"


def _tsv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).options(**TSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_errors(scored: DataFrame, path: str) -> None:
    """Wrong and correct rows, one write: ``path/is_correct=false|true``.
    Values that hold tabs, quotes or line ends are quoted."""
    out = scored.select(*ERROR_COLUMNS, (F.col("y_truth") == F.col("y_pred")).alias("is_correct"))
    out.write.mode("overwrite").options(**TSV, nullValue=NULL).partitionBy("is_correct").csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """The error tables read back, with ``is_correct``."""
    schema = T.StructType([T.StructField(c, T.LongType() if c == "dataset_index" else T.StringType()) for c in ERROR_COLUMNS]
                          + [T.StructField("is_correct", T.BooleanType())])
    return spark.read.options(**TSV, multiLine="true", mode="FAILFAST", emptyValue="", nullValue=NULL).schema(schema).csv(path)


def format_decimals(df: DataFrame, decimals: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles as fixed-point text (``%.3f``), other columns unchanged."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keep:
            cols.append(F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_drift(drift: DataFrame, path: str, append: bool = False) -> None:
    """Drift table as TSV, 3 decimals; ``append`` adds files to the folder
    (each file carries its own header)."""
    _tsv(format_decimals(drift), path, "append" if append else "overwrite")


def append_drift(drift: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's drift table to those of other runs; a run that is repeated
    takes its own place (see ``sources.manifest``)."""
    manifest.append(drift, path, run_id, write_drift)


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The committed runs' drift tables."""
    return manifest.read(spark, path, schema, lambda folders: read_drift(spark, folders, schema))


def write_summaries(summary: DataFrame, path: str, by: Sequence[str] = ("dataset", "model")) -> None:
    """Per-model summary tables, one folder per (dataset, model), 3 decimals."""
    _tsv(format_decimals(summary), path, partition_by=list(by))
