"""Tables that runs append to, with a manifest of what is committed.

A run writes its rows to a folder of its own, and then one small manifest
file, named by its run id, that names the folder.  The file is written under
another name and renamed over an older one in one step, so a reader sees a
run's rows whole or not at all, a run that is repeated (or was lost half-way)
leaves one copy, and runs that append at the same time do not meet.  A reader
lists the manifest (one small file per run) and reads the folders it names.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The manifest's entries (run, folder), by run id."""
    at, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    out = []
    for status in fs.listStatus(at):
        if status.getPath().getName().endswith(".json"):
            stream = fs.open(status.getPath())
            out.append(json.loads(io.toString(stream, "UTF-8")))
            stream.close()
    return sorted(out, key=lambda e: e["run"])


def append(df: DataFrame, path: str, run_id: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Adds the rows of ``df`` to the table at ``path`` as run ``run_id``, in
    place of any that this run has added before; returns its folder.
    ``write(df, folder)`` defaults to Parquet."""
    spark = df.sparkSession
    sc = spark.sparkContext
    name = urllib.parse.quote(run_id, safe="")
    folder = f"{path}/data/{name}-{uuid.uuid4().hex[:12]}"
    if write:
        write(df, folder)
    else:
        df.write.parquet(folder)
    draft, fs = _fs(spark, f"{path}/manifest/.{name}-{uuid.uuid4().hex[:12]}")
    out = fs.create(draft, True)
    out.write(json.dumps({"run": run_id, "folder": folder.rsplit("/", 1)[1]}).encode())
    out.close()
    hadoop = sc._jvm.org.apache.hadoop.fs
    over = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(hadoop.Path(f"{path}/manifest/{name}.json")), over)
    return folder


def read(spark: SparkSession, path: str, schema: T.StructType, load: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """The committed rows; none where nothing is committed.  ``load(folders)``
    defaults to Parquet."""
    folders = [f"{path}/data/{e['folder']}" for e in committed(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema)
    return load(folders) if load else spark.read.schema(schema).parquet(*folders)
