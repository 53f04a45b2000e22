"""Helpers shared by the operators: table reading, scratch tables, words and
shingles as native column expressions, and connected components."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word: a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage is
    cut, and a lost executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def longs(values) -> pd.arrays.IntegerArray:
    """A nullable column of integers; through floats, as pandas has it by default, large ids would change."""
    return pd.array(list(values), dtype="Int64")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    """The words of a text, A-Z lower-cased; null gives an empty array."""
    return F.coalesce(
        F.filter(F.split(ascii_lower(c), SPACE), lambda w: w != ""),
        F.array().cast("array<string>"),
    )


def word_count(c: Column) -> Column:
    """Number of words (long); null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def once(c: Column) -> Column:
    """``c``, computed once a row: Catalyst neither copies a column that it
    takes for non-deterministic into later expressions (an array inside a
    lambda would be built again for every element) nor pushes filters on it
    below the projection that builds it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def with_shingles(df: DataFrame, text: str, out: str, k: int = SHINGLE) -> DataFrame:
    """Adds ``out``: the distinct 64-bit hashes of the text's ``k``-word
    shingles, ascending.  A text of 1 to k-1 words has one shingle, its whole
    sequence; a text without words, or null, has none.

    Words are hashed once each, and a shingle is the hash of its words'
    hashes."""
    w, n = f"__{out}_w", f"__{out}_n"
    h = F.col(w)
    df = df.withColumn(w, once(F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))).withColumn(n, F.size(h))
    at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    short = F.aggregate(h, F.lit(k).cast("long"), lambda a, x: F.xxhash64(a, x))
    full = F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - k, F.lit(0))), at)
    return df.withColumn(
        out,
        once(F.sort_array(F.array_distinct(
            F.when(F.col(n) == 0, F.array().cast("array<bigint>")).when(F.col(n) < k, F.array(short)).otherwise(full)
        ))),
    ).drop(w, n)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, heavy: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per class, ``size`` of ``classes``
    telling how many rows a class has.  Classes with at least a ``heavy``-th
    of all rows are at most ``heavy`` and are broadcast, so no task of the
    shuffled join of the rest gets more than that share for one key."""
    total = classes.agg(F.sum(size)).first()[0] or 0
    big = F.col(size) >= max(2, -(-total // heavy))
    large, small = F.broadcast(classes.filter(big)), classes.filter(~big)
    rest = rows.join(F.broadcast(classes.filter(big).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(small, keys))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), the
    component being its smallest node.  Only nodes with an edge appear.

    Each round hooks every component to the smallest one beside it, jumps the
    chains, and rewrites the edges between what is left, so the edges shrink
    until none joins two components.  Group keys are reduced with ``min`` on
    the map side, so a node with very many edges is no hot key."""
    spark = edges.sparkSession
    e = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    labels = stored(
        e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component")),
        "labels",
    )
    for _ in range(max_rounds):
        if e.isEmpty():
            return labels
        # every node's smallest neighbour, or itself
        up = stored(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")).groupBy("x").agg(F.min("y").alias("to")), "hook"
        )
        # chains only go down in id, so following them ends; each jump doubles the reach
        while True:
            nxt = up.alias("p").join(up.alias("q"), F.col("p.to") == F.col("q.x"), "left").select(
                F.col("p.x").alias("x"), F.coalesce("q.to", "p.to").alias("to"), F.col("q.to").isNotNull().alias("moved")
            )
            nxt = stored(nxt, "jump")
            up = nxt.select("x", "to")
            if nxt.filter("moved").isEmpty():
                break
        root = lambda df, c: df.join(up, F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("to", c)).drop("x", "to")
        labels = stored(root(labels, "component"), "labels")
        e = stored(
            root(root(e, "u"), "v").filter("u <> v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
