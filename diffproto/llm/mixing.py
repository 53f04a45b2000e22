"""Mixing sources to target weights.

Token counts are aggregated per source, the mix's size is shared out by
weight under a cap on repetition, and each document is emitted
``floor(rate)`` times plus one more copy with probability equal to the
rate's fraction, drawn from a hash of (seed, doc_id, text).

Shape: one map-side combined aggregate by source; a window over the table
of sources (one row per source, never rows of documents); then a broadcast
join back to the documents, with the size of the source table checked first,
or a shuffle join beyond it.  Documents are never grouped or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from .common import read, word_count

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix holds 3/2 of all words
CAP = 2
SEED = 17


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: ``source_size``, ``target`` and ``rate``.

    Sources are ranked by code point (null last) and weigh ``weights``,
    repeating.  Targets fill up in proportion to weight until a source
    reaches ``cap`` times its size; its excess goes to the others by weight.
    That is one level L with target = min(cap * size, L * weight): sources
    in ascending order of cap * size / weight reach their cap one after
    another, so L follows from running sums.  A source without words has
    target and rate 0."""
    per = sized.groupBy(F.col(source).alias("__s")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("__s").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", pick).withColumn("limit", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")), F.col("__s").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumns({
        "__total": F.sum("source_size").over(everything),
        "__full": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "__open": F.sum("weight").over(rest),
    })
    level = (F.col("__total") * F.lit(share[0]) / F.lit(share[1]) - F.col("__full")) / F.col("__open")
    # the level is the one at the first source that stays under its cap; further on it only sinks
    per = per.withColumn("__level", level).withColumn(
        "level", F.max(F.when(F.col("__level") * F.col("weight") <= F.col("limit"), F.col("__level"))).over(everything)
    )
    target = F.when(
        F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("limit")), F.col("limit").cast("double")
    ).otherwise(F.col("level") * F.col("weight"))
    return per.withColumn("target", target).select(
        "__s", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed, the id and the text: the
    same row gets the same draw in every run, on any partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
               seed: int = SEED, max_sources: int = 4096, **targets) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target`` and
    ``copies``, how often the mix takes the row.

    Null source: a source of its own.  Null or empty text: size 0.  Null
    ids and repeated rows are mixed like others; equal rows draw alike.  An
    empty table gives an empty result.  Columns of ``docs`` with the names
    of the added ones are replaced."""
    added = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*[c for c in added if c not in (id_col, source, text)])
    sized = docs.withColumn("size", word_count(F.col(text)))
    per = source_targets(sized.select(source, "size"), source, "size", **targets)
    # how many sources there are is known only from the data: ask for one row over the bound
    few = sized.select(source).distinct().limit(max_sources + 1).count() <= max_sources
    side = bounded_broadcast(per, max_sources, 256) if few else per
    # the caller's columns may have any name but the added ones
    side = side.select("__s", "source_size", "target", F.col("rate").alias("__rate"))
    joined = sized.join(side, F.col(source).eqNullSafe(F.col("__s")), "left")
    extra = (draw(F.col(id_col), F.col(text), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return joined.withColumn("copies", F.floor("__rate").cast("long") + extra).drop("__s", "__rate")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with
    all their columns as they are, whatever their names."""
    whole = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = mix_counts(whole, **options).filter("copies > 0")
    return counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_counts(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM s),
f AS (
  SELECT *, CAST(SUM(source_size) OVER () AS BIGINT) AS total,
         CAST(COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
         CAST(SUM(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight
  FROM w),
l AS (SELECT *, (total * 3 / 2 - full_before) / open_weight AS lv FROM f),
m AS (SELECT *, MAX(CASE WHEN lv * weight <= cap THEN lv END) OVER () AS level FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR level * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target
  FROM m),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('17:' || COALESCE(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(COALESCE(d.text, ''))), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
