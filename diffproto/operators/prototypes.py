"""Class prototypes and nearest-prototype prediction.

Prototypes are element-wise means of difference vectors.  The mean is taken
per (group, class, position) after ``posexplode``: the aggregation key has
n_classes * d values instead of n_classes, partial sums are combined
map-side, and the d means are gathered back in position order.

Prediction packs the prototypes of a group into one sorted array.  With no
group columns the pack is a scalar subquery (one bounded row, evaluated once
and shipped with the task binary); with group columns it is joined on them,
broadcast when the proven bound (groups * classes * d doubles) fits.
Scoring is then a per-row ``transform`` over the packed prototypes: no
join multiplies the data rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let, similarity
from ..plans.broadcast import bounded_broadcast


def mean_vectors(df: DataFrame, group_cols: Sequence[str], vec_col: str,
                 out: str = "centroid", method: str = "explode") -> DataFrame:
    """Element-wise mean of ``vec_col`` per group: ``(*group_cols, n, out)``."""
    group_cols = list(group_cols)
    if method == "summarizer":
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        return (df.groupBy(*group_cols)
                .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"),
                     F.count(F.lit(1)).alias("n"))
                .select(*group_cols, "n", vector_to_array("_m").alias(out)))
    if method != "explode":
        raise ValueError(f"unknown mean method {method!r}")
    # posexplode_outer + a filter on pos: a plain posexplode makes Catalyst
    # infer ``size(vec) > 0`` and push it below joins, where it would compute
    # the whole vector expression (e.g. an encoder) for rows the join drops
    per_pos = (df.select(*group_cols, F.posexplode_outer(vec_col).alias("pos", "x"))
               .filter(F.col("pos").isNotNull())
               .groupBy(*group_cols, "pos")
               .agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")))
    return (per_pos.groupBy(*group_cols)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_s"),
                 F.max("n").alias("n"))
            .select(*group_cols, "n", F.transform("_s", lambda s: s["x"]).alias(out)))


def prototypes(fit: DataFrame, vec_col: str = "diff", label_col: str = "label",
               group_cols: Sequence[str] = (), method: str = "explode") -> DataFrame:
    """One prototype per (group, class): ``(*group, label, proto_id, n, centroid)``.

    A class missing from the fit sample gets no prototype (it is dropped from
    the candidates instead of producing a NaN mean that would always win).
    """
    p = mean_vectors(fit, [*group_cols, label_col], vec_col, "centroid", method)
    return p.withColumn("proto_id", F.col(label_col).cast("int")).select(
        *group_cols, label_col, "proto_id", "n", "centroid")


def pack_prototypes(protos: DataFrame, group_cols: Sequence[str] = (), label_col: str = "label") -> DataFrame:
    """One row per group with ``protos`` = array of (proto_id, label, centroid)
    sorted by proto_id."""
    return (protos.groupBy(*group_cols)
            .agg(F.array_sort(F.collect_list(
                F.struct(F.col("proto_id"), F.col(label_col).alias("label"), F.col("centroid"))))
                .alias("protos")))


def argmax_label(vec: Column, protos: Column, metric: str = "euclidean") -> Column:
    """Label of the most similar prototype; ties go to the lowest proto_id
    (first maximum), NaN counts as the largest value (as numpy's argmax)."""
    # bind the vector and the similarities once (let), so neither is
    # recomputed per prototype, for array_max and array_position, or when
    # Catalyst inlines this expression into a filter
    return let(vec, lambda v: let(protos, lambda ps: let(
        F.transform(ps, lambda p: similarity(v, p["centroid"], metric)),
        lambda s: F.element_at(ps, F.array_position(s, F.array_max(s)).cast("int"))["label"])))


def predict(df: DataFrame, protos: DataFrame, vec_col: str = "diff", metric: str = "euclidean",
            group_cols: Sequence[str] = (), out: str = "y_pred", dim: int | None = None,
            max_groups: int = 1, label_col: str = "label") -> DataFrame:
    """Label every row of ``df`` with its nearest prototype (of its group)."""
    packed = pack_prototypes(protos, group_cols, label_col)
    if not group_cols:
        with_p = df.withColumn("_protos", packed.select("protos").scalar())
    else:
        row_bytes = 64 + 8 * (dim or 1024) * 6
        with_p = df.join(bounded_broadcast(packed.withColumnRenamed("protos", "_protos"), max_groups, row_bytes),
                         list(group_cols))
    return with_p.withColumn(out, argmax_label(F.col(vec_col), F.col("_protos"), metric)).drop("_protos")

