"""Evaluation of scored rows: accuracy, confusion, per-class and macro F1.

All metrics are computed from the long confusion table
``(group..., y_truth, y_pred, n)``: at most groups * L * L rows however many
rows were scored, so the only shuffle of the scored data is the partial /
final count.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import THREE_WAY_LETTERS

ROUND = 4


def rounded(value, digits: int = ROUND, ties: str = "up"):
    """A number rounded to ``digits``; what lies half-way goes away from zero
    (``up``) or to the even neighbour (``even``)."""
    if ties not in ("up", "even"):
        raise ValueError(f"unknown ties {ties!r}")
    return (F.round if ties == "up" else F.bround)(value, digits)


def accuracy(scored: DataFrame, truth: str = "y_truth", pred: str = "y_pred",
             group_cols: Sequence[str] = ()) -> DataFrame:
    return (scored.groupBy(*group_cols)
            .agg(F.round(F.avg((F.col(truth) == F.col(pred)).cast("double")), ROUND).alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))


def expand_grid(counts: DataFrame, labels: Sequence, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts ``(group..., y_truth, y_pred, n)`` -> the full labels x labels
    grid per group, zeros kept.  The counts (at most groups * L * L rows) are
    folded into one map per group and the grid is generated from it, so the
    scored data is computed once (no self-join of the counts)."""
    group_cols = list(group_cols)
    lab = F.array(*[F.lit(x) for x in labels])
    folded = counts.groupBy(*group_cols).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("y_truth", "y_pred"), F.col("n")))).alias("_m"))
    return (folded.select(*group_cols, "_m", F.explode(lab).alias("y_truth"))
            .select(*group_cols, "_m", "y_truth", F.explode(lab).alias("y_pred"))
            .select(*group_cols, "y_truth", "y_pred",
                    F.coalesce(F.element_at("_m", F.struct("y_truth", "y_pred")), F.lit(0)).cast("bigint").alias("n")))


def confusion_long(scored: DataFrame, labels: Sequence = tuple(THREE_WAY_LETTERS), truth: str = "y_truth",
                   pred: str = "y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts for every (truth, pred) in ``labels`` x ``labels``, zeros kept.

    Rows whose truth or prediction is outside ``labels`` are not counted, as
    a confusion matrix restricted to the given labels does.
    """
    group_cols = list(group_cols)
    counts = scored.groupBy(*group_cols, F.col(truth).alias("y_truth"), F.col(pred).alias("y_pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return expand_grid(counts, labels, group_cols)


def confusion_matrix(conf_long: DataFrame, labels: Sequence = tuple(THREE_WAY_LETTERS),
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Wide form: one row per truth label, one column per predicted label."""
    order = F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(l), F.lit(i))])
    return (conf_long.groupBy(*group_cols, "y_truth").pivot("y_pred", list(labels)).agg(F.sum("n"))
            .na.fill(0).withColumn("_o", F.element_at(order, F.col("y_truth")))
            .orderBy(*group_cols, "_o").drop("_o"))


def label_stats(conf_long: DataFrame, labels: Sequence = tuple(THREE_WAY_LETTERS),
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, label): tp, support, predicted -- one conditional
    aggregation over the confusion table (read once, no self-joins), then a
    generator over the fixed label list."""
    group_cols = list(group_cols)
    t, p, n = F.col("y_truth"), F.col("y_pred"), F.col("n")
    aggs = []
    for i, l in enumerate(labels):
        aggs += [F.sum(F.when((t == l) & (p == l), n).otherwise(0)).alias(f"_tp{i}"),
                 F.sum(F.when(t == l, n).otherwise(0)).alias(f"_su{i}"),
                 F.sum(F.when(p == l, n).otherwise(0)).alias(f"_pr{i}")]
    wide = conf_long.groupBy(*group_cols).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(i).alias("label_pos"),
                              F.col(f"_tp{i}").cast("bigint").alias("tp"),
                              F.col(f"_su{i}").cast("bigint").alias("support"),
                              F.col(f"_pr{i}").cast("bigint").alias("predicted"))
                     for i, l in enumerate(labels)])
    return wide.select(*group_cols, F.inline(rows))


def f1_per_class(conf_long: DataFrame, group_cols: Sequence[str] = (),
                 labels: Sequence = tuple(THREE_WAY_LETTERS)) -> DataFrame:
    """Precision, recall, F1 and support per label; empty denominators give 0.

    Returns ``(group..., label, label_pos, tp, fp, fn, support, predicted,
    precision, recall, f1)``.
    """
    st = label_stats(conf_long, labels, group_cols)
    tp, su, pr = F.col("tp"), F.col("support"), F.col("predicted")
    return st.select("*", (pr - tp).alias("fp"), (su - tp).alias("fn"),
                     F.coalesce(F.try_divide(tp.cast("double"), pr), F.lit(0.0)).alias("precision"),
                     F.coalesce(F.try_divide(tp.cast("double"), su), F.lit(0.0)).alias("recall"),
                     F.coalesce(F.try_divide(F.lit(2.0) * tp, su + pr), F.lit(0.0)).alias("f1"))


def f1_macro(conf_long: DataFrame, group_cols: Sequence[str] = (),
             labels: Sequence = tuple(THREE_WAY_LETTERS)) -> DataFrame:
    """Unweighted mean F1 over labels seen in truth or prediction."""
    per = f1_per_class(conf_long, group_cols, labels)
    seen = per.filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return seen.groupBy(*group_cols).agg(F.round(F.avg("f1"), ROUND).alias("f1_macro"))


def f1_observed(conf_long: DataFrame, group_cols: Sequence[str] = (),
                labels: Sequence = tuple(THREE_WAY_LETTERS)) -> DataFrame:
    """Per-class F1 over the labels that occur, sorted by label (c, n, s)."""
    per = f1_per_class(conf_long, group_cols, labels)
    return (per.filter((F.col("support") > 0) | (F.col("predicted") > 0))
            .select(*group_cols, "label", F.round("f1", ROUND).alias("f1")))


def cell_metrics(conf_long: DataFrame, group_cols: Sequence[str],
                 labels: Sequence = tuple(THREE_WAY_LETTERS)) -> DataFrame:
    """Per group, one aggregation: accuracy, ``f1_<label>`` for every label and
    macro F1 over the labels seen in truth or prediction."""
    group_cols = list(group_cols)
    t, p, n = F.col("y_truth"), F.col("y_pred"), F.col("n")
    aggs = [F.sum(F.when(t == p, n).otherwise(0)).alias("_ok"), F.sum(n).alias("_all")]
    for i, l in enumerate(labels):
        aggs += [F.sum(F.when((t == l) & (p == l), n).otherwise(0)).alias(f"_tp{i}"),
                 F.sum(F.when(t == l, n).otherwise(0)).alias(f"_su{i}"),
                 F.sum(F.when(p == l, n).otherwise(0)).alias(f"_pr{i}")]
    wide = conf_long.groupBy(*group_cols).agg(*aggs)
    f1s = [F.coalesce(F.try_divide(F.lit(2.0) * F.col(f"_tp{i}"), F.col(f"_su{i}") + F.col(f"_pr{i}")),
                      F.lit(0.0)) for i in range(len(labels))]
    seen = [(F.col(f"_su{i}") + F.col(f"_pr{i}")) > 0 for i in range(len(labels))]
    n_seen = sum((F.when(c, 1).otherwise(0) for c in seen[1:]), F.when(seen[0], 1).otherwise(0))
    sum_seen = sum((F.when(c, f).otherwise(0.0) for c, f in zip(seen[1:], f1s[1:])),
                   F.when(seen[0], f1s[0]).otherwise(0.0))
    return wide.select(
        *group_cols,
        F.round(F.try_divide(F.col("_ok").cast("double"), F.col("_all")), ROUND).alias("accuracy"),
        *[F.round(f, ROUND).alias(f"f1_{l}") for f, l in zip(f1s, labels)],
        F.round(F.try_divide(sum_seen, n_seen), ROUND).alias("f1_macro"))


def split_counts(df: DataFrame, split_col: str = "split", label_col: str = "label",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
