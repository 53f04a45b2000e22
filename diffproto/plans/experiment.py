"""One prototype experiment: split -> difference vectors -> prototypes ->
nearest-prototype labels on the dev rows.

Plan shape: the fit sample is ranked on keys, in hash buckets; the
prototypes are one partial/final aggregate over its rows; the dev rows are scored
map-side against a scalar-subquery pack of the prototypes; only the
final counts shuffle again.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import decode_binary, decode_three
from ..functions.vectors import diff
from ..operators import sampling
from ..operators.prototypes import predict, prototypes
from ..session import scratch_table
from .broadcast import bounded_broadcast

KEY = sampling.KEY


def with_diff(pairs: DataFrame, absolute: bool = True, claim_vec: str = "claim_vec",
              evidence_vec: str = "evidence_vec") -> DataFrame:
    return pairs.withColumn("diff", diff(evidence_vec, claim_vec, absolute))


def split_rows(pairs: DataFrame, seed: int, m: int, caps: dict[int, int] | None = None,
               key: Sequence[str] = KEY, with_index: bool = False,
               n_classes: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fit rows and dev rows of ``pairs`` (whole rows, not yet encoded).

    Ranking runs on the keys only; the rows are then picked by joins
    against those keys, so any expensive preparation (encoding) that follows
    runs once per row:
    * fit rows: broadcast join with the fit keys (at most classes * m);
    * capped dev rows: broadcast join with the capped pool keys (at most
      sum(caps));
    * uncapped dev rows: broadcast anti join with the fit keys -- one pass;
    * uncapped dev rows with ``dataset_index``: exact bucketed rank on the
      keys, then a shuffle join back to the rows.
    """
    keys = pairs.select(*key, "label")
    body = pairs.drop("label")
    # bounded; it serves the join for the fit rows and the anti join for the dev rows
    fit_k = scratch_table(sampling.fit_sample(keys, seed, m, key=key), "fit-keys")
    fit = pairs.join(bounded_broadcast(fit_k.drop("label"), n_classes * m, 64), list(key))
    if caps:
        pool = (sampling.capped_with_index(keys, seed, m, caps, key=key) if with_index
                else sampling.split_capped(keys, seed, m, caps, key=key))
        dev_k = pool.filter(F.col("split") == "dev").drop("split")
        dev = body.join(bounded_broadcast(dev_k, sum(caps.values()), 64), list(key))
    elif with_index:
        dev_k = sampling.dev_with_index(keys, seed, m, key=key)
        dev = body.join(dev_k, list(key))
    else:
        # the same ranked keys serve the fit join and the anti join
        used = bounded_broadcast(fit_k.select(*key), n_classes * m, 64)
        dev = pairs.withColumn("seed", F.lit(seed)).join(used, list(key), "left_anti")
    return fit, dev


def fit_rows(pairs: DataFrame, seed: int, m: int, key: Sequence[str] = KEY, n_classes: int = 3,
             prepare: Callable[[DataFrame], DataFrame] | None = with_diff) -> DataFrame:
    """The m-shot fit sample with its vectors: keys are ranked, the few rows
    they name are joined back, and only those are prepared."""
    fit_k = sampling.fit_sample(pairs.select(*key, "label"), seed, m, key=key).drop("label")
    rows = pairs.join(bounded_broadcast(fit_k, n_classes * m, 64), list(key))
    return prepare(rows) if prepare is not None else rows


def fit_and_dev(pairs: DataFrame, seed: int, m: int, caps: dict[int, int] | None = None,
                key: Sequence[str] = KEY, with_index: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fit sample (m per class) and dev rows (the rest, or up to the caps)."""
    return split_rows(pairs, seed, m, caps, key, with_index)


def score(pairs: DataFrame, seed: int, m: int, metric: str = "euclidean",
          caps: dict[int, int] | None = None, key: Sequence[str] = KEY, with_index: bool = False,
          binary: bool = False, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Dev rows with integer ``truth`` / ``pred`` and letters ``y_truth`` / ``y_pred``.

    ``prepare`` turns rows into rows with a ``diff`` column (e.g. encode the
    texts, then take the difference); it is applied after the split, to the
    fit rows and to the dev rows separately, so each row is prepared once.
    """
    fit, dev = split_rows(pairs, seed, m, caps, key, with_index)
    if prepare is not None:
        fit, dev = prepare(fit), prepare(dev)
    protos = prototypes(fit, "diff", "label")
    scored = predict(dev, protos, "diff", metric, out="pred")
    decode = decode_binary if binary else decode_three
    return (scored.withColumn("truth", F.col("label"))
            .withColumn("y_truth", decode("truth"))
            .withColumn("y_pred", decode("pred")))


def score_stored(pairs: DataFrame, seed: int, m: int, prepare: Callable[[DataFrame], DataFrame], metric: str = "euclidean",
                 key: Sequence[str] = KEY, n_classes: int = 3) -> DataFrame:
    """Every dev row's key, ``dataset_index``, ``truth``, ``pred`` and letters,
    as a stored table.

    The pairs are read and prepared (encoded) once, and their keys, labels and
    difference vectors stored.  One exact ranking of the keys tells fit rows
    from dev rows; prototypes and predictions read the stored vectors, the
    prediction is joined with the ranking by key, and texts take no part."""
    # a long document gives many pairs: dealing them out costs a tenth of encoding them
    dealt = pairs.repartition(*key)
    vecs = scratch_table(prepare(dealt).select(*key, "label", "diff"), "pair-diffs")
    ranked = scratch_table(sampling.exact_rank(vecs.select(*key, "label"), seed, key=key).select(*key, "label", "rank"), "pair-ranks")
    fit_k = bounded_broadcast(ranked.filter(F.col("rank") <= m).select(*key), n_classes * m, 64)
    protos = prototypes(vecs.join(fit_k, list(key)), "diff", "label")
    scored = predict(vecs, protos, "diff", metric, out="pred").select(*key, "pred")
    dev = sampling.with_index(ranked, m).join(scored, list(key))
    return scratch_table(dev.select(*key, "dataset_index", F.col("label").alias("truth"), "pred", decode_three("label").alias("y_truth"),
                                    decode_three("pred").alias("y_pred")), "pair-scores")


def score_two_sets(fit_pairs: DataFrame, dev_pairs: DataFrame, seed: int, m: int, dev_cap: int = 70,
                   metric: str = "euclidean", key: Sequence[str] = KEY, n_classes: int = 3,
                   prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The corpus experiment: prototypes from the m-shot sample of one pair
    set, evaluation on a separate dev set capped at ``dev_cap`` rows per class
    (both seeded).  Both sides are picked on keys first (bounded broadcasts:
    classes * m and classes * dev_cap keys), then prepared (encoded) once."""
    fit_k = sampling.fit_sample(fit_pairs.select(*key, "label"), seed, m, key=key)
    fit = fit_pairs.join(bounded_broadcast(fit_k.drop("label"), n_classes * m, 64), list(key))
    dev_k = sampling.dev_capped(dev_pairs.select(*key, "label"), seed, dev_cap, key=key)
    dev = dev_pairs.drop("label").join(bounded_broadcast(dev_k, n_classes * dev_cap, 64), list(key))
    if prepare is not None:
        fit, dev = prepare(fit), prepare(dev)
    protos = prototypes(fit, "diff", "label")
    scored = predict(dev, protos, "diff", metric, out="pred")
    return (scored.withColumn("truth", F.col("label"))
            .withColumn("y_truth", decode_three("truth"))
            .withColumn("y_pred", decode_three("pred")))
