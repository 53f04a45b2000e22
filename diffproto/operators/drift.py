"""Prototype drift as the number of shots grows.

The reference re-samples and re-encodes every prefix for every m.  Here the
prototypes of *all* grid values come from one pass: the seeded rank puts each
class in a fixed order, the grid cuts that order into blocks, each block's
vectors are summed position by position (map-side combined), and prefix sums
over blocks give the prototype after every grid value.  Prefix sums are blocked
too: inside groups of ``GROUP`` blocks, plus what earlier groups hold, so
neither the grid nor a class is ever one task's or one array's.  Only keys are
ranked; vectors are computed for the rows that the ranking keeps.  A class with
fewer than m rows keeps its last prototype (it uses all it has).
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.labels import DRIFT_NAMES
from ..functions.vectors import distance
from ..operators.sampling import KEY, top_per_class
from ..plans.broadcast import bounded_broadcast
from ..session import scratch_table

LETTER_NAMES = ["s", "n", "c"]
GROUP = 1024  # blocks


def grid_prototypes(pairs: DataFrame, seeds, shots: Sequence[int], vec_col: str = "diff", label_col: str = "label",
                    key: Sequence[str] = KEY, prepare: Callable[[DataFrame], DataFrame] | None = None,
                    n_classes: int = 3) -> DataFrame:
    """``(seed, label, j, centroid)``: the prototype after the j-th of the
    sorted ``shots``, for every j up to the one that takes in the class's last
    row.  Ranking sees keys only; the rows of the ranked keys are joined back
    and get their vectors (``prepare``) after that."""
    n_seeds = 1 if isinstance(seeds, int) else len(list(seeds))
    grid = np.array(sorted({int(m) for m in shots}))

    def block(rank):
        """The place of the first grid value that is not below the rank."""
        if len(grid) == grid[-1]:
            return (F.col(rank) - 1).cast("int")
        if len(grid) <= GROUP:
            return F.size(F.filter(F.array(*[F.lit(int(m)) for m in grid]), lambda m: m < F.col(rank)))

        @F.pandas_udf(IntegerType())
        def search(r: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(grid, r.to_numpy()).astype("int32"))

        return search(rank)

    ranked = top_per_class(pairs.select(*key, label_col), seeds, int(grid[-1]), (label_col,), key)
    ranked = ranked.select("seed", *key, block("rank").alias("j"))
    rows = pairs.join(bounded_broadcast(ranked, n_seeds * n_classes * int(grid[-1]), 64), list(key))
    rows = prepare(rows) if prepare is not None else rows
    at = ["seed", label_col, "pos"]
    sums = (rows.select("seed", label_col, "j", F.posexplode_outer(vec_col).alias("pos", "x"))
            .filter(F.col("pos").isNotNull())
            .groupBy(*at, "j").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
            .withColumn("g", F.floor(F.col("j") / GROUP)))
    before = Window.partitionBy(*at).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.groupBy(*at, "g").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).select(
        *at, "g", F.coalesce(F.sum("x").over(before), F.lit(0.0)).alias("x0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*at, "g").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = sums.withColumn("x", F.sum("x").over(inside)).withColumn("n", F.sum("n").over(inside))
    c = c.join(carry, [*at, "g"]).select(*at, "j", ((F.col("x") + F.col("x0")) / (F.col("n") + F.col("n0"))).alias("c"))
    return c.groupBy("seed", label_col, "j").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("_s")).select(
        "seed", label_col, "j", F.transform("_s", lambda s: s["c"]).alias("centroid"))


def running_prototypes(pairs: DataFrame, seeds, max_m: int, vec_col: str = "diff", label_col: str = "label", **kw) -> DataFrame:
    """``(seed, label, rank, pos, c)``: prototype value at position ``pos``
    after every ``rank`` up to ``max_m``."""
    protos = grid_prototypes(pairs, seeds, range(1, max_m + 1), vec_col, label_col, **kw)
    return protos.select("seed", label_col, (F.col("j") + 1).alias("rank"), F.posexplode("centroid").alias("pos", "c"))


def drift_pairs(pairs: DataFrame, seeds, steps: Sequence[tuple[int, int]], vec_col: str = "diff",
                label_col: str = "label", key: Sequence[str] = KEY,
                prepare: Callable[[DataFrame], DataFrame] | None = None, metric: str = "euclidean") -> DataFrame:
    """Distance (``metric``: euclidean, cosine or triangle, as in
    ``vectors.distance``) between the prototypes after ``start`` and after
    ``end`` shots, for every (start, end) in ``steps``:
    ``(seed, label, start, end, drift)``."""
    spark = pairs.sparkSession
    grid = sorted({int(m) for step in steps for m in step})
    place = {m: j for j, m in enumerate(grid)}
    measure = distance("_a", "_b", metric)  # an unknown metric raises here
    # seeds * classes * grid values * d; read for the classes' ends and for both ends of the steps
    protos = scratch_table(grid_prototypes(pairs, seeds, grid, vec_col, label_col, key, prepare), "grid-prototypes")
    last = protos.groupBy(F.col("seed").alias("_s"), F.col(label_col).alias("_l")).agg(F.max("j").alias("_last"))
    asked = spark.createDataFrame([(int(a), int(b), place[a], place[b]) for a, b in steps], "start int, end int, ja int, jb int")
    want = asked.crossJoin(F.broadcast(last)).select("start", "end", "_s", "_l", F.least("ja", "_last").alias("ja"), F.least("jb", "_last").alias("jb"))
    at = lambda j: (F.col("_s") == F.col("seed")) & F.col("_l").eqNullSafe(F.col(label_col)) & (F.col(j) == F.col("j"))
    first = want.join(protos.withColumnRenamed("centroid", "_a"), at("ja")).select("start", "end", "_s", "_l", "jb", "_a")
    both = first.join(protos.withColumnRenamed("centroid", "_b"), at("jb"))
    return both.select("seed", label_col, "start", "end", measure.alias("drift"))


def drift_consecutive(pairs: DataFrame, seeds, shots: Sequence[int], round_to: int = 4, **kw) -> DataFrame:
    """Drift between consecutive shot counts, one column per class:
    ``(seed, step, start, end, Support, Neutral, Contradict)``."""
    steps = list(zip(shots, shots[1:]))
    d = drift_pairs(pairs, seeds, steps, **kw)
    wide = d.groupBy("seed", "start", "end").pivot("label", [0, 1, 2]).agg(F.first("drift"))
    return wide.select("seed", F.concat_ws("_", F.col("start").cast("string"), F.col("end").cast("string")).alias("step"),
                       "start", "end",
                       *[F.round(F.col(str(i)), round_to).alias(DRIFT_NAMES[i]) for i in range(3)])


def drift_from_base(pairs: DataFrame, seeds, shots: Sequence[int], round_to: int = 4, **kw) -> DataFrame:
    """Drift of every later grid value from the first one, divided by the
    distance in shots: ``(seed, step = n - base, s, n, c)``."""
    base = shots[0]
    steps = [(base, n) for n in shots[1:]]
    d = drift_pairs(pairs, seeds, steps, **kw).withColumn(
        "rate", F.col("drift") / (F.col("end") - F.col("start")))
    wide = d.groupBy("seed", "start", "end").pivot("label", [0, 1, 2]).agg(F.first("rate"))
    return wide.select("seed", (F.col("end") - F.col("start")).alias("step"),
                       *[F.round(F.col(str(i)), round_to).alias(LETTER_NAMES[i]) for i in range(3)])
