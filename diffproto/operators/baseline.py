"""Supervised baseline on the same splits.

The reference fine-tunes a transformer on the m-shot fit set.  Here the
baseline is a multinomial logistic regression on the same difference vectors,
with an L2 penalty on all weights (the bias is the weight of a constant one).
That objective is strictly convex, so it has one optimum, and Newton steps with
a fixed stopping rule reach it to about 1e-9 whatever the partitioning, the
start and the order of the rows: predictions can be checked.

* ``newton_fit``: one fit over a distributed table.  A step is one pass; each
  partition leaves its sums of loss, gradient and Hessian, which are added up
  in a tree; the driver solves one (classes * (d + 1))^2 system.
* ``fit_cells``: a grid of small fits.  All cells of a seed are solved
  together, its runs stacked in one solve; shot counts are nested, so the fit
  for m starts from the optimum for the next smaller m.
* ``linear_scores``: class scores, prediction and probability for any rows.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L2 = 0.05
TOL = 1e-10
MAX_STEPS = 100
DRIVER_BYTES = 256 << 20  # of partial sums collected in a step
MAX_PARAMS = 4096  # of one distributed fit: its Hessian is solved on the driver (128 MB)


# ---------------------------------------------------------------- the objective

def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((*x.shape[:-1], 1))], axis=-1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sums over rows of loss, gradient and Hessian of the softmax loss for
    stacked weights ``w`` (cells, classes, d); ``x`` (n, d) with its one,
    ``y`` class codes, ``weight`` (cells, n).  The penalty is not included."""
    cells, classes, d = w.shape
    weight = np.ones((cells, len(x))) if weight is None else weight
    z = np.einsum("nd,ckd->cnk", x, w)
    top = z.max(axis=2, keepdims=True)
    log = np.log(np.exp(z - top).sum(axis=2)) + top[:, :, 0]
    p = np.exp(z - log[:, :, None])
    loss = (weight * (log - np.take_along_axis(z, np.broadcast_to(y[None, :, None], (cells, len(x), 1)), 2)[:, :, 0])).sum(axis=1)
    g = np.einsum("cn,cnk,nd->ckd", weight, p - np.eye(classes)[y][None], x, optimize=True)
    h = np.zeros((cells, classes, d, classes, d))
    for j in range(classes):
        for k in range(j, classes):
            s = weight * p[:, :, j] * ((j == k) - p[:, :, k])
            block = (s[:, :, None] * x[None]).transpose(0, 2, 1) @ x
            h[:, j, :, k, :] = block
            h[:, k, :, j, :] = block.transpose(0, 2, 1)
    return loss, g, h.reshape(cells, classes * d, classes * d)


def _solve(g: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Newton step) of the mean loss plus penalty, stacked over cells."""
    cells, flat = len(w), w.reshape(len(w), -1)
    grad = g.reshape(cells, -1) / n[:, None] + l2 * flat
    step = np.linalg.solve(h / n[:, None, None] + l2 * np.eye(flat.shape[1]), grad[:, :, None])[:, :, 0]
    return grad, step.reshape(w.shape)


def newton(sums, w: np.ndarray, n: np.ndarray, l2: float = L2, tol: float = TOL, max_steps: int = MAX_STEPS) -> np.ndarray:
    """Newton steps with halving, for all cells together, until no entry of a
    gradient exceeds ``tol``.  ``sums(w)`` gives loss, gradient and Hessian sums."""
    value = lambda loss, w: loss / n + 0.5 * l2 * (w ** 2).sum(axis=(1, 2))
    loss, g, h = sums(w)
    now = value(loss, w)
    for _ in range(max_steps):
        grad, step = _solve(g, h, w, n, l2)
        open_ = np.abs(grad).max(axis=1) > tol
        if not open_.any():
            return w
        size = open_.astype(float)
        while True:
            tried = w - size[:, None, None] * step
            loss, g, h = sums(tried)
            worse = (value(loss, tried) > now + 1e-12 * np.abs(now)) & (size > 1e-6)
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        w, now = tried, value(loss, tried)
    raise RuntimeError(f"no optimum after {max_steps} steps")


# ---------------------------------------------------------------- one distributed fit

def newton_fit(fit: DataFrame, vec_col: str = "diff", label_col: str = "label", n_classes: int = 3, l2: float = L2,
               tol: float = TOL) -> np.ndarray:
    """Weights (classes, d + 1), the bias last, of the optimum over ``fit``.

    ``fit`` is read once per step, so store it if it is costly.  Each
    partition sums its rows' loss, gradient and Hessian in Arrow batches and
    leaves one row; those rows are added up in a tree, so the driver gets at
    most ``DRIVER_BYTES`` of them.  An empty ``fit`` raises."""
    from ..session import ship_package

    spark = fit.sparkSession
    ship_package(spark)
    head = fit.withColumn("_part", F.spark_partition_id()).agg(F.max(F.size(vec_col)).alias("d"), F.min(F.size(vec_col)).alias("e"), F.count(F.lit(1)).alias("n"),
                   F.min(label_col).alias("lo"), F.max(label_col).alias("hi"), F.max("_part").alias("parts")).first()
    if not head["n"]:
        raise ValueError("nothing to fit on")
    if head["d"] != head["e"]:
        raise ValueError(f"vectors of {head['e']} to {head['d']} components")
    if head["lo"] is None or not 0 <= head["lo"] <= head["hi"] < n_classes:
        raise ValueError(f"labels outside 0..{n_classes - 1}")
    d = head["d"] + 1
    size = n_classes * d
    if size > MAX_PARAMS:
        raise ValueError(f"{size} parameters; the Hessian of more than {MAX_PARAMS} is too large for the driver")
    rows = fit.select(F.col(label_col).cast("int").alias("y"), F.col(vec_col).cast("array<double>").alias("x"))

    def sums(w: np.ndarray):
        def run(batches):
            import pandas as pd

            loss, g, h = np.zeros(1), np.zeros((1, n_classes, d)), np.zeros((1, size, size))
            for b in batches:
                for a in range(0, len(b), 4096):
                    part = b.iloc[a: a + 4096]
                    got = loss_sums(with_one(np.stack(part["x"].to_numpy()).astype(float)), part["y"].to_numpy().astype(int), w)
                    loss, g, h = loss + got[0], g + got[1], h + got[2]
            yield pd.DataFrame({"v": [np.concatenate([loss, g.ravel(), h.ravel()]).tobytes()]})

        def add(batches):
            import pandas as pd

            total = 0.0
            for b in batches:
                for v in b["v"]:
                    total = total + np.frombuffer(v)
            if not np.isscalar(total):
                yield pd.DataFrame({"v": [total.tobytes()]})

        parts, n = rows.mapInPandas(run, "v binary"), head["parts"] + 1
        while n > most:
            n = max(most, -(-n // 32))
            parts = parts.repartition(n).mapInPandas(add, "v binary")
        got = np.sum([np.frombuffer(r["v"]) for r in parts.collect()], axis=0)
        return got[:1], got[1: 1 + size].reshape(1, n_classes, d), got[1 + size:].reshape(1, size, size)

    most = max(1, DRIVER_BYTES // (8 * size * size))
    return newton(sums, np.zeros((1, n_classes, d)), np.array([float(head["n"])]), l2, tol)[0]


def linear_scores(df: DataFrame, weights: np.ndarray, vec_col: str = "diff", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Adds the class with the largest score (ties: the first) and its
    softmax probability; null where the vector is null."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    weights, names = np.asarray(weights), df.columns
    schema = T.StructType([*df.schema, T.StructField(pred, T.IntegerType()), T.StructField(prob, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            v = b.column(names.index(vec_col))
            ok = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            cls, p = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
            if len(ok):
                x = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(ok), -1)
                each = softmax(with_one(x.astype(float)) @ weights.T)
                cls[ok] = each.argmax(axis=1)
                p[ok] = each.max(axis=1)
            none = ~v.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls, mask=none), pa.array(p, mask=none)], names=[*names, pred, prob])

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- a grid of small fits

def nested_fits(x: np.ndarray, y: np.ndarray, rank: np.ndarray, shots: Sequence[int], runs: Sequence[int], n_classes: int,
                l2: float = L2) -> dict[int, np.ndarray]:
    """Weights (runs, classes, d + 1) for each shot count of one seed.

    ``run`` seeds the initial weights, as the reference's run index does; as
    the optimum is one, runs differ by less than the tolerance."""
    x = with_one(x)
    w = np.stack([np.random.default_rng(r).normal(0.0, 0.01, (n_classes, x.shape[1])) for r in runs])
    out = {}
    for m in sorted(shots):
        own = rank <= m
        xs, ys = x[own], y[own]
        w = newton(lambda w, xs=xs, ys=ys: loss_sums(xs, ys, w), w, np.full(len(runs), float(len(xs))), l2)
        out[m] = w
    return out


def fit_cells(fit_rows: DataFrame, shots: Sequence[int], runs: Sequence[int], n_classes: int = 3, vec_col: str = "diff",
              label_col: str = "label", l2: float = L2) -> DataFrame:
    """``(seed, m, run, weights)`` for every cell, from the ranked fit rows
    (seed, rank, label, vector); weights: classes rows of d + 1 values, flat.

    A seed's rows, at most classes * max(shots), are one group."""
    from ..session import ship_package

    ship_package(fit_rows.sparkSession)
    shots, runs = [int(m) for m in shots], [int(r) for r in runs]

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rank", label_col])
        fits = nested_fits(np.stack(pdf[vec_col].to_numpy()).astype(float), pdf[label_col].to_numpy().astype(int),
                           pdf["rank"].to_numpy(), shots, runs, n_classes, l2)
        return pd.DataFrame([{"seed": int(pdf["seed"].iloc[0]), "m": m, "run": r, "weights": fits[m][i].ravel()}
                             for m in shots for i, r in enumerate(runs)])

    return fit_rows.select("seed", "rank", label_col, vec_col).groupBy("seed").applyInPandas(
        train, "seed int, m int, run int, weights array<double>")


# ---------------------------------------------------------------- refinement before the prototypes

RIDGE = 1.0


def ridge_map(x: np.ndarray, y: np.ndarray, n_classes: int, ridge: float = RIDGE) -> np.ndarray:
    """(d, classes): the linear map that brings vectors nearest to their
    class's unit vector, in closed form, through the smaller of the two systems."""
    target = np.eye(n_classes)[y]
    if len(x) <= x.shape[1]:
        return x.T @ np.linalg.solve(x @ x.T + ridge * np.eye(len(x)), target)
    return np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ target)


def class_means(x: np.ndarray, y: np.ndarray, n_classes: int) -> np.ndarray:
    """One mean per class; NaN for a class without rows."""
    out = np.full((n_classes, x.shape[1]), np.nan)
    for k in np.unique(y):
        out[k] = x[y == k].mean(axis=0)
    return out


def refine_cells(fit_rows: DataFrame, shots: Sequence[int], n_classes: int = 3, vec_col: str = "diff", label_col: str = "label",
                 ridge: float = RIDGE) -> DataFrame:
    """``(seed, m, map, before, after)`` for every cell: the refinement fitted
    on the cell's rows (d * classes values), and the prototypes of the vectors
    as they are (classes * d) and refined (classes * classes), flat; a class
    without rows has NaN."""
    from ..session import ship_package

    ship_package(fit_rows.sparkSession)
    shots = [int(m) for m in shots]

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["rank", label_col])
        x, y = np.stack(pdf[vec_col].to_numpy()).astype(float), pdf[label_col].to_numpy().astype(int)
        rank, out = pdf["rank"].to_numpy(), []
        for m in shots:
            own = rank <= m
            to = ridge_map(x[own], y[own], n_classes, ridge)
            out.append({"seed": int(pdf["seed"].iloc[0]), "m": m, "map": to.ravel(), "before": class_means(x[own], y[own], n_classes).ravel(),
                        "after": class_means(x[own] @ to, y[own], n_classes).ravel()})
        return pd.DataFrame(out)

    return fit_rows.select("seed", "rank", label_col, vec_col).groupBy("seed").applyInPandas(
        train, "seed int, m int, map array<double>, before array<double>, after array<double>")
