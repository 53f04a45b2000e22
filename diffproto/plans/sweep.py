"""Parameter sweep (encoder x seed x shots) as one Spark plan.

The reference launches one process per grid cell, each re-reading and
re-encoding the data.  Here:

1. ranks: the first max(m) keys (or the largest cap) of each (seed, class),
   ranked in hash buckets -- at most seeds * classes * max(m) rows, a proven
   bound.
2. prototypes: the ranked fit keys are expanded over the m grid with a
   generator (``rank <= m``), joined to their difference vectors (broadcast
   of the bounded key side) and averaged per (encoder, seed, m, class,
   position).
3. scoring: all cells' prototypes are packed into one row per encoder
   (cells * classes * d doubles, checked) and every pair is scored against
   every cell in one ``transform``; the pair's own fit ranks (a map
   seed -> rank, bounded) say in which cells it is a dev row.  Pairs are read
   once; nothing multiplies them except the generator over cells.
4. counts: ``groupBy(encoder, seed, m, truth, pred).count()`` with map-side
   partial aggregation -- at most cells * L * L rows leave each task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import THREE_WAY_LETTERS, decode_three
from ..operators import evaluate
from ..operators.prototypes import argmax_label, mean_vectors
from ..operators.sampling import KEY, top_per_class
from ..session import scratch_table, ship_package
from .broadcast import bounded_broadcast, broadcast_limit, fits_broadcast

BIG_RANK = 2 ** 31 - 1
# The reference sweep grid.
REFERENCE_SEEDS = [123, 124, 125, 126, 127, 128, 129, 130, 131, 132]
REFERENCE_SHOTS = [2, 4, 6, 8, 10, 20, 30, 40, 50, 100]


def _grid_key(encoder_col: str | None) -> list[str]:
    return [encoder_col] if encoder_col else []


def ranked_keys(pairs: DataFrame, seeds: Sequence[int], n: int, key: Sequence[str] = KEY,
                label_col: str = "label", caps: dict[int, int] | None = None,
                encoder_col: str | None = None) -> DataFrame:
    """``(seed, *key, label, rank)`` for rank <= n (or <= cap(label))."""
    keys = pairs.select(*key, label_col)
    if encoder_col:
        keys = keys.dropDuplicates(list(key))
    top = top_per_class(keys, list(seeds), n, (label_col,), key)
    if caps:
        cap_col = None
        for code, cap in caps.items():
            cond = F.col(label_col) == F.lit(code)
            cap_col = F.when(cond, F.lit(cap)) if cap_col is None else cap_col.when(cond, F.lit(cap))
        missing = F.raise_error(F.concat(F.lit("no cap for class "), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
        top = top.filter(F.col("rank") <= cap_col.otherwise(missing))
    return top


def cell_prototypes(pairs: DataFrame, ranked: DataFrame, shots: Sequence[int], key: Sequence[str] = KEY,
                    label_col: str = "label", vec_col: str = "diff",
                    encoder_col: str | None = None, n_seeds: int = 1, n_classes: int = 3) -> DataFrame:
    """``(encoder?, seed, m, label, n, centroid)`` for every grid cell."""
    ms = F.array(*[F.lit(int(m)) for m in shots])
    fit = (ranked.select("seed", *key, "rank", F.explode(ms).alias("m"))
           .filter(F.col("rank") <= F.col("m")).drop("rank"))
    bound = n_seeds * n_classes * sum(int(m) for m in shots)
    fit = bounded_broadcast(fit, bound, 48)
    vecs = pairs.select(*_grid_key(encoder_col), *key, label_col, vec_col)
    joined = vecs.join(fit, list(key))
    return mean_vectors(joined, [*_grid_key(encoder_col), "seed", "m", label_col], vec_col, "centroid")


def vector_length(pairs: DataFrame, vec_col: str) -> int:
    """Length of the vectors, read from one row; ``same_length`` holds every row to it."""
    row = pairs.select(F.size(vec_col).alias("d")).filter("d >= 0").first()
    return row["d"] if row else 0


def same_length(vec_col: str, dim: int):
    """The vector, or an error if its length is not ``dim``: the size that was checked before broadcasting."""
    return F.when(F.size(vec_col) == dim, F.col(vec_col)).otherwise(F.raise_error(
        F.concat(F.lit(f"vector length is not {dim}: "), F.size(vec_col).cast("string"))))


def pack_cells(protos: DataFrame, encoder_col: str | None = None, label_col: str = "label") -> DataFrame:
    per_cell = (protos.groupBy(*_grid_key(encoder_col), "seed", "m")
                .agg(F.array_sort(F.collect_list(F.struct(
                    F.col(label_col).cast("int").alias("proto_id"), F.col(label_col).alias("label"),
                    F.col("centroid")))).alias("protos")))
    return per_cell.groupBy(*_grid_key(encoder_col)).agg(
        F.array_sort(F.collect_list(F.struct("seed", "m", "protos"))).alias("cells"))


def score_cells(pairs: DataFrame, seeds: Sequence[int], shots: Sequence[int], metric: str = "euclidean",
                key: Sequence[str] = KEY, label_col: str = "label", vec_col: str = "diff",
                encoder_col: str | None = None, caps: dict[int, int] | None = None,
                dim: int | None = None, n_encoders: int = 1, n_classes: int = 3,
                split: str = "dev") -> DataFrame:
    """One row per (pair, cell) where the pair is a dev row of the cell (or a
    fit row with ``split='fit'``): ``(encoder?, seed, m, *key, truth, pred)``."""
    seeds = [int(s) for s in seeds]
    shots = [int(m) for m in shots]
    n = max(caps.values()) if caps else max(shots)
    ranked = ranked_keys(pairs, seeds, n, key, label_col, caps, encoder_col)
    fit_ranked = ranked.filter(F.col("rank") <= max(shots)) if caps else ranked
    protos = cell_prototypes(pairs, fit_ranked, shots, key, label_col, vec_col, encoder_col,
                             len(seeds), n_classes)
    packed = pack_cells(protos, encoder_col, label_col)

    rank_rows = len(seeds) * (sum(caps.values()) if caps else n_classes * max(shots))
    rank_map = (ranked.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("seed", "rank"))).alias("_ranks")))
    rank_map = bounded_broadcast(rank_map, rank_rows, 64 + 16 * len(seeds))
    how = "inner" if caps else "left"
    base = pairs.join(rank_map, list(key), how)

    if encoder_col:
        cell_bytes = len(seeds) * len(shots) * n_classes * (8 * (dim or vector_length(pairs, vec_col)) + 32)
        packed = bounded_broadcast(packed.withColumnRenamed("cells", "_cells"), n_encoders, cell_bytes)
        base = base.join(packed, encoder_col, "left")
        base = base.withColumn("_cells", F.coalesce("_cells", F.raise_error(F.concat(
            F.lit("no prototypes for encoder "), F.col(encoder_col).cast("string")))))
    else:
        base = base.withColumn("_cells", packed.select("cells").scalar())

    def member(c):
        r = F.element_at(F.col("_ranks"), c["seed"])
        if split == "fit":
            return r.isNotNull() & (r <= c["m"])
        if caps:
            return r.isNotNull() & (r > c["m"])
        return F.coalesce(r, F.lit(BIG_RANK)) > c["m"]

    vec = F.col(vec_col)

    def predict_cell(c):
        return F.struct(c["seed"].alias("seed"), c["m"].alias("m"),
                        argmax_label(vec, c["protos"], metric).alias("pred"))

    cells = F.transform(F.filter(F.col("_cells"), member), predict_cell)
    return (base.select(*_grid_key(encoder_col), *key, F.col(label_col).alias("truth"),
                        F.explode(cells).alias("_c"))
            .select(*_grid_key(encoder_col), F.col("_c.seed").alias("seed"), F.col("_c.m").alias("m"),
                    *key, "truth", F.col("_c.pred").alias("pred")))


def sweep_counts(pairs: DataFrame, seeds: Sequence[int], shots: Sequence[int], metric: str = "euclidean",
                 encoder_col: str | None = None, letters: Sequence[str] = THREE_WAY_LETTERS,
                 engine: str = "numpy", **kw) -> DataFrame:
    """Confusion counts per cell, long form, zero cells kept:
    ``(encoder?, seed, m, y_truth, y_pred, n)``.

    ``engine='numpy'`` scores Arrow batches with one matrix product per batch
    (fast for any grid); ``engine='sql'`` keeps everything in JVM expressions
    (higher-order functions, interpreted per element: fine for small grids).
    Ranking reads keys only and the prototypes only the fit rows, so the pair
    table's vectors are computed once, while scoring; it is not stored."""
    if engine == "numpy":
        kw["dim"] = kw.get("dim") or vector_length(pairs, kw.get("vec_col", "diff"))
        counts = None
        for some_seeds, some_shots in cell_groups(pairs.sparkSession, seeds, shots, kw["dim"], kw.get("n_encoders", 1),
                                                  kw.get("n_classes", 3)):
            part = score_counts_numpy(pairs, some_seeds, some_shots, metric, encoder_col=encoder_col, **kw)
            counts = part if counts is None else counts.unionByName(part)
    elif engine == "sql":
        scored = score_cells(pairs, seeds, shots, metric, encoder_col=encoder_col, **kw)
        counts = scored.groupBy(*_grid_key(encoder_col), "seed", "m", "truth", "pred").agg(
            F.count(F.lit(1)).alias("n"))
    else:
        raise ValueError(f"unknown engine {engine!r}")
    named = counts.select(*_grid_key(encoder_col), "seed", "m",
                          decode_three("truth").alias("y_truth"), decode_three("pred").alias("y_pred"), "n")
    group = [*_grid_key(encoder_col), "seed", "m"]
    # expand to the full label grid; the counts are already tiny
    return _expand_counts(named, group, letters)


def cell_groups(spark, seeds: Sequence[int], shots: Sequence, dim: int, n_encoders: int = 1,
                n_classes: int = 3) -> list[tuple[list[int], list]]:
    """Split the grid into (seeds, shots) blocks whose prototype pack
    (encoders * cells * classes * d doubles) fits the broadcast limit.  One
    block is the normal case; a larger grid is scored in several passes over
    the pairs, down to one cell at a time, never with an unchecked broadcast."""
    per_cell = n_encoders * n_classes * (8 * dim + 32)
    k = max(1, broadcast_limit(spark) // max(1, per_cell))
    seeds, shots = [int(x) for x in seeds], list(shots)
    if k >= len(shots):
        step = k // len(shots)
        return [(seeds[i:i + step], shots) for i in range(0, len(seeds), step)]
    return [([s], shots[i:i + k]) for s in seeds for i in range(0, len(shots), k)]


def _expand_counts(named: DataFrame, group: list[str], letters: Sequence[str]) -> DataFrame:
    return evaluate.expand_grid(named, letters, group)


def sweep_summary(conf: DataFrame, group: Sequence[str], letters: Sequence[str] = THREE_WAY_LETTERS) -> DataFrame:
    """Per cell: accuracy, F1 of each label (columns ``f1_<letter>``) and macro
    F1 -- one aggregation over the confusion counts."""
    return evaluate.cell_metrics(conf, group, letters)


# ------------------------------------------------------------------ vectorised scoring

def _pack_arrays(rows, encoder_col, seeds, n_classes):
    """Driver-side: the bounded prototype pack -> numpy arrays per encoder."""
    import numpy as np

    seed_idx = {s: i for i, s in enumerate(seeds)}
    packs = {}
    for r in rows:
        enc = r[encoder_col] if encoder_col else None
        cells = r["cells"]
        d = len(cells[0]["protos"][0]["centroid"])
        c_seed = np.array([seed_idx[c["seed"]] for c in cells], dtype=np.int64)
        c_m = np.array([c["m"] for c in cells], dtype=np.int64)
        protos = np.full((len(cells), n_classes, d), np.nan)
        present = np.zeros((len(cells), n_classes), dtype=bool)
        for i, c in enumerate(cells):
            for p in c["protos"]:
                protos[i, p["label"]] = np.asarray(p["centroid"], dtype=np.float64)
                present[i, p["label"]] = True
        packs[enc] = (c_seed, c_m, protos, present)
    return packs


def _score_batch(x, truth, ranks, pack, metric, split, capped, n_classes, max_elems: int = 4_000_000):
    """Counts of (cell, truth, pred) for one Arrow batch (numpy), scored in
    row chunks so the (rows x cells x classes) similarity block stays near
    ``max_elems`` doubles whatever the grid size."""
    import numpy as np

    n_cells = len(pack[1])
    step = max(1, max_elems // max(1, n_cells * n_classes))
    if len(x) > step:
        total = np.zeros(n_cells * n_classes * n_classes, dtype=np.int64)
        for i in range(0, len(x), step):
            cell, t, p, cnt = _score_batch(x[i:i + step], truth[i:i + step], ranks[i:i + step], pack,
                                           metric, split, capped, n_classes, max_elems)
            np.add.at(total, (cell * n_classes + t) * n_classes + p, cnt)
        nz = np.nonzero(total)[0]
        return nz // (n_classes * n_classes), (nz // n_classes) % n_classes, nz % n_classes, total[nz]

    c_seed, c_m, protos, present = pack
    n_cells = len(c_m)
    flat = protos.reshape(n_cells * n_classes, -1)
    if metric == "euclidean":
        xx = np.einsum("ij,ij->i", x, x)[:, None]
        pp = np.nansum(flat * flat, axis=1)[None, :]
        d2 = np.maximum(xx - 2.0 * (x @ np.nan_to_num(flat).T) + pp, 0.0)
        sims = 1.0 - np.sqrt(d2)
    else:
        nx = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        npp = np.sqrt(np.nansum(flat * flat, axis=1))[None, :]
        den = nx * npp
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = np.where(den == 0, np.nan, (x @ np.nan_to_num(flat).T) / np.where(den == 0, 1.0, den))
    sims = sims.reshape(len(x), n_cells, n_classes)
    sims = np.where(present[None, :, :], sims, -np.inf)
    pred = np.argmax(sims, axis=2)                      # first maximum; NaN wins as in numpy
    r = ranks[:, c_seed]                                  # rank of each row in each cell's seed
    m = c_m[None, :]
    if split == "fit":
        member = r <= m
    elif capped:
        member = (r > m) & (r < BIG_RANK)
    else:
        member = r > m
    rows, cells = np.nonzero(member)
    code = (cells * n_classes + truth[rows]) * n_classes + pred[rows, cells]
    counts = np.bincount(code, minlength=n_cells * n_classes * n_classes)
    nz = np.nonzero(counts)[0]
    cell = nz // (n_classes * n_classes)
    return cell, (nz // n_classes) % n_classes, nz % n_classes, counts[nz]


def score_counts_numpy(pairs: DataFrame, seeds: Sequence[int], shots: Sequence[int], metric: str = "euclidean",
                       key: Sequence[str] = KEY, label_col: str = "label", vec_col: str = "diff",
                       encoder_col: str | None = None, caps: dict[int, int] | None = None,
                       dim: int | None = None, n_encoders: int = 1, n_classes: int = 3,
                       split: str = "dev", ranked: DataFrame | None = None) -> DataFrame:
    """Per-cell ``(encoder?, seed, m, truth, pred, n)`` counts, scored with
    numpy on Arrow batches (``mapInPandas``).  ``ranked`` may pass ranks
    already computed by ``ranked_keys`` for these seeds (shared by several
    sweeps over the same keys).

    The prototype pack is bounded by encoders * cells * classes * d doubles,
    and ``cell_groups`` sizes the grid by it; it is collected once and
    broadcast to the executors.  Each batch is scored against every cell with one matrix
    product and leaves the task as at most cells * L * L counts, summed by a
    partial/final aggregate.
    """
    import numpy as np

    from pyspark.sql import types as T

    seeds = [int(s) for s in seeds]
    shots = [int(m) for m in shots]
    spark = pairs.sparkSession
    ship_package(spark)
    dim = dim or vector_length(pairs, vec_col)
    n = max(caps.values()) if caps else max(shots)
    # the ranked keys (bounded: seeds * sum(caps) or seeds * classes * max(m))
    # feed both the prototypes and the scoring pass: written once to the
    # shared folder instead of ranking the whole pair table twice
    if ranked is None:
        ranked = scratch_table(ranked_keys(pairs, seeds, n, key, label_col, caps, encoder_col), "ranked")
    else:
        ranked = ranked.filter(F.col("seed").isin(seeds))
    fit_ranked = ranked.filter(F.col("rank") <= max(shots)) if caps else ranked
    protos = cell_prototypes(pairs, fit_ranked, shots, key, label_col, vec_col, encoder_col,
                             len(seeds), n_classes)
    packed_rows = pack_cells(protos, encoder_col, label_col).collect()
    packs = _pack_arrays(packed_rows, encoder_col, seeds, n_classes)
    bc = spark.sparkContext.broadcast(packs)

    rank_rows = len(seeds) * (sum(caps.values()) if caps else n_classes * max(shots))
    rank_map = (ranked.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("seed", "rank"))).alias("_ranks")))
    rank_map = bounded_broadcast(rank_map, rank_rows, 64 + 16 * len(seeds))
    base = pairs.join(rank_map, list(key), "inner" if caps else "left")
    ranks_arr = F.array(*[F.coalesce(F.element_at(F.col("_ranks"), F.lit(s)), F.lit(BIG_RANK)) for s in seeds])
    base = base.select(*_grid_key(encoder_col), F.col(label_col).cast("int").alias("truth"),
                       same_length(vec_col, dim).alias("vec"), ranks_arr.alias("ranks"))

    enc_field = [T.StructField(encoder_col, pairs.schema[encoder_col].dataType)] if encoder_col else []
    schema = T.StructType(enc_field + [
        T.StructField("seed", T.IntegerType()), T.StructField("m", T.IntegerType()),
        T.StructField("truth", T.IntegerType()), T.StructField("pred", T.IntegerType()),
        T.StructField("n", T.LongType())])
    capped = bool(caps)

    def run(batches):
        import pandas as pd

        all_packs = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            groups = pdf.groupby(encoder_col, sort=False) if encoder_col else [(None, pdf)]
            for enc, g in groups:
                pack = all_packs.get(enc)
                if pack is None:
                    raise ValueError(f"no prototypes for encoder {enc!r}: it has pairs but no fit rows")
                x = np.stack(g["vec"].to_numpy()).astype(np.float64)
                truth = g["truth"].to_numpy().astype(np.int64)
                ranks = np.stack(g["ranks"].to_numpy()).astype(np.int64)
                cell, t, p, cnt = _score_batch(x, truth, ranks, pack, metric, split, capped, n_classes)
                out = pd.DataFrame({"seed": np.asarray(seeds, dtype=np.int32)[pack[0][cell]],
                                    "m": pack[1][cell].astype(np.int32), "truth": t.astype(np.int32),
                                    "pred": p.astype(np.int32), "n": cnt.astype(np.int64)})
                if encoder_col:
                    out.insert(0, encoder_col, enc)
                yield out

    scored = base.mapInPandas(run, schema)
    return scored.groupBy(*_grid_key(encoder_col), "seed", "m", "truth", "pred").agg(F.sum("n").alias("n"))


def sweep_baseline(pairs: DataFrame, seeds: Sequence[int], shots: Sequence[int], runs: Sequence[int] = (1,),
                   key: Sequence[str] = KEY, label_col: str = "label", vec_col: str = "diff",
                   n_classes: int = 3, dim: int | None = None) -> DataFrame:
    """Supervised baseline over the grid (seed x m x run): confusion counts
    ``(seed, m, run, y_truth, y_pred, n)`` of the dev rows, zero cells kept;
    ``sweep_summary`` makes metrics of them.

    The ranked fit rows (at most classes * max(m) a seed) are fitted in one
    group per seed, runs stacked and shot counts warm-started along their
    nesting; the models (bounded by cells * classes * (d + 1) doubles,
    checked) are broadcast and every pair is scored against every cell in
    Arrow batches.  A grid whose models do not fit the broadcast limit is run
    in several passes."""
    from ..operators.baseline import fit_cells, with_one

    runs = [int(r) for r in runs]
    dim = dim or vector_length(pairs, vec_col)

    def scorer(models):
        import numpy as np

        w = np.array([r["weights"] for r in models], dtype=np.float64).reshape(len(models), n_classes, dim + 1)
        return lambda x: [("dev", r["run"], r["seed"], r["m"], p) for r, p in zip(
            models, (with_one(x) @ w.reshape(-1, dim + 1).T).reshape(len(x), len(models), n_classes).argmax(axis=2).T, strict=True)]

    counts = None
    # all runs of a (seed, m) go together: a cell's models are runs * classes * (d + 1) doubles
    for some_seeds, some_shots in cell_groups(pairs.sparkSession, seeds, shots, dim + 1, len(runs), n_classes):
        part = _fitted_counts(pairs, some_seeds, some_shots, key, label_col, vec_col, n_classes, dim,
                              lambda fit, shots=some_shots: fit_cells(fit, shots, runs, n_classes, vec_col, label_col), scorer)
        counts = part if counts is None else counts.unionByName(part)
    named = counts.select("seed", "m", F.col("variant").alias("run"), decode_three("truth").alias("y_truth"),
                          decode_three("pred").alias("y_pred"), "n")
    return _expand_counts(named, ["seed", "m", "run"], THREE_WAY_LETTERS)


#: Variants of ``before_after_counts``.
PHASES = ("before", "after")


def before_after_counts(pairs: DataFrame, seeds: Sequence[int], shots: Sequence[int], key: Sequence[str] = KEY,
                        label_col: str = "label", vec_col: str = "diff", n_classes: int = 3, dim: int | None = None) -> DataFrame:
    """Prototypes before and after a fit, on the same cells:
    ``(phase, split, seed, m, y_truth, y_pred, n)``, zero cells kept.

    After: the vectors go through the cell's own linear refinement (closed
    form, ``baseline.refine_cells``) before prototypes are made and compared.
    One pass over the pairs scores both phases on fit rows (``train``) and dev
    rows (``dev``)."""
    from ..operators.baseline import refine_cells

    dim = dim or vector_length(pairs, vec_col)

    def scorer(models):
        import numpy as np

        def nearest(z, protos):
            d2 = (z ** 2).sum(axis=1)[:, None] - 2 * z @ np.nan_to_num(protos).T + np.nansum(protos ** 2, axis=1)[None]
            return np.where(np.isnan(protos[:, 0])[None], np.inf, d2).argmin(axis=1)

        def score(x):
            out = []
            for r in models:
                to = np.reshape(r["map"], (dim, n_classes))
                for k, (z, name) in enumerate(((x, "before"), (x @ to, "after"))):
                    pred = nearest(z, np.reshape(r[name], (n_classes, -1)))
                    out += [(split, k, r["seed"], r["m"], pred) for split in ("train", "dev")]
            return out

        return score

    counts = None
    # a cell holds its map, as many values again as prototypes, and a few more
    for some_seeds, some_shots in cell_groups(pairs.sparkSession, seeds, shots, dim + n_classes, 2, n_classes):
        part = _fitted_counts(pairs, some_seeds, some_shots, key, label_col, vec_col, n_classes, dim,
                              lambda fit, shots=some_shots: refine_cells(fit, shots, n_classes, vec_col, label_col), scorer)
        counts = part if counts is None else counts.unionByName(part)
    named = counts.select(F.element_at(F.array(*[F.lit(p) for p in PHASES]), F.col("variant") + 1).alias("phase"), "split", "seed", "m",
                          decode_three("truth").alias("y_truth"), decode_three("pred").alias("y_pred"), "n")
    return _expand_counts(named, ["phase", "split", "seed", "m"], THREE_WAY_LETTERS)


def _fitted_counts(pairs: DataFrame, seeds: list[int], shots: list[int], key: Sequence[str], label_col: str, vec_col: str,
                   n_classes: int, dim: int, fit_models, scorer) -> DataFrame:
    """``(split, variant, seed, m, truth, pred, n)`` of one block of the grid.

    ``fit_models`` makes a bounded table of models of the ranked fit rows
    (seed, rank, label, vector).  ``scorer(models)`` gives a function of a batch of
    vectors: for each column to count (split, variant, seed, m, predictions)."""
    import numpy as np

    spark = pairs.sparkSession
    ship_package(spark)
    # bounded by seeds * classes * max(m) rows; feeds the fits and the scoring
    ranked = scratch_table(ranked_keys(pairs, seeds, max(shots), key, label_col), "ranked")
    fit_keys = bounded_broadcast(ranked.select("seed", *key, "rank"), len(seeds) * n_classes * max(shots), 48)
    fit = pairs.select(*key, label_col, same_length(vec_col, dim).alias(vec_col)).join(fit_keys, list(key))
    models = sorted(fit_models(fit).collect(), key=lambda r: (r["seed"], r["m"]))
    bc = spark.sparkContext.broadcast([r.asDict() for r in models])

    rank_map = (ranked.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("seed", "rank"))).alias("_ranks")))
    rank_map = bounded_broadcast(rank_map, len(seeds) * n_classes * max(shots), 64 + 16 * len(seeds))
    ranks_arr = F.array(*[F.coalesce(F.element_at(F.col("_ranks"), F.lit(s)), F.lit(BIG_RANK)) for s in seeds])
    base = (pairs.join(rank_map, list(key), "left")
            .select(F.col(label_col).cast("int").alias("truth"), same_length(vec_col, dim).alias("vec"), ranks_arr.alias("ranks")))
    at = {s: i for i, s in enumerate(seeds)}

    def run(batches):
        import pandas as pd

        score = scorer(bc.value)
        for pdf in batches:
            for a in range(0, len(pdf), 2048):
                part = pdf.iloc[a: a + 2048]
                truth, ranks = part["truth"].to_numpy().astype(np.int64), np.stack(part["ranks"].to_numpy()).astype(np.int64)
                out = []
                for split, variant, seed, m, pred in score(np.stack(part["vec"].to_numpy()).astype(np.float64)):
                    own = ranks[:, at[seed]] <= m
                    code = (truth * n_classes + pred)[own if split == "train" else ~own]
                    n = np.bincount(code, minlength=n_classes * n_classes)
                    out += [(split, variant, seed, m, c // n_classes, c % n_classes, n[c]) for c in np.flatnonzero(n)]
                yield pd.DataFrame(out, columns=["split", "variant", "seed", "m", "truth", "pred", "n"])

    return (base.mapInPandas(run, "split string, variant int, seed int, m int, truth int, pred int, n long")
            .groupBy("split", "variant", "seed", "m", "truth", "pred").agg(F.sum("n").alias("n")))
