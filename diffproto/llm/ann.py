"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to ``DIMS`` dimensions by a Gaussian (2-stable) matrix
and indexed by a kd-tree there.  A query meets the tree's leaves in order of
projected distance and verifies what they hold on the original vectors.  If
a vector lies at distance d, its squared projected distance over d^2 follows
a chi-square law with ``DIMS`` degrees of freedom; the search stops when the
next leaf is so far that a vector as near as the k-th best would lie beyond
it with a probability of at most 1 - ``CONFIDENCE``.

Largest inner product becomes nearest distance by one more coordinate:
sqrt(M^2 - |x|^2) for a vector, 0 for a query scaled to norm M, M being the
block's largest norm.

Shape: the top levels of one more kd-tree, fitted on a bounded sample, cut the
projected space into at most ``CELLS`` cells; every vector is indexed, in its
cell, and cells that hold too much are dealt into blocks.  A query first goes
to the cell nearest to it, and then, with the k-th best score from there, only
to the cells within the chi-square radius of that score.  Queries come in
chunks of bounded size, so a task holds one block and one chunk whatever the
table's size.  Blocks give their best k, and a window per query keeps k of them.
Of rows with equal vectors the k + 1 with the smallest ids go on, cut down in
each task before they are shuffled, and in a block they are one entry of the
tree, so a vector on a third of all rows costs no more than another.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import read, stored

K = 20
DIMS = 8  # even, for the closed form below
CONFIDENCE = 0.9
LEAF = 32
CELLS = 4096  # at most
SAMPLE = 1 << 16  # vectors that the cells are fitted on, about
BLOCK_BYTES = 4 << 20  # of a block's vectors, and of a chunk's queries: 8,192 of 64 components
SEED = 7


def chi2_cdf(x: float, dims: int) -> float:
    """Of the chi-square law with an even number of degrees of freedom."""
    h, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= h / i
        total += term
    return 1 - math.exp(-h) * total


def chi2_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of at most ``LEAF`` points: an order of the points, the leaves'
    bounds in it and their boxes.  Halves at the median of the widest side;
    equal points are halved all the same."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        starts, ends = [], []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                starts.append(a)
                ends.append(b)
                continue
            own = points[self.order[a:b]]
            side = int(np.argmax(own.max(0) - own.min(0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        self.start, self.end = np.array(starts), np.array(ends)
        self.lo = np.array([points[self.order[a:b]].min(0) for a, b in zip(starts, ends, strict=True)])
        self.hi = np.array([points[self.order[a:b]].max(0) for a, b in zip(starts, ends, strict=True)])

    def near(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their box to ``q``, and these distances."""
        gap = np.maximum(0, np.maximum(self.lo - q, q - self.hi))
        d = np.einsum("ij,ij->i", gap, gap)
        by = np.argsort(d, kind="stable")
        return by, d[by]


def search_block(ids: np.ndarray, vecs: np.ndarray, qids: np.ndarray, qs: np.ndarray, k: int = K, dims: int = DIMS,
                 confidence: float = CONFIDENCE, seed: int = SEED, floor: np.ndarray | None = None):
    """For each query the block's best ``k``: lists (query row, ids, scores) and the share of vectors verified.
    ``floor``: the score of the k-th best that each query has already."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], np.ascontiguousarray(vecs[order])
    raw = vecs.view([("", np.void, vecs.shape[1] * 8)]).ravel() if vecs.shape[1] else np.zeros(len(vecs))
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    base = vecs[first]
    members = np.argsort(inverse, kind="stable")  # by entry, then by id
    begin = np.searchsorted(inverse[members], np.arange(len(base) + 1))
    norm2 = np.einsum("ij,ij->i", base, base)
    top2 = norm2.max()
    more = np.sqrt(np.maximum(0, top2 - norm2))
    gauss = np.random.default_rng(seed).standard_normal((base.shape[1] + 1, dims))
    tree = KdTree(base @ gauss[:-1] + more[:, None] * gauss[-1])
    packed = base[tree.order]
    stop = chi2_quantile(confidence, dims)
    scale = math.sqrt(top2)
    want = k + 1  # the query itself may be among them
    out, verified = [], 0
    for row, (qid, q) in enumerate(zip(qids, qs, strict=True)):
        grow = scale / math.sqrt(float(q @ q))
        leaves, far = tree.near((q * grow) @ gauss[:-1])
        at, step = 0, 4
        score = np.empty(0)
        pos = np.empty(0, dtype=np.int64)
        known = -math.inf if floor is None else floor[row]
        if known > -math.inf and far[0] > stop * max(0.0, 2 * top2 - 2 * grow * known):
            continue
        while at < len(leaves):
            chosen = leaves[at: at + step]
            new = np.concatenate([np.arange(tree.start[x], tree.end[x]) for x in chosen])
            verified += len(new)
            score, pos = np.concatenate([score, packed[new] @ q]), np.concatenate([pos, new])
            at += step
            step = min(step * 2, 16)
            edge = known
            if len(score) > want:
                # ties at the edge all stay
                edge = np.partition(score, len(score) - want)[len(score) - want]
                keep = score >= edge - 1e-9 * max(1.0, abs(edge))
                score, pos = score[keep], pos[keep]
                edge = max(edge, known)
            if edge > -math.inf and at < len(leaves) and far[at] > stop * max(0.0, 2 * top2 - 2 * grow * edge):
                break
        entries = tree.order[pos]
        exact = (base[entries] * q).sum(axis=1)
        got_ids, got_scores = [], []
        for e, s in zip(entries, exact, strict=True):
            own = ids[members[begin[e]: begin[e + 1]]]
            own = np.unique(own[own != qid])[:k]
            got_ids.append(own)
            got_scores.append(np.full(len(own), s))
        i, s = np.concatenate(got_ids), np.concatenate(got_scores)
        best = np.lexsort((i, -s))[:k]
        out.append((row, i[best], s[best]))
    return out, verified / max(1, len(base) * len(qids))


class Cells:
    """The top levels of a kd-tree over a sample of projected vectors: at most
    ``most`` cells, halved at the median of the widest side."""

    def __init__(self, points: np.ndarray, most: int):
        self.axis, self.value, self.left, self.right = [-1], [0.0], [0], [0]
        self.cell, todo, n = [0], [(0, np.arange(len(points)))], 1
        while todo and n < most:  # breadth first, so cells are about equal
            node, own = todo.pop(0)
            if len(own) < 2:
                continue
            x = points[own]
            side = int(np.argmax(x.max(0) - x.min(0)))
            cut = float(np.median(x[:, side]))
            low = x[:, side] < cut
            if low.all() or not low.any():
                continue
            kids = []
            for part in (own[low], own[~low]):
                self.axis.append(-1), self.value.append(0.0), self.left.append(0), self.right.append(0)
                self.cell.append(self.cell[node] if not kids else n)
                kids.append(len(self.axis) - 1)
                todo.append((kids[-1], part))
            n += 1
            self.axis[node], self.value[node], self.left[node], self.right[node] = side, cut, *kids
        self.n = n
        self.axis, self.value, self.left, self.right, self.cell = map(np.array, (self.axis, self.value, self.left, self.right, self.cell))

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while len(go := np.flatnonzero(self.axis[node] >= 0)):
            at = node[go]
            right = points[go, self.axis[at]] >= self.value[at]
            node[go] = np.where(right, self.right[at], self.left[at])
        return self.cell[node]


def _projected(vecs, top2: float, dims: int, query: bool) -> np.ndarray:
    """Projections of vectors of any lengths; a query is scaled to norm sqrt(top2)."""
    out = np.zeros((len(vecs), dims))
    size = np.array([len(v) for v in vecs])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.stack([vecs[i] for i in at]).astype(float)
        norm2 = np.einsum("ij,ij->i", x, x)
        gauss = np.random.default_rng(SEED).standard_normal((d + 1, dims))
        if query:
            out[at] = (x * np.sqrt(top2 / norm2)[:, None]) @ gauss[:-1]
        else:
            out[at] = x @ gauss[:-1] + np.sqrt(np.maximum(0, top2 - norm2))[:, None] * gauss[-1]
    return out


def usable(vec: Column) -> Column:
    """Not null, not empty, not all zero, and every component finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(base: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = K,
            dims: int = DIMS, confidence: float = CONFIDENCE, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` vectors found
    with the largest inner product, ties to the smaller id, itself (by id)
    left out.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part.  Rows equal in id and vector count
    once; a query is compared with vectors of its own length only.  With
    fewer than ``k`` candidates all are returned; empty tables give an empty
    result.  Other columns are ignored."""
    spark = base.sparkSession
    ship_package(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    # of rows with equal vectors only the smallest ids can be returned, the query's own being one more
    same = Window.partitionBy("v").orderBy("id")
    b = stored(pick(base).distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n"), "base")
    q = stored(pick(queries).distinct(), "queries")
    # the numbers of blocks and chunks follow from the data alone
    fits = BLOCK_BYTES // (8 * max(1, b.agg(F.coalesce(F.max("dim"), F.lit(1))).first()[0])) or 1
    n_blocks, n_chunks = (max(1, -(-df.count() // (most or fits))) for df, most in ((b, block), (q, chunk)))
    top2 = b.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    if not top2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    @F.pandas_udf("array<double>")
    def project(v):
        return pd.Series(list(_projected(v.to_numpy(), top2, dims, False)))

    @F.pandas_udf("int")
    def cell_of(p):
        return pd.Series(cells.of(np.stack(p.to_numpy())).astype("int32"))

    b = stored(b.withColumn("p", project("v")), "projected")
    share = min(1.0, SAMPLE / b.count())
    sample = b.filter(F.pmod(F.xxhash64(F.lit("s"), "id", "v"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * SAMPLE).select("p").collect()
    cells = Cells(np.array([r["p"] for r in sample]).reshape(-1, dims), min(CELLS, n_blocks))
    placed = b.withColumn("cell", cell_of("p"))
    ends = [f(F.get("p", i)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect())  # a row per cell
    numbers = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{n}{i}"] for i in range(dims)] for r in boxes]) for n in ("lo", "hi"))
    parts = F.broadcast(spark.createDataFrame([(r["cell"], -(-r["n"] // (block or fits))) for r in boxes], "cell int, parts int"))
    placed = placed.drop("p").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit("b"), "id", "v"), F.col("parts")).cast("int")).drop("parts")
    asked = stored(q.withColumn("qkey", F.monotonically_increasing_id()).withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit("q"), "id", "v"), F.lit(n_chunks)).cast("int")), "asked")
    stop = chi2_quantile(confidence, dims)

    @F.pandas_udf("array<int>")
    def route(v, known):
        """The nearest cell of a query that knows nothing yet; else the other cells within its radius."""
        p = _projected(v.to_numpy(), top2, dims, True)
        out = []
        for x, own, k_best in zip(p, v, known, strict=True):
            gap = np.maximum(0, np.maximum(low - x, x - high))
            d = np.einsum("ij,ij->i", gap, gap)
            home = int(np.argmin(d))
            if pd.isna(k_best):
                out.append(numbers[[home]])
                continue
            grow = math.sqrt(top2 / float(np.dot(own, own)))
            near = d <= stop * max(0.0, 2 * top2 - 2 * grow * k_best)
            near[home] = False
            out.append(numbers[near])
        return pd.Series(out)

    keys = ["dim", "cell", "part", "chunk"]
    left = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": [], "query_id": [], "vec_id": [], "score": []}).astype({"qkey": "int64", "query_id": "int64", "vec_id": "int64"})
        if not len(vectors) or not len(asked):
            return empty
        found, _ = search_block(
            vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(float),
            asked["id"].to_numpy(), np.stack(asked["v"].to_numpy()).astype(float), k, dims, confidence,
            floor=asked["known"].fillna(-math.inf).to_numpy(dtype=float),
        )
        if not found:
            return empty
        qid, qkey = asked["id"].to_numpy(), asked["qkey"].to_numpy()
        return pd.DataFrame({
            "qkey": np.concatenate([np.full(len(i), qkey[r]) for r, i, _ in found]).astype("int64"),
            "query_id": np.concatenate([np.full(len(i), qid[r]) for r, i, _ in found]).astype("int64"),
            "vec_id": np.concatenate([i for _, i, _ in found]).astype("int64"),
            "score": np.concatenate([s for _, _, s in found]),
        })

    def search(queries: DataFrame) -> DataFrame:
        """``queries`` with ``known``, the k-th best score so far (null: none yet), in the cells where they are sent."""
        sent = queries.withColumn("cell", F.explode(route("v", "known"))).join(parts, "cell").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return left.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, "qkey long, query_id long, vec_id long, score double")

    first = stored(search(asked.withColumn("known", F.lit(None).cast("double"))), "first")
    place_of = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("r", F.row_number().over(place_of)).filter(F.col("r") == k).select("qkey", F.col("score").alias("known"))
    # a query with fewer than k candidates at home goes everywhere
    rest = search(asked.join(kth, "qkey", "left").withColumn("known", F.coalesce("known", F.lit(-1.0e308))))
    found = first.unionByName(rest)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.v, b.v) AS score
  FROM e q JOIN e b ON q.vec_id <> b.vec_id AND len(q.v) = len(b.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
