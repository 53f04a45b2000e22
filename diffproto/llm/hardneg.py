"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are quantised to integers, ordered by label and then along a Hilbert
curve, and packed into Parquet blocks of ``BLOCK`` rows.  A block's zone map
holds its labels' range and every dimension's smallest and largest value.  For
an anchor, interval arithmetic on a zone map bounds the inner product with
every row of the block from both sides, so the zone maps alone say which blocks
must be read: for the positives those of the anchor's label whose upper bound
reaches what other blocks are sure to hold, for the negatives those whose
interval meets one of the anchor's score windows.

Shape: anchors are packed into chunks in the same order.  Zone maps and chunks
meet in a grid of groups of bounded size; what is chosen there is a list
(chunk, block, anchors).  Only chosen blocks are joined with their chunks, and
a task scores one chunk against at most about ``RUN`` blocks and leaves the
best few of each anchor or window, which a window of a few rows per block run
merges.  Nothing grows with a label's size but the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import ship_package
from .common import read, stored

SCALE = 256
BLOCK = 1024  # rows in a block
CHUNK = 1024  # anchors in a chunk
ZONES = 4096  # zone maps in a group
CHUNKS = 8  # chunks in a group
RUN = 16  # blocks that a task reads for a chunk
KEY_BITS = 512  # of a Hilbert key, at most
PART = 1 << 16  # rows of a range partition
K = 5
LOW, HIGH = 80, 100  # a negative's score, in hundredths of the positive's


# ---------------------------------------------------------------- Hilbert order

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as big-endian bytes (one row each), of
    integer cells (n, d) below 2^bits: the axes are turned into the transposed
    index by Gray-code steps, one bit plane at a time."""
    n, d = cells.shape
    x = cells.T.astype(np.uint32).copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(hit, p, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, dtype=np.uint32)
    q = 1 << (bits - 1)
    while q > 1 and d:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.reshape(bits * d, n).T, axis=1)


def _with_key(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Adds ``key``: the Hilbert place of ``q`` on a grid over the range of ``whole``."""
    ends = whole.select(F.array_min("q").alias("lo"), F.array_max("q").alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    lo, span = (ends["lo"], ends["hi"] - ends["lo"] + 1) if ends["lo"] is not None else (0, 1)

    @F.pandas_udf("binary")
    def key(q: pd.Series) -> pd.Series:
        out = np.empty(len(q), dtype=object)
        sizes = q.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            bits = max(1, min(8, KEY_BITS // max(1, d)))
            x = np.stack(q.iloc[at].to_numpy()).astype(np.float64).reshape(len(at), d)
            keys = hilbert_keys(np.minimum((x - lo) * (1 << bits) / span, (1 << bits) - 1).astype(np.uint32), bits)
            out[at] = [k.tobytes() for k in keys]
        return pd.Series(out)

    return rows.withColumn("key", key("q"))


# ---------------------------------------------------------------- blocks and chunks

def _pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, label, dim, q, key) in order, packed: block, dim, n,
    label_lo, label_hi, lo, hi, ids, labels, vecs, the last five as little-endian
    64-bit integers.  A block ends when it is full, where the vectors' length
    changes, and, once a quarter full, where the label changes."""
    order = ["dim", "label", "key", "id"]
    n_parts = max(1, -(-rows.count() // PART))
    schema = "block long, dim int, n int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, vecs binary"

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, labels, vecs, dim = [], [], [], None

        def flush():
            nonlocal made
            q = np.array(vecs, dtype="<i8").reshape(len(vecs), dim)
            lab = np.array(labels, dtype="<i8")
            row = ((part << 32) + made, dim, len(ids), lab.min(), lab.max(), q.min(0).tobytes(), q.max(0).tobytes(),
                   np.array(ids, dtype="<i8").tobytes(), lab.tobytes(), q.tobytes())
            made += 1
            ids.clear(), labels.clear(), vecs.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for i, lab, d, q in zip(b["id"], b["label"], b["dim"], b["q"], strict=True):
                if ids and (len(ids) >= size or d != dim or (lab != labels[-1] and 4 * len(ids) >= size)):
                    yield flush()
                ids.append(i), labels.append(lab), vecs.append(q)
                dim = int(d)
        if ids:
            yield flush()

    dealt = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return stored(dealt.select("id", "label", "dim", "q").mapInPandas(run, schema), name)


def _longs(b: bytes, width: int | None = None) -> np.ndarray:
    x = np.frombuffer(b, dtype="<i8")
    return x if width is None else x.reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers, through doubles where these are exact."""
    top = lambda x: int(np.abs(x).max(initial=0))
    if top(a) * top(b) * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of ``a`` with any vector
    between ``lo`` and ``hi``: a positive component takes the near end."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return products(plus, lo) + products(minus, hi), products(plus, hi) + products(minus, lo)


def _sure(low: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per row: a score that ``k`` rows of the blocks are sure to reach, the
    blocks holding ``n`` rows (0: not counted) of at least ``low`` each."""
    by = np.argsort(-low, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(n, by, 1), axis=1)
    at = (held < k).sum(axis=1)
    least = np.iinfo(np.int64).min
    ranked = np.concatenate([np.take_along_axis(low, by, 1), np.full((len(low), 1), least)], axis=1)
    return ranked[np.arange(len(low)), at]


def _need_positive(q, labels, z, k):
    low, high = bounds(q, z["lo"], z["hi"])
    own = (z["label_lo"] <= labels[:, None]) & (labels[:, None] <= z["label_hi"])
    pure = own & (z["label_lo"] == z["label_hi"])
    # the anchor itself may be among a block's rows
    return own & (high >= _sure(low, np.where(pure, z["n"] - 1, 0), k)[:, None])


def _need_negative(q, labels, z, k, windows):
    """``windows``: a list per anchor of its positives' scores."""
    low, high = bounds(q, z["lo"], z["hi"])
    other = ~((z["label_lo"] == labels[:, None]) & (labels[:, None] == z["label_hi"]))
    pure = (labels[:, None] < z["label_lo"]) | (labels[:, None] > z["label_hi"])
    need = np.zeros(low.shape, dtype=bool)
    for j in range(max(map(len, windows), default=0)):
        has = np.array([len(w) > j for w in windows])
        p = np.array([w[j] if len(w) > j else 0 for w in windows], dtype=np.int64)[:, None]
        meets = has[:, None] & other & (HIGH * high >= LOW * p) & (low <= p)
        inside = meets & pure & (HIGH * low >= LOW * p) & (high <= p)
        if inside.any():
            meets &= high >= _sure(low, np.where(inside, z["n"], 0), k)[:, None]
        need |= meets
    return need


# ---------------------------------------------------------------- choosing and reading

def _choose(blocks: DataFrame, chunks: DataFrame, k: int, windows: bool) -> DataFrame:
    """(chunk, block, run, who): which anchors (places in their chunk) need
    which blocks.  Reads the zone maps only."""
    n_blocks, n_chunks = blocks.count(), chunks.count()
    n_zones, n_groups, n_runs = (max(1, -(-a // b)) for a, b in ((n_blocks, ZONES), (n_chunks, CHUNKS), (n_blocks, RUN)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    zones = blocks.select("block", "dim", "n", "label_lo", "label_hi", "lo", "hi", deal("block", n_zones).alias("z"),
                          spread(n_groups).alias("g"))
    asked = chunks.withColumn("g", deal("chunk", n_groups)).withColumn("z", spread(n_zones))
    keys = ["dim", "z", "g"]

    def run(zone: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(zone):
            d = int(zone["dim"].iloc[0])
            z = {c: zone[c].to_numpy().astype(np.int64) for c in ("n", "label_lo", "label_hi")}
            z |= {c: _longs(b"".join(zone[c]), d) if d else np.zeros((len(zone), 0), dtype=np.int64) for c in ("lo", "hi")}
            block = zone["block"].to_numpy()
            for c in asking.itertuples():
                labels = _longs(c.labels)
                q = _longs(c.vecs).reshape(len(labels), d)
                need = _need_negative(q, labels, z, k, _scores(c, len(labels))) if windows else _need_positive(q, labels, z, k)
                for i in np.flatnonzero(need.any(axis=0)):
                    out.append((c.chunk, block[i], np.flatnonzero(need[:, i]).astype(np.int32)))
        return pd.DataFrame(out, columns=["chunk", "block", "who"]).astype({"chunk": "int64", "block": "int64"})

    chosen = zones.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "chunk long, block long, who array<int>")
    return stored(chosen.withColumn("run", deal("block", n_runs)), "chosen")


def _scores(c, n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for p in c.positives if c.positives is not None else []:
        out[p["idx"]].append(p["score"])
    return out


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's first ``k`` by falling score, then id."""
    by = np.lexsort((ids, -scores, rows))
    r = rows[by]
    first = np.searchsorted(r, r)
    return by[np.arange(len(by)) - first < k]


def _edge(s: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """``ok`` without what lies under a row's k-th best."""
    if s.shape[1] <= k:
        return ok
    s = np.where(ok, s, np.iinfo(np.int64).min)
    return ok & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]])


def _read(blocks: DataFrame, chunks: DataFrame, chosen: DataFrame, k: int, windows: bool) -> DataFrame:
    """(chunk, idx, slot, id, score): of each chosen run, each anchor's (slot
    0) or each window's best ``k``."""
    left = chosen.join(blocks.select("block", "ids", "labels", "vecs", "dim"), "block").select("chunk", "run", "who", "ids", "labels", "vecs", "dim")
    right = chosen.select(F.col("chunk").alias("c"), F.col("run").alias("at")).distinct().join(
        chunks.drop("dim"), F.col("c") == F.col("chunk")).drop("c")
    schema = "chunk long, idx int, slot int, id long, score long"

    def run(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        got: list[np.ndarray] = []
        if len(found):
            c = next(asking.itertuples())
            d = int(found["dim"].iloc[0])
            own_ids, own = _longs(c.ids), _longs(c.labels)
            q = _longs(c.vecs).reshape(len(own), d)
            scores = _scores(c, len(own)) if windows else []
            for who, ids, labels, vecs in zip(found["who"], found["ids"], found["labels"], found["vecs"], strict=True):
                ids, labels = _longs(ids), _longs(labels)
                s = products(q[who], _longs(vecs).reshape(len(ids), d))
                same = labels[None, :] == own[who][:, None]
                if not windows:
                    slots = [(0, same & (ids[None, :] != own_ids[who][:, None]))]
                else:
                    slots = []
                    for j in range(max((len(scores[w]) for w in who), default=0)):
                        p = np.array([scores[w][j] if len(scores[w]) > j else -1 for w in who], dtype=np.int64)[:, None]
                        slots.append((j, ~same & (p >= 0) & (LOW * p <= HIGH * s) & (s <= p)))
                for j, ok in slots:
                    r, x = np.nonzero(_edge(s, ok, k))
                    got.append(np.stack([who[r].astype(np.int64), np.full(len(r), j), ids[x], s[r, x]], axis=1))
        all_ = np.concatenate(got) if got else np.zeros((0, 4), dtype=np.int64)
        all_ = all_[_best(all_[:, 0] * 1024 + all_[:, 1], all_[:, 2], all_[:, 3], k)]
        return pd.DataFrame({"chunk": np.full(len(all_), c.chunk if len(found) else 0, dtype=np.int64), "idx": all_[:, 0].astype(np.int32),
                             "slot": all_[:, 1].astype(np.int32), "id": all_[:, 2], "score": all_[:, 3]})

    found = left.groupBy("chunk", "run").cogroup(right.groupBy("chunk", "at")).applyInPandas(run, schema)
    by = Window.partitionBy("chunk", "idx", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs; null where a component
    is null or not finite, or where a product leaves the 32-bit range."""
    x = F.transform(vec.cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale)).cast("double")))
    ok = F.forall(vec.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float(1 << 31))))
    return F.when(F.coalesce(ok, F.lit(False)), x)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: str = "label", vec: str = "embedding", k: int = K,
         scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).

    An anchor (a row for which ``anchor`` holds) has as positives its first
    ``k`` other rows of the same label, and for each positive come the first
    ``k`` rows of another label whose score lies between ``LOW`` and ``HIGH``
    hundredths of the positive's; higher scores first, ties by smaller id.

    Rows with a null id, label or vector, or a component that is null, not
    finite or beyond 32 bits once scaled, take no part.  Rows equal in id,
    label and quantised vector count once; another row is one with another id.
    Vectors are compared with vectors of their own length only.  Fewer rows
    give fewer results, an empty table none; other columns are ignored."""
    spark = rows.sparkSession
    ship_package(spark)
    pick = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised(F.col(vec), scale).alias("q"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"))
    pick = pick.filter("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    once = pick.groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor"))
    keyed = stored(_with_key(once.withColumn("dim", F.size("q")), pick), "keyed")
    blocks = _pack(keyed, block, "blocks")
    chunks = _pack(keyed.filter("anchor"), chunk, "chunks").select(F.col("block").alias("chunk"), "dim", "ids", "labels", "vecs")
    chunks = chunks.withColumn("positives", F.lit(None).cast("array<struct<idx:int,rank:int,id:bigint,score:bigint>>"))
    positives = stored(_read(blocks, chunks, _choose(blocks, chunks, k, False), k, False), "positives")
    # at most k for each of a chunk's anchors
    per = positives.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "rank", "id", "score"))).alias("positives"))
    asking = stored(chunks.drop("positives").join(per, "chunk"), "asking")
    negatives = _read(blocks, asking, _choose(blocks, asking, k, True), k, True)
    anchors = chunks.select("chunk", F.posexplode(_unpacked("ids")).alias("idx", "anchor_id"))
    pairs = positives.join(anchors, ["chunk", "idx"]).select(
        "chunk", "idx", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(pairs, ["chunk", "idx", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


@F.pandas_udf(ArrayType(LongType()))
def _unpacked(b: pd.Series) -> pd.Series:
    return b.map(lambda x: np.frombuffer(x, dtype="<i8"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT DISTINCT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON len(a.q) = len(b.q) AND a.id <> b.id WHERE a.id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id, p.k ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
