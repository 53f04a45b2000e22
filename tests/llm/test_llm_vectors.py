"""Hard negatives and embedding near-duplicates: brute force and edge cases."""

import itertools

import numpy as np
import pytest

from diffproto.llm import hardneg, hnsw

ROWS = "vec_id long, embedding array<double>, label int, id string, key string, q string, block string, shard string, node string"


def vectors(spark, rows):
    """Rows of (vec_id, vector, label) with extra columns whose names clash with the operators' own."""
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], lab, *"abcdef") for i, v, lab in rows]
    return spark.createDataFrame(full, ROWS)


BAD = [(None, [0.5] * 8, 1), (900, None, 1), (1000, [0.5] * 7 + [None], 1), (1100, [0.5] * 7 + [float("nan")], 2),
       (1200, [0.5] * 7 + [float("inf")], 2), (1300, [0.5] * 8, None), (1400, [0.5] * 3, 1), (1401, [0.4] * 3, 2), (1402, [0.5] * 3, 1)]


def clustered(seed, n=400, d=8, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    c /= np.linalg.norm(c, axis=1)[:, None]
    at = rng.integers(0, centres, n)
    v = c[at] + rng.normal(size=(n, d)) * 0.08
    return [(int(i), v[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def brute_negatives(rows, step, k=5):
    use = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use[i, lab, tuple(int(np.floor(256 * x)) for x in v)] = None
    out = set()
    for (ai, al, aq) in use:
        if ai % step:
            continue
        s = [(-sum(x * y for x, y in zip(aq, q, strict=True)), i, lab) for i, lab, q in use if i != ai and len(q) == len(aq)]
        s.sort()
        for p, pid, _ in [x for x in s if x[2] == al][:k]:
            hard = [x for x in s if x[2] != al and 80 * -p <= 100 * -x[0] and x[0] >= p][:k]
            out |= {(ai, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(hard)}
    return out


@pytest.mark.parametrize("seed,block,chunk", [(1, 16, 8), (2, 1024, 1024)])
def test_hard_negatives_equal_brute_force(spark, seed, block, chunk):
    from pyspark.sql import functions as F

    rows = clustered(seed) + BAD
    rows += [rows[20], rows[20], (2000, rows[3][1], 0), (2001, rows[3][1], 1), (2002, [0.0] * 8, 0)]
    got = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, block=block, chunk=chunk).collect()
    want = brute_negatives(rows, 20)
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_hard_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    assert hardneg.mine(vectors(spark, []), F.lit(True)).collect() == []
    assert hardneg.mine(vectors(spark, BAD[:6]), F.lit(True)).collect() == []
    assert hardneg.mine(vectors(spark, clustered(3, 50)), F.lit(None).cast("boolean")).collect() == []


def test_zone_maps_choose_few_blocks(spark):
    """On tight clusters an anchor reads a small part of the blocks, and bounds hold every product."""
    rng = np.random.default_rng(0)
    q = rng.integers(-50, 50, (30, 6))
    a = rng.integers(-50, 50, (9, 6))
    low, high = hardneg.bounds(a, q.min(0)[None], q.max(0)[None])
    s = hardneg.products(a, q)
    assert (low <= s.min(1)[:, None]).all() and (high >= s.max(1)[:, None]).all()

    d, n, c = 16, 4000, 20
    centres = rng.normal(size=(c, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    at = rng.integers(0, c, n)
    v = centres[at] + rng.normal(size=(n, d)) * 0.004
    rows = vectors(spark, [(i, v[i].tolist(), int(at[i] % 4)) for i in range(n)])
    from pyspark.sql import functions as F

    pick = rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), hardneg.quantised(F.col("embedding")).alias("q"))
    keyed = hardneg._with_key(pick.withColumn("dim", F.size("q")), pick)
    blocks = hardneg._pack(keyed, 32, "t-blocks")
    chunks = hardneg._pack(keyed.filter("id % 100 = 0"), 8, "t-chunks").select(F.col("block").alias("chunk"), "dim", "ids", "labels", "vecs")
    chunks = chunks.withColumn("positives", F.lit(None).cast("array<struct<idx:int,rank:int,id:bigint,score:bigint>>"))
    chosen = hardneg._choose(blocks, chunks, 5, False)
    pairs = chosen.select(F.sum(F.size("who"))).first()[0]
    assert pairs < 0.15 * 40 * blocks.count()


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_hilbert_curve_goes_to_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = [k.tobytes() for k in hardneg.hilbert_keys(cells, bits)]
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def near_copies(seed, d=24):
    """Groups of near copies from pairs to 150, a chain, random vectors, repeated rows, three labels and none."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).tolist(), int(rng.integers(0, 3))) for i in range(500)]
    at = 500
    for size in (2, 3, 5, 20, 150):
        base = rng.normal(size=d)
        for _ in range(size):
            rows.append((at, (base + 0.2 * rng.normal(size=d)).tolist(), int(rng.integers(0, 2)) if size < 20 else 1))
            at += 1
    x, y = np.eye(d)[0], np.eye(d)[1]
    for k in range(12):  # neighbours in the chain are linked, its ends are not
        rows.append((at, (np.cos(0.3 * k) * x + np.sin(0.3 * k) * y).tolist(), 2))
        at += 1
    rows += [(at, rows[3][1], rows[3][2]), (at + 1, [2 * v for v in rows[3][1]], rows[3][2]), (at + 2, rows[3][1], 1 - min(1, rows[3][2])),
             (at + 3, rows[600][1], None), rows[5], (None, rows[8][1], rows[8][2]), (at + 4, [0.0] * d, 1), (at + 5, [0.0] * d, 1), (at + 6, [], 1)]
    return rows + BAD


def brute_links(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows)
          if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for k, i in enumerate(ok):
        for j in ok[:k]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    old, new = comp[i], comp[j]
                    comp = [new if c == old else c for c in comp]
    least = {}
    for c, (i, _, _) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, n[k], least.get(comp[k]), i is not None and i == least.get(comp[k])) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard", [64, 4096])
def test_embedding_near_duplicates_equal_brute_force(spark, shard):
    rows = near_copies(7)
    got = sorted((tuple(r) for r in hnsw.near_duplicates(vectors(spark, rows), shard=shard).collect()), key=repr)
    assert got == brute_links(rows)


def test_embedding_near_duplicates_of_nothing(spark):
    assert hnsw.near_duplicates(vectors(spark, [])).collect() == []
    got = {tuple(r) for r in hnsw.near_duplicates(vectors(spark, [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], None)])).collect()}
    assert got == {(i, 0, i, True) for i in (1, 2, 3)}


def test_graph_recall_and_audit():
    """Random vectors have no structure to follow; the audit widens the beam until its queries' neighbours are found."""
    rng = np.random.default_rng(2)
    u = hnsw._unit(rng.normal(size=(2000, 32)))[0]
    levels = np.minimum(-np.log(rng.random(2000)) / np.log(hnsw.LINKS), 12).astype("<i4")
    g = hnsw.Graph(u, levels)
    q = u.astype(np.float32)
    width, recall = hnsw.audited_width(g, q, np.arange(2000), 0.93, width=2)
    assert recall >= hnsw.RECALL and 2 < width < 2000
    _, _, ids = g.near(q[:300], width, 0.93)
    s = q[:300] @ q.T
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(want, ids, strict=True)]) >= 0.9


def test_queries_go_to_few_cells_on_clustered_vectors(spark, monkeypatch):
    """Recall over several cells with an early stop, and rows that repeat one vector do not fill a block."""
    from diffproto.llm import ann

    rng = np.random.default_rng(4)
    d, c = 32, 60
    centres = rng.normal(size=(c, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[rng.integers(0, c, 6000)] + rng.normal(size=(6000, d)) * 0.02
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(10_000 + i, v[7].tolist(), 0) for i in range(2000)]

    df = vectors(spark, rows)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), block=250).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    every = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        s = every @ every[int(np.flatnonzero(ids == q)[0])]
        s[ids == q] = -np.inf
        want = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12)))[:20]]
        mine = [x[1] for x in sorted(got[q])]
        hits += len(set(want) & set(mine))
        total += 20
        assert len(mine) == 20 and all(abs(x[2] - s[ids == x[1]][0]) < 1e-12 for x in got[q])
    assert hits >= 0.95 * total
    points = ann._projected(list(v), 1.0, ann.DIMS, False)
    cells = ann.Cells(points, 24)
    of = cells.of(points)
    assert cells.n == 24 and set(of) == set(range(24)) and np.bincount(of).max() < 4 * 6000 / 24

