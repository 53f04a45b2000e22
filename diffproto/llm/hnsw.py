"""Embedding near-duplicates through hierarchical navigable small-world graphs.

Vectors that are equal are one class with a multiplicity.  Classes of one label
are cut into shards of at most ``SHARD``; each shard gets a graph: every node
lies in layer 0 and, with a chance of 1/``LINKS`` a layer, in higher ones, and
is linked in each to near nodes in different directions.  Every shard's classes
are asked of every shard of their label (a pair of shards once, as links go
both ways).  A search descends the layers, widens to a beam in layer 0, and
from every node near the threshold goes on to its neighbours until no more turn
up, so a group of any size is found whole.  In each pair of shards an audit
compares the beam with exact products for some of the queries, and the beam is
doubled until its recall passes, or it is as wide as the shard.  Cosines that
decide are computed in double precision from the vectors as given.

Shape: a shard is packed into one row, so a task holds two shards whatever the
table's size.  A task leaves one count per class and the edges of a spanning
forest of the links it found, never the links themselves, so a group of m near
copies costs m rows; the edges of all tasks are closed by ``components``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .ann import usable
from .common import components, join_classes, read, stored

COSINE = 0.93
SHARD = 4096
LINKS = 16  # of a node in an upper layer; twice as many in layer 0
BUILD = 64  # beam while building
BEAM = 48  # beam that searches start with
BATCH = 256  # nodes or queries handled together
WIDE = 4  # nodes of a beam that are expanded together
SLACK = 0.1  # a search goes on from nodes whose cosine is this much under the threshold
AUDIT = 48  # queries of an audit
NEAREST = 4  # nodes that an audit looks for besides the linked ones
RECALL = 0.97


# ---------------------------------------------------------------- the graph

def beam(vecs: np.ndarray, adj: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int):
    """Best-first search of all queries together: (ids, cosines), best first, padded with -1."""
    n_q, m = len(q), adj.shape[1]
    seen = np.zeros((n_q, len(vecs)), dtype=bool)
    ids = np.full((n_q, width), -1, dtype=np.int64)
    sims = np.full((n_q, width), -np.inf, dtype=np.float32)
    done = np.ones((n_q, width), dtype=bool)
    live = np.arange(n_q)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", vecs[entry], q), False
    seen[live, entry] = True
    wide = min(WIDE, width)
    while True:
        at = np.argsort(done[live], axis=1, kind="stable")[:, :wide]  # the beam is sorted: its best that wait
        waits = ~np.take_along_axis(done[live], at, 1)
        some = waits.any(axis=1)
        live, at, waits = live[some], at[some], waits[some]
        if not len(live):
            return ids, sims
        done[live[:, None], at] = True
        node = np.take_along_axis(ids[live], at, 1)
        new = np.full((len(live), wide, m), -1, dtype=np.int64)
        for w in range(wide):
            nb = adj[node[:, w]]
            r, c = np.nonzero((nb >= 0) & waits[:, [w]])
            x = nb[r, c]
            fresh = ~seen[live[r], x]
            r, c, x = r[fresh], c[fresh], x[fresh]
            seen[live[r], x] = True
            new[r, w, c] = x
        new = new.reshape(len(live), wide * m)
        s = np.full(new.shape, -np.inf, dtype=np.float32)
        r, c = np.nonzero(new >= 0)
        s[r, c] = np.einsum("ij,ij->i", vecs[new[r, c]], q[live[r]])
        all_ids, all_sims = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], s], 1)
        all_done = np.concatenate([done[live], new < 0], 1)
        by = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[live], sims[live] = np.take_along_axis(all_ids, by, 1), np.take_along_axis(all_sims, by, 1)
        done[live] = np.take_along_axis(all_done, by, 1)


def spread_out(vecs: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none) at most ``most``: from the nearest
    on, those nearer to the row's node than to any taken before; then the
    nearest of the rest."""
    out = np.full((len(cand), most), -1, dtype=np.int64)
    for a in range(0, len(cand), 512):
        c, s = cand[a: a + 512], np.where(cand[a: a + 512] >= 0, sims[a: a + 512], -np.inf)
        by = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, by, 1), np.take_along_axis(s, by, 1)
        x = vecs[c]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(c.shape, dtype=bool)
        for j in range(c.shape[1]):
            nearest = np.where(taken[:, :j], between[:, j, :j], -np.inf).max(axis=1) if j else np.full(len(c), -np.inf)
            taken[:, j] = (c[:, j] >= 0) & (nearest < s[:, j]) & (taken.sum(axis=1) < most)
        first = np.argsort(np.where(c < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
        out[a: a + 512, : first.shape[1]] = np.take_along_axis(c, first, 1)
    return out


class Graph:
    """Unit vectors (float32), their levels, and a table of neighbours for each layer."""

    def __init__(self, vecs: np.ndarray, levels: np.ndarray, adj: list[np.ndarray] | None = None):
        self.vecs = np.ascontiguousarray(vecs, dtype=np.float32)
        self.levels = levels
        self.lists = None
        self.top = int(np.argmax(levels)) if len(levels) else 0
        self.adj = adj if adj is not None else self._built()

    def descend(self, q: np.ndarray, to: int = 0) -> np.ndarray:
        entry = np.full(len(q), self.top)
        for layer in range(len(self.adj) - 1, to, -1):
            entry = beam(self.vecs, self.adj[layer], q, entry, 2)[0][:, 0]
        return entry

    def _built(self) -> list[np.ndarray]:
        n = len(self.vecs)
        layers = int(self.levels.max(initial=0)) + 1
        self.adj = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int64) for k in range(layers)]
        order = np.concatenate([[self.top], np.delete(np.arange(n), self.top)]) if n else np.arange(0)
        at = 1
        while at < n:  # the graph doubles until batches are full
            nodes = order[at: at + min(at, BATCH)]
            at += len(nodes)
            q = self.vecs[nodes]
            entry = np.full(len(nodes), self.top)
            chosen = {}
            for k in range(layers - 1, -1, -1):
                into = self.levels[nodes] >= k
                if (~into).any():
                    entry[~into] = beam(self.vecs, self.adj[k], q[~into], entry[~into], 2)[0][:, 0]
                if into.any():
                    ids, sims = beam(self.vecs, self.adj[k], q[into], entry[into], BUILD)
                    entry[into] = ids[:, 0]
                    beside = q[into] @ q[into].T  # in the same batch
                    np.fill_diagonal(beside, -np.inf)
                    near = np.argsort(-beside, axis=1)[:, :LINKS]
                    s = np.take_along_axis(beside, near, 1)
                    mates = np.where(np.isfinite(s), nodes[into][near], -1)
                    chosen[k] = nodes[into], spread_out(self.vecs, np.concatenate([ids, mates], 1), np.concatenate([sims, s], 1), LINKS)
            for k, (own, to) in chosen.items():
                self.adj[k][own, : to.shape[1]] = to
                self._back(k, own, to)
        return self.adj

    def _back(self, k: int, own: np.ndarray, to: np.ndarray) -> None:
        """Links back from the neighbours; a full list keeps what ``spread_out`` takes."""
        adj = self.adj[k]
        r, c = np.nonzero(to >= 0)
        target, source = to[r, c], own[r]
        sims = np.einsum("ij,ij->i", self.vecs[target], self.vecs[source])
        by = np.lexsort((-sims, target))
        target, source = target[by], source[by]
        at, start = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        keep = place < adj.shape[1]  # nearer ones fill the list already
        more = np.full((len(at), int(place[keep].max(initial=0)) + 1), -1, dtype=np.int64)
        more[np.searchsorted(at, target[keep]), place[keep]] = source[keep]
        # two nodes of one batch may have chosen each other
        more[(more[:, :, None] == adj[at][:, None, :]).any(axis=2)] = -1
        cand = np.concatenate([adj[at], more], 1)
        fits = (cand >= 0).sum(axis=1) <= adj.shape[1]
        adj[at[fits]] = np.take_along_axis(cand[fits], np.argsort(cand[fits] < 0, axis=1, kind="stable"), 1)[:, : adj.shape[1]]
        full, cand = at[~fits], cand[~fits]
        if len(full):
            s = np.einsum("ijk,ik->ij", self.vecs[cand], self.vecs[full])
            adj[full] = spread_out(self.vecs, cand, s, adj.shape[1])

    def _both(self) -> tuple[np.ndarray, np.ndarray]:
        """Layer 0 with its links in both directions: where a node's list begins, and the lists."""
        if self.lists is None:
            r, c = np.nonzero(self.adj[0] >= 0)
            x = self.adj[0][r, c]
            at, to = np.concatenate([r, x]), np.concatenate([x, r])
            by = np.argsort(at, kind="stable")
            self.lists = np.searchsorted(at[by], np.arange(len(self.vecs) + 1)), to[by]
        return self.lists

    def near(self, q: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of at least ``least``, or found on the way; and the beam."""
        ids, sims = beam(self.vecs, self.adj[0], q, self.descend(q), min(width, len(self.vecs)))
        seen = np.zeros((len(q), len(self.vecs)), dtype=bool)  # without what fell out of the beam
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        r, c = np.nonzero(sims >= least)
        rows, nodes = [r], [ids[r, c]]
        begin, both = self._both()
        while len(rows[-1]):
            n = begin[nodes[-1] + 1] - begin[nodes[-1]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fresh = np.zeros(seen.shape, dtype=bool)
            fresh[np.repeat(rows[-1], n), both[np.repeat(begin[nodes[-1]], n) + step]] = True
            r, x = np.nonzero(fresh & ~seen)
            seen[r, x] = True
            ok = np.zeros(len(r), dtype=bool)
            for a in range(0, len(r), 1 << 16):
                ok[a: a + (1 << 16)] = np.einsum("ij,ij->i", self.vecs[x[a: a + (1 << 16)]], q[r[a: a + (1 << 16)]]) >= least
            rows.append(r[ok]), nodes.append(x[ok])
        return np.concatenate(rows), np.concatenate(nodes), ids


def audited_width(graph: Graph, q: np.ndarray, own: np.ndarray, least: float, width: int = BEAM) -> tuple[int, float]:
    """The beam with which an audit passes, and its recall: for up to ``AUDIT``
    of the queries, of the linked nodes and the ``NEAREST`` ones by exact
    products.  ``own``: a query's own node, or -1."""
    at = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    s = q[at] @ graph.vecs.T
    mine = own[at] >= 0
    s[np.flatnonzero(mine), own[at][mine]] = -np.inf
    k = min(NEAREST, s.shape[1])
    want = (s >= least) | (s >= np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]) if k else s >= least
    want &= np.isfinite(s)
    while True:
        r, x, ids = graph.near(q[at], width, least)
        got = np.zeros(s.shape, dtype=bool)
        got[r, x] = True
        i, j = np.nonzero(ids >= 0)
        got[i, ids[i, j]] = True
        # by query, so one large group does not hide the rest
        recall = float(np.mean((got & want).sum(axis=1) / np.maximum(1, want.sum(axis=1)) + (want.sum(axis=1) == 0)))
        if recall >= RECALL or width >= len(graph.vecs):
            return width, recall
        width *= 2


def settle(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components (each node's smallest known) after the links a-b."""
    while True:
        low = np.minimum(comp[a], comp[b])
        nxt = comp.copy()
        for end in (a, b):
            np.minimum.at(nxt, end, low)
            np.minimum.at(nxt, comp[end], low)
        nxt = nxt[nxt]
        if (nxt == comp).all():
            return comp
        comp = nxt


# ---------------------------------------------------------------- on Spark

def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / norm[:, None], norm


def _shards(classes: DataFrame, size: int) -> DataFrame:
    """A row per shard: label, dim, shard, n, cls and mult (64-bit integers),
    vecs (doubles), levels and links (the layers' tables, 32-bit, one after the other)."""
    schema = "label long, dim int, shard long, n int, cls binary, mult binary, vecs binary, levels binary, links binary"
    order = ["label", "dim", "u", "cls"]
    n_parts = max(1, -(-classes.count() // size))

    def pack(label, dim, shard, cls, mult, u, vecs):
        v = np.array(vecs, dtype="<f8").reshape(len(vecs), dim)
        chance = (np.array(u, dtype=np.int64).astype(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)
        levels = np.minimum(-np.log(np.maximum(chance, 1e-18)) / np.log(LINKS), 12).astype("<i4")
        g = Graph(_unit(v)[0], levels)
        return (label, dim, shard, len(vecs), np.array(cls, dtype="<i8").tobytes(), np.array(mult, dtype="<i8").tobytes(), v.tobytes(),
                levels.tobytes(), b"".join(a.astype("<i4").tobytes() for a in g.adj))

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        key, held = None, []

        def flush():
            nonlocal made
            made += 1
            return pd.DataFrame([pack(*key, (part << 32) + made, *zip(*held, strict=True))], columns=[c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for label, dim, cls, mult, u, v in zip(b["label"], b["dim"], b["cls"], b["mult"], b["u"], b["v"], strict=True):
                if held and ((label, dim) != key or len(held) >= size):
                    yield flush()
                    held = []
                key = label, dim
                held.append((cls, mult, u, v))
        if held:
            yield flush()

    # the order within a label is by hash, so shards are alike and levels independent of the data
    dealt = classes.withColumn("u", F.xxhash64(F.lit("level"), "cls")).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return stored(dealt.select("label", "dim", "cls", "mult", "u", "v").mapInPandas(run, schema), "shards")


def _search(left: pd.DataFrame, right: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One shard's classes asked of another (or the same): ``links`` per class,
    and edges (cls, to) of a forest."""
    a, b = next(left.itertuples()), next(right.itertuples())
    d, same = int(b.dim), a.s == b.t
    ids = [np.frombuffer(x.cls, dtype="<i8") for x in (a, b)]
    mult = [np.frombuffer(x.mult, dtype="<i8") for x in (a, b)]
    vecs = [np.frombuffer(x.vecs, dtype="<f8").reshape(-1, d) for x in (a, b)]
    (u, nu), (w, nw) = _unit(vecs[0]), _unit(vecs[1])
    levels = np.frombuffer(b.levels, dtype="<i4")
    flat, adj = np.frombuffer(b.links, dtype="<i4").astype(np.int64), []
    for k in range(int(levels.max()) + 1):
        m = LINKS * (2 if k == 0 else 1)
        adj.append(flat[: len(w) * m].reshape(len(w), m))
        flat = flat[len(w) * m:]
    graph = Graph(w, levels, adj)
    own = np.arange(len(u)) if same else np.full(len(u), -1)
    q = u.astype(np.float32)
    width, _ = audited_width(graph, q, own, cosine - 1e-5)
    n_a = 0 if same else len(u)  # nodes of the pair: a's first, unless they are b's
    comp = np.arange(n_a + len(w))
    links = np.zeros(n_a + len(w), dtype=np.int64)
    # inside a shard a link counts for both ends, whichever of them finds it
    linked = np.zeros((len(w), len(w)) if same else (0, 0), dtype=bool)
    for at in range(0, len(q), BATCH):
        r, x, _ = graph.near(q[at: at + BATCH], width, cosine - SLACK)
        r = r + at
        keep = own[r] != x
        r, x = r[keep], x[keep]
        for i in range(0, len(r), 1 << 16):
            p, o = r[i: i + (1 << 16)], x[i: i + (1 << 16)]
            hit = np.einsum("ij,ij->i", vecs[0][p], vecs[1][o]) / (nu[p] * nw[o]) >= cosine
            p, o = p[hit], o[hit]
            if same:
                linked[p, o] = linked[o, p] = True
            else:
                np.add.at(links, p, mult[1][o])
                np.add.at(links, n_a + o, mult[0][p])
            comp = settle(comp, p, n_a + o)
    if same:
        links = linked @ mult[1]
    node = np.concatenate([ids[0], ids[1]]) if not same else ids[1]
    used = np.flatnonzero(links > 0)
    return pd.DataFrame({"cls": node[used], "links": links[used], "to": node[comp[used]]})


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", label: str = "label", vec: str = "embedding",
                    shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``rows``.

    Rows of one label are linked where the cosine is at least ``cosine``;
    n_links is the number of other rows linked directly, component_id the
    smallest id reachable by links (the row's own included) and kept whether
    the row has that id.  Rows without a label, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing.
    Vectors are compared with those of their own length only.  A row without
    an id is linked like others, but its id is no component's and it is not
    kept.  Repeated rows are rows of their own: they are linked and, by their
    equal ids, kept together.  Other columns are ignored; an empty table gives
    an empty result."""
    spark = rows.sparkSession
    ship_package(spark)
    pick = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    ok = F.col("label").isNotNull() & usable(F.col("v"))
    whole = pick.withColumn("ok", ok)
    classes = stored(
        whole.filter("ok").groupBy("label", "v").agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("least"))
        .withColumn("dim", F.size("v")).withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    shards = _shards(classes, shard)
    at = shards.select("label", "dim", "shard")
    tasks = at.withColumnRenamed("shard", "s").join(at.withColumnRenamed("shard", "t"), ["label", "dim"]).filter("s <= t").select("s", "t")
    left = tasks.join(shards.select(F.col("shard").alias("s"), "cls", "mult", "vecs"), "s")
    right = tasks.select(F.col("s").alias("of"), F.col("t").alias("in")).join(shards.withColumnRenamed("shard", "t"), F.col("in") == F.col("t")).select(
        "of", "t", "dim", "cls", "mult", "vecs", "levels", "links")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, cosine)

    found = stored(left.groupBy("s", "t").cogroup(right.groupBy("of", "t")).applyInPandas(run, "cls long, links long, to long"), "found")
    per = found.groupBy("cls").agg(F.sum("links").alias("links"))
    member = components(found, "cls", "to").select(F.col("node").alias("cls"), "component")
    known = classes.select("cls", "label", "v", "mult", "least").join(per, "cls", "left").join(member, "cls", "left")
    known = known.withColumn("component", F.coalesce("component", "cls"))
    least = known.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    known = stored(
        known.join(least, F.col("component") == F.col("c")).select(
            "label", "v", "mult", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"),
        "known",
    )
    linked = join_classes(whole.filter("ok").select("id", "label", "v"), known, ["label", "v"], "mult").select("id", "n_links", "component_id")
    alone = whole.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.id <> b.id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(id, c) AS (SELECT x, x FROM l UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id),
n AS (SELECT x AS id, count(*) AS n_links FROM l GROUP BY x),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.id = e.vec_id LEFT JOIN c ON c.id = e.vec_id
"""
