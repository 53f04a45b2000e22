"""N-gram Jaccard join: a size-aware heavy-light join on word shingles.

Documents with equal shingle sets are one class.  Two classes link when
their sets' Jaccard similarity reaches the threshold t; a document's
component is the smallest document id reachable by links.

Candidates.  Shingles are ordered rarest first (by a count sketch over all
documents; any fixed order keeps the result exact).  Two sets that reach t
share at least j shingles among the first n - ceil(t n) + j of each.  *Light*
sets, of at most ``boundary`` shingles, take j = 2 and list every 2-subset of
that prefix.  *Heavy* sets take j = 1 and list its single shingles, and so do
the light sets that are large enough to link with a heavy one.  The boundary
is where the estimated work of listing subsets and scanning lists is least.

Verification.  A list of m classes is not turned into m^2 pairs.  All of a
list that may link with one pivot, its most typical class, by size and by
what is left after the shared shingle, are first compared exactly with it; the
links found make components, and lists within one component are done.  For
the rest, pairs of classes from different components are compared exactly,
unless what is known bounds their overlap: at the first shingle k that x and
y share, all earlier shingles are unshared, so with a the overlap with the
pivot and f the number of shingles from k on that the pivot lacks,
|x & y| <= min(a_x, a_y) + min(f_x, f_y), and also <= min of what is left of
either from k on.  Such a pair is no link; no link is lost.

Shape: two passes over the texts, in which only the listed keys are
shuffled; the texts of classes that need a comparison then meet, split by
pivot in groups of bounded size, sorted, and are streamed.  Very frequent
keys are salted.  Graph steps run on links, in tables on the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import SHINGLE, components, longs, read, stored

NUM, DEN = 75, 100  # link if DEN * |x & y| >= NUM * |x | y|
SKETCH_BITS = 21  # counters of the count sketch: 2 MB of levels, whatever the input
SKETCH_CHUNK = 1 << 14
MAX_BOUNDARY = 64
SALT_FROM = 4096  # keys that occur more often than this are dealt to several tasks
GROUP = 256  # classes compared with one copy of a pivot
CUT = 1 << 16  # bytes of a text whose words are hashed at once
LONG_WORD = 64  # bytes; longer words are hashed one by one
COUNTED = 1 << 19  # shingles that the first pass holds before it counts them
LISTED = 1 << 17  # keys in one frame of the second pass, more only for a text that lists more
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SALT_BITS, _POS_BITS = 12, 20
_BYTES = np.random.default_rng(5).integers(1 << 63, size=256, dtype=np.uint64)  # a number for each byte
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so that its powers differ in their low bits

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P[1]
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CUT), _powers(pow(_BASE, -1, 1 << 64), CUT)


def _hash_words(data: bytes) -> np.ndarray:
    """The 64-bit hash of every word of lower-cased bytes, in order: a
    polynomial of the word's bytes, all words' at once from running sums."""
    b = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACES[b], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = (_UP, _DOWN) if len(b) <= CUT else (_powers(_BASE, len(b)), _powers(pow(_BASE, -1, 1 << 64), len(b)))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    n = end - start
    h = _mix((total[end] - total[start]) * down[start] + n.astype(np.uint64))
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[start[i]: end[i]])
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the text's words, A-Z lower-cased, a piece of about ``CUT`` bytes at a time."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes: A-Z only
    if len(data) <= CUT:
        return _hash_words(data)
    found, at = [], 0
    while at < len(data):
        to = len(data)
        if to - at > CUT:  # up to the last white space of the piece, or the first one after it
            cut = max(data.rfind(c, at + 1, at + CUT) for c in _WHITE)
            if cut < 0:
                cut = min((i for c in _WHITE if (i := data.find(c, at + CUT)) >= 0), default=to)
            to = cut
        found.append(_hash_words(data[at:to]))
        at = to
    return np.concatenate(found)


_WHITE = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the text's k-word shingles, ascending."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return np.empty(0, dtype=np.uint64)
    span = min(n, k)
    h = np.full(n - span + 1, span, dtype=np.uint64)
    for i in range(span):
        h = h * _P[0] + w[i: n - span + 1 + i]
    return distinct(_mix(h))


def identity(h: np.ndarray, seed: int) -> tuple[int, bytes]:
    """(class id, 128-bit digest) of a set."""
    d = xxhash.xxh3_128_digest(h.tobytes(), seed=seed)
    return int.from_bytes(d[:8], "little") >> 1, d


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of size n shares at least with any set that it links to."""
    return -(-num * n // den)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def in_order(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's shingles, rarest level first, ties by hash."""
    return h[np.argsort(levels[bucket(h)], kind="stable")]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _ids(series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in series]


# -- pass 1: classes and the count sketch ---------------------------------

def _first_pass(k: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            rows = []
            for doc_id, text in zip(_ids(b["doc_id"]), b["text"], strict=True):
                h = shingles(text, k)
                cid, digest = identity(h, seed) if len(h) else (None, None)
                rows.append((doc_id, len(h), cid, digest, None, None))
                held.append(bucket(h))
                size += len(h)
                if size > COUNTED:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            yield _first_frame(rows)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        small = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
        rows = [(None, None, None, None, c, zlib.compress(small[a: a + SKETCH_CHUNK].tobytes(), 1))
                for c, a in enumerate(range(0, len(small), SKETCH_CHUNK)) if small[a: a + SKETCH_CHUNK].any()]
        if rows:
            yield _first_frame(rows)

    return run


def _first_frame(rows) -> pd.DataFrame:
    doc_id, n, cid, digest, chunk, counts = zip(*rows, strict=True) if rows else [()] * 6
    return pd.DataFrame({
        "doc_id": longs(doc_id), "n_shingles": longs(n), "cid": longs(cid), "digest": list(digest), "chunk": longs(chunk), "counts": list(counts)
    })


_FIRST = "doc_id long, n_shingles long, cid long, digest binary, chunk int, counts binary"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums the chunks of one task's share of the sketch, one batch at a time."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, data in zip(b["chunk"], b["counts"], strict=True):
            add = np.frombuffer(zlib.decompress(data), dtype="<u4")
            total[c] = total[c] + add if c in total else add.astype(np.int64)
    for c, t in total.items():
        yield pd.DataFrame({"chunk": [c], "counts": [zlib.compress(np.minimum(t, 0xFFFFFFFF).astype("<u4").tobytes(), 1)]})


def sketch_counts(rows: DataFrame) -> np.ndarray:
    """The merged sketch: 2^SKETCH_BITS counters, a fixed size."""
    merged = rows.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInPandas(_merge, "chunk int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in merged.collect():
        a = r["chunk"] * SKETCH_CHUNK
        out[a: a + SKETCH_CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4")
    return out


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """Level of a bucket: the binary logarithm of how far it is over the
    median, which is what chance alone puts there."""
    over = np.maximum(0, counts - np.int64(np.median(counts)))
    return np.floor(np.log2(over + 1)).astype(np.uint8)


def choose_boundary(sizes: dict[int, int], counts: np.ndarray, num: int, den: int) -> int:
    """The boundary with the least estimated work.  ``sizes``: how many
    classes there are of each size up to MAX_BOUNDARY + 1 (that and more).
    A light set lists C(p, 2) subsets of its prefix of p; a heavy set scans
    the lists of its prefix, whose mean length the sketch gives for the
    rarest quarter of all occurrences."""
    over = np.maximum(0, counts - np.int64(np.median(counts)))
    by = np.argsort(over, kind="stable")
    upto = int(np.searchsorted(np.cumsum(counts[by]), counts.sum() / 4)) + 1
    some = counts[by[:upto]]
    scan = 1 + float((over[by[:upto]] * some).sum() / max(1, some.sum()))
    pre = lambda n, j: min(n, n - least_overlap(n, num, den) + j)
    light = lambda n: pre(n, 2) * (pre(n, 2) - 1) / 2
    best, least = 0, None
    for x in range(MAX_BOUNDARY + 1):
        work = sum(c * light(n) for n, c in sizes.items() if n <= x)
        work += sum(c * pre(n, 1) * (1 + scan) for n, c in sizes.items() if n > x)
        work += sum(c * pre(n, 1) for n, c in sizes.items() if least_overlap(x + 1, num, den) <= n <= x)
        if least is None or work < least:
            best, least = x, work
    return best


# -- pass 2: keys ----------------------------------------------------------

def class_keys(h: np.ndarray, levels: np.ndarray, boundary: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) that a set lists."""
    n = len(h)
    first = in_order(h, levels)
    keys, at = [], []
    if n <= boundary:
        p = first[: min(n, n - least_overlap(n, num, den) + 2)]
        i, j = np.triu_indices(len(p), 1)
        keys.append(_mix((p[i] * _P[0]) ^ (p[j] + _P[2])))
        at.append(np.zeros(len(i), dtype=np.int64))  # says nothing about what comes before
    if n > boundary or n >= least_overlap(boundary + 1, num, den):
        p = first[: n - least_overlap(n, num, den) + 1]
        keys.append(p)
        at.append(np.minimum(np.arange(len(p)), (1 << _POS_BITS) - 1))
    return np.concatenate(keys), np.concatenate(at)


def _second_pass(k: int, seed: int, shared, num: int, den: int):
    def run(batches):
        levels, heavy, boundary = shared.value
        seen: set[int] = set()
        for b in batches:
            rows, listed = [], 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                if pd.isna(doc_id):
                    continue
                h = shingles(text, k)
                if not len(h):
                    continue
                cid, _ = identity(h, seed)
                if cid in seen:  # a copy in the same task
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(cid)
                keys, at = class_keys(h, levels, boundary, num, den)
                salts = heavy[bucket(keys)].astype(np.int64) if len(heavy) else np.zeros(len(keys), dtype=np.int64)
                salt = np.where(salts > 0, cid % np.maximum(salts, 1) + 1, 0)
                if rows and listed + len(keys) > LISTED:
                    yield pd.DataFrame(rows, columns=["cid", "n", "key", "at"])
                    rows, listed = [], 0
                rows.append((cid, len(h), signed(keys), (at << _SALT_BITS) | salt))
                listed += len(keys)
            yield pd.DataFrame(rows, columns=["cid", "n", "key", "at"])

    return run


def listed_keys(docs: DataFrame, k: int, seed: int, shared, num: int, den: int) -> DataFrame:
    """(key, cid, packed): packed holds n, the position and the salt (0: the key is not salted)."""
    rows = docs.mapInPandas(_second_pass(k, seed, shared, num, den), "cid long, n long, key array<long>, at array<long>")
    each = rows.select("cid", "n", F.explode(F.arrays_zip("key", "at")).alias("e"))
    return each.select(F.col("e.key").alias("key"), "cid", F.shiftleft("n", _SALT_BITS + _POS_BITS).bitwiseOR(F.col("e.at")).alias("packed"))


def lists_of_two(keys: DataFrame) -> DataFrame:
    """Listed rows whose key has at least two classes: key, cid, n, pos.  A
    salted key is looked at salt by salt, and kept."""
    salt = F.col("packed").bitwiseAND(F.lit((1 << _SALT_BITS) - 1))
    w = Window.partitionBy("key", "salt")
    # copies in different tasks list the same row
    two = keys.withColumn("salt", salt).withColumn("lo", F.min("cid").over(w)).withColumn("hi", F.max("cid").over(w))
    two = two.filter((F.col("lo") != F.col("hi")) | (F.col("salt") > 0))
    return two.select(
        "key", "cid", F.shiftright("packed", _SALT_BITS + _POS_BITS).alias("n"),
        F.shiftright("packed", _SALT_BITS).bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("pos"),
    ).distinct()


def with_pivots(lists: DataFrame) -> DataFrame:
    """Adds each key's pivot, the class of the list whose own listed keys are
    shared most, with its size and position."""
    typical = lists.groupBy("cid").agg((F.count("*") / F.max("n")).alias("typical"))
    named = lists.join(typical, "cid")
    pivot = named.groupBy("key").agg(
        F.max(F.struct("typical", "cid", "n", "pos")).alias("p"), F.min("cid").alias("lo"), F.max("cid").alias("hi")
    ).filter("lo <> hi").select("key", F.col("p.cid").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos"))
    return lists.join(pivot, "key")


def may_link(n, pos, m, other, num: int, den: int):
    """Can sets of n and m shingles link if what they share starts at these
    positions?  Their sizes and what is left of either must allow it."""
    small, large, left = F.least(n, m), F.greatest(n, m), F.least(n - pos, m - other)
    return (small * den >= large * num) & (left * (den + num) >= F.lit(num) * (n + m))


# -- exact comparison ------------------------------------------------------

_COMPARED = "cid long, pivot long, n long, shared long, n_pivot long, key array<long>, before array<long>"


def _compare(k: int, seed: int, shared, num: int, den: int):
    """Rows sorted by (pivot, part, the pivot first, cid)."""

    def run(batches):
        levels, _, boundary = shared.value
        group, pivot, last = None, None, None
        for b in batches:
            out = []
            for p, part, cid, text in zip(b["pivot"], b["part"], b["cid"], b["text"], strict=True):
                if (p, part) != group:
                    group, pivot, last = (p, part), None, None
                if cid == last:
                    continue  # a copy
                h = shingles(text, k)
                if identity(h, seed)[0] != cid:
                    continue  # another row under the same document id
                last = cid
                if cid == p:
                    pivot = h
                    continue
                n = len(h)
                inside = _isin(h, pivot)
                a = int(inside.sum())
                # the class's listed single shingles that the pivot has, and how many before each it lacks
                first = np.argsort(levels[bucket(h)], kind="stable")[: n - least_overlap(n, num, den) + 1]
                has = inside[first]
                before = np.cumsum(~has) - ~has
                out.append((cid, p, n, a, len(pivot), signed(h[first][has]), before[has].astype(np.int64)))
            yield pd.DataFrame(out, columns=["cid", "pivot", "n", "shared", "n_pivot", "key", "before"])

    return run


def _isin(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which entries of an ascending array are in another one."""
    at = np.searchsorted(other, h)
    return other[np.minimum(at, len(other) - 1)] == h


def compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, run) -> DataFrame:
    """Exact overlaps of distinct (cid, pivot) pairs.  The members of a pivot
    are dealt to parts of about ``GROUP``, each with a copy of the pivot."""
    pairs = pairs.filter("cid <> pivot").distinct()
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = pairs.join(parts, "pivot").select("cid", "pivot", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    pivots = members.select(F.col("pivot").alias("cid"), "pivot", "part").distinct()
    asked = members.unionByName(pivots).join(classes.select("cid", "rep"), "cid")
    asked = asked.groupBy("rep").agg(F.collect_list(F.struct("cid", "pivot", "part")).alias("asked"))
    rows = docs.join(asked, F.col("doc_id") == F.col("rep")).select("text", F.explode("asked").alias("a"))
    rows = rows.select("a.pivot", "a.part", "a.cid", "text").repartition("pivot", "part").sortWithinPartitions(
        "pivot", "part", F.col("cid") != F.col("pivot"), "cid"
    )
    return rows.mapInPandas(run, _COMPARED)


def is_link(n: str, m: str, shared: str, num: int, den: int):
    return F.col(shared) * (den + num) >= F.lit(num) * (F.col(n) + F.col(m))


def _bounded(lists: DataFrame, measured: DataFrame, num: int, den: int) -> DataFrame:
    """Listed rows that may link, with what is known of their overlap: a and f."""
    by_key = measured.select("cid", "pivot", "shared", F.explode_outer(F.arrays_zip("key", "before")).alias("e")).select(
        "cid", "pivot", F.col("e.key").alias("key"), F.col("e.before").alias("before")
    )
    known = measured.select("cid", "pivot", "shared")
    m = lists.join(known, ["cid", "pivot"], "left").join(by_key, ["cid", "pivot", "key"], "left")
    unknown = F.col("shared").isNull() & (F.col("cid") != F.col("pivot"))
    m = m.withColumn("a", F.coalesce("shared", "n")).withColumn(
        "f", F.when(unknown, F.col("n")).otherwise(F.col("n") - F.col("a") - F.coalesce("before", F.lit(0))))
    # what a class can share at most with any other of the list, against what it must share with any that it links to
    return m.filter((F.col("a") + F.col("f")) * den >= F.col("n") * num)


def _may_pair(num: int, den: int):
    """May the rows x and y of one list link, by size, position and bounds?"""
    bound = F.least("x.a", "y.a") + F.least("x.f", "y.f")
    return (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid"))
        & may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
        & (bound * (den + num) >= F.lit(num) * (F.col("x.n") + F.col("y.n")))
    )


def open_pairs(lists: DataFrame, measured: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of classes, of one list but of different components, whose overlap nothing bounds yet."""
    m = _bounded(lists, measured, num, den)
    m = m.join(comp, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid"))
    m = m.select("key", "cid", "comp", "n", "pos", "a", "f")
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    m = stored(m.join(mixed, "key", "left_semi"), "open")
    x, y = m.alias("x"), m.alias("y")
    ok = _may_pair(num, den) & (F.col("x.comp") != F.col("y.comp"))
    return x.join(y, ok).select(F.col("x.cid").alias("cid"), F.col("y.cid").alias("pivot")).distinct()


def all_pairs(lists: DataFrame, measured: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs of classes of one list, inside a component too, that may
    link and were not compared with each other as class and pivot.  A list is
    dealt to parts of about ``GROUP`` classes, each with a copy of the list."""
    m = stored(_bounded(lists, measured, num, den).select("key", "cid", "n", "pos", "a", "f"), "bounded")
    parts = m.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    m = m.join(parts, "key")
    x = m.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("x")
    y = m.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    pairs = x.join(y, _may_pair(num, den) & (F.col("x.part") == F.col("y.part"))).select(F.col("x.cid").alias("cid"), F.col("y.cid").alias("pivot"))
    done = measured.select(F.least("cid", "pivot").alias("cid"), F.greatest("cid", "pivot").alias("pivot"))
    return pairs.distinct().join(done, ["cid", "pivot"], "left_anti")


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM,
                    den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text of 1 to k-1 words is one shingle, its whole sequence.  A text
    without words, or null, has none and links with nothing: its component
    is its own id.  A row without an id gets its n_shingles and a null
    component, and no document reaches another through it.  Repeated rows
    all stay.  Rows that share an id but differ in text are linked each by
    its own text.  An empty table gives an empty result; other columns are
    ignored."""
    return _named(_join(docs, id_col, text, k, num, den))


@dataclass
class _Joined:
    """What the join found.  ``named``: cid, component_id, and whether the
    class represents its component."""

    sets: DataFrame
    classes: DataFrame
    lists: DataFrame
    measured: DataFrame
    comp: DataFrame
    named: DataFrame
    known: DataFrame
    run: Callable
    seed: int


def _named(found: _Joined) -> DataFrame:
    out = found.sets.join(found.named, "cid", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _join(docs: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> _Joined:
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for seed in range(8):
        first = stored(docs.mapInPandas(_first_pass(k, seed), _FIRST), "shingle-sets")
        sets = first.filter("chunk is null").select("doc_id", "n_shingles", "cid", "digest")
        classes = sets.filter("doc_id is not null and cid is not null").groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")
        )
        classes = stored(classes, "classes")
        if classes.filter("lo <> hi").isEmpty():  # two sets under one class id: take other ids
            break
    else:
        raise RuntimeError("class ids collide under every seed")
    counts = sketch_counts(first)
    by_size = classes.groupBy(F.least("n", F.lit(MAX_BOUNDARY + 1)).alias("n")).count().collect()
    boundary = choose_boundary({r["n"]: r["count"] for r in by_size}, counts, num, den)
    over = np.maximum(0, counts - np.int64(np.median(counts)))
    heavy = np.where(over > SALT_FROM, np.minimum(-(-over // SALT_FROM), (1 << _SALT_BITS) - 2), 0).astype(np.uint16)
    shared = spark.sparkContext.broadcast((frequency_levels(counts), heavy, boundary))
    lists = stored(lists_of_two(listed_keys(docs, k, seed, shared, num, den)), "lists")
    lists = stored(with_pivots(lists), "pivots")
    run = _compare(k, seed, shared, num, den)
    known = docs.filter("doc_id is not null and text is not null")
    near = lists.filter(may_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"), num, den))
    measured = stored(compare(near.select("cid", "pivot"), known, classes, run), "measured")
    link = is_link("n", "n_pivot", "shared", num, den)
    links = measured.filter(link).select("cid", "pivot")
    comp = components(links, "cid", "pivot")
    rest = stored(compare(open_pairs(lists, measured, comp, num, den), known, classes, run).filter(link).select("cid", "pivot"), "rest")
    if not rest.isEmpty():
        comp = components(links.unionByName(rest), "cid", "pivot")
    roots = classes.join(comp, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("component", "cid").alias("root"))
    # rows under one id may differ in text, so of a component's classes several may have its smallest id
    least = roots.groupBy("root").agg(F.min(F.struct("rep", "cid")).alias("l"))
    named = roots.join(least, "root").select("cid", F.col("l.rep").alias("component_id"), (F.col("cid") == F.col("l.cid")).alias("first"))
    return _Joined(sets, classes, lists, measured, comp, named, known, run, seed)


def links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM,
          den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link between different shingle sets, those
    inside a component too, and who has which set.

    ``pairs``: cid, other (cid < other), n, n_other, shared, each pair once.
    ``members``: doc_id, cid, one row per row of ``docs`` with an id and words.
    Members of one class link as well and are not listed pair by pair.  The
    pairs of a group of m near copies are up to m^2 / 2, and so is the work."""
    found = _join(docs, id_col, text, k, num, den)
    rest = compare(all_pairs(found.lists, found.measured, num, den), found.known, found.classes, found.run)
    linked = found.measured.unionByName(rest).filter(is_link("n", "n_pivot", "shared", num, den))
    up = F.col("cid") < F.col("pivot")
    pairs = linked.select(
        F.least("cid", "pivot").alias("cid"), F.greatest("cid", "pivot").alias("other"), F.when(up, F.col("n")).otherwise(F.col("n_pivot")).alias("n"),
        F.when(up, F.col("n_pivot")).otherwise(F.col("n")).alias("n_other"), "shared",
    ).distinct()
    return stored(pairs, "links"), found.sets.filter("doc_id is not null and cid is not null").select("doc_id", "cid")


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, cid, n_links per row of ``members``: how many other rows it links
    with, its copies included.  Nothing is multiplied by the number of copies."""
    size = members.groupBy("cid").agg(F.count("*").alias("size"))
    both = pairs.select("cid", "other").union(pairs.select("other", "cid"))
    near = both.join(size.select(F.col("cid").alias("other"), "size"), "other").groupBy("cid").agg(F.sum("size").alias("near"))
    per = size.join(near, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return members.join(per, "cid").select("doc_id", "cid", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    id.  Documents without words, and rows without an id, all stay.  Rows
    that share an id are decided each by its own text: texts of different
    components stay apart, and of rows with one id and an equal shingle set,
    or in one component, one stays."""
    found = _join(docs, id_col, text, k, num, den)
    first = stored(found.named.filter("first").select("cid", "component_id"), "kept")
    chosen = F.col("cid").isNull() | (F.col("component_id") == F.col("doc_id"))
    keep = found.sets.filter("doc_id is not null").join(first, "cid", "left").groupBy(F.col("doc_id").alias("__keep")).agg(
        F.count("*").alias("__rows"), F.max(chosen).alias("__any")).filter("__any")
    keep = stored(keep.select("__keep", "__rows"), "keep")
    single = keep.filter(F.col("__rows") == 1).select("__keep")
    once = docs.join(single, F.col(id_col) == F.col("__keep"), "left_semi")

    seed = found.seed

    @F.pandas_udf("long")
    def class_of(col):
        sets = (shingles(t, k) for t in col)
        return pd.Series(longs(identity(h, seed)[0] if len(h) else None for h in sets))

    # repeated ids are rare: their texts are read again only where there are any
    several = keep.filter(F.col("__rows") > 1).select(F.col("__keep").alias("__id"))
    out = once.unionByName(docs.filter(F.col(id_col).isNull()))
    if several.isEmpty():
        return out
    # stored, so that classes are computed for these rows only
    rows = stored(docs.join(several, F.col(id_col) == F.col("__id"), "left_semi"), "repeated")
    many = rows.select("*", class_of(F.col(text)).alias("__cid"))
    apart = first.select(F.col("cid").alias("__of"), F.col("component_id").alias("__id"))
    same = many.join(apart, (F.col(id_col) == F.col("__id")) & (F.col("__cid") == F.col("__of")), "left_semi")
    many = same.dropDuplicates([id_col, "__cid"]).unionByName(many.filter(F.col("__cid").isNull())).select(*docs.columns)
    return out.unionByName(many)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents"))


def _sql() -> str:
    from .decontam import shingle_sql

    return f"""
WITH RECURSIVE s AS ({shingle_sql('documents', 'doc_id')}),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE {DEN} * o >= {NUM} * (nx.n + ny.n - o)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.x, r.reach FROM r JOIN u ON u.y = r.doc_id)
SELECT d.doc_id, COALESCE(MAX(n.n), 0) AS n_shingles, MIN(r.reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
