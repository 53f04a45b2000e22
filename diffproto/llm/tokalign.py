"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizations of one text give two rising sequences of byte offsets at
which tokens end.  Where both end, the text is cut; the tokens between two
cuts are a group, and every A token of a group is linked with every B token
of it.  The two sequences are merged without walking them: diagonals at equal
distances through the merge are located by binary search, which divides the
work into independent pieces of the same length; each piece emits the overlaps
inside it, and a group that lies across a boundary is stitched from what the
pieces on both sides of it have emitted.  The texts of a batch lie one after
the other, so a long text is many pieces and many short ones are one.

Corpus-wide counts of linked id pairs, in how many documents each is found,
are summed in each task before they are shuffled.  Looking them up again is a
join by pair that is split by frequency: at most ``HEAVY`` of the most
frequent pairs are broadcast, the rest is shuffled, where no pair has many rows.

Encoding is piecewise (``pieces``): both tokenizers are asked once per
distinct piece of text, as far as their vocabularies allow.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .common import read, stored
from .pieces import ByteLevel, Pieces, byte_signs, joined, ragged

WORK = 1 << 16  # ends merged in a piece
HEAVY = 200_000  # pairs that are broadcast
DENSE = 4096  # links of a group that are listed one by one
SLICE = 1 << 21  # links that are listed together
CHARS = 1 << 20  # bytes of text in a run; a longer text is a run of its own
DOCS = 1024  # texts in a run
FLUSH = 1 << 18  # distinct pairs that a task gathers before it passes their counts on
REMEMBER = 400_000  # pieces of text, in a worker
BITS = 20  # of an id, at most


# ---------------------------------------------------------------- merge path

def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals at multiples of ``work`` meet the path that merges
    the sorted ``a`` and ``b`` (equal values: a's first): how many of a and of
    b lie before each.  All diagonals are searched together."""
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    lo, hi = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        ahead = np.zeros(len(diagonal), dtype=bool)
        ahead[open_] = a[mid[open_]] <= b[diagonal[open_] - 1 - mid[open_]]
        lo, hi = np.where(open_ & ahead, mid + 1, lo), np.where(open_ & ~ahead, mid, hi)
    return lo, diagonal - lo


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece: the places in ``a`` and in ``b`` of the ends they share."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(a, b)
    j = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == b)
    return at[j], j


def shared_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b``, both strictly rising, of the ends they
    share.  Pieces are independent; an end that a has on one side of a
    boundary and b on the other is stitched in between."""
    i, j = merge_path(a, b, work)
    got = []
    for k in range(len(i) - 1):
        # a's last before the boundary may equal b's first behind it
        if 0 < i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:
            got.append((i[k: k + 1] - 1, j[k: k + 1]))
        x, y = overlaps(a[i[k]: i[k + 1]], b[j[k]: j[k + 1]])
        got.append((x + i[k], y + j[k]))
    return tuple(np.concatenate([g[s] for g in got]) if got else np.zeros(0, dtype=np.int64) for s in (0, 1))


# ---------------------------------------------------------------- links

def links(doc: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, times): each group's product, as distinct keys
    doc << 2 BITS | a << BITS | b, rising, and how often each occurs.  ``na``
    and ``nb`` are the groups' sizes; a large group goes by its distinct ids."""
    a0, b0 = np.cumsum(na) - na, np.cumsum(nb) - nb
    n = na * nb
    keys, times = [], []

    def add(k, t=None):
        for to, x in zip((keys, times), _distinct(k, t), strict=True):
            to.append(x)

    small = np.flatnonzero(n <= DENSE)
    cut = np.searchsorted(np.cumsum(n[small]), np.arange(SLICE, int(n[small].sum()) + SLICE, SLICE), side="left") + 1
    for g in np.split(small, np.unique(cut[cut < len(small)])):
        own, t = np.repeat(g, n[g]), ragged(np.zeros(len(g), dtype=np.int64), n[g])
        add(doc[own] << 2 * BITS | a[a0[own] + t // nb[own]] << BITS | b[b0[own] + t % nb[own]])
    for g in np.flatnonzero(n > DENSE):
        x, nx = np.unique(a[a0[g]: a0[g] + na[g]], return_counts=True)
        y, ny = np.unique(b[b0[g]: b0[g] + nb[g]], return_counts=True)
        step = max(1, SLICE // len(y))
        for s in range(0, len(x), step):
            pair = (doc[g] << 2 * BITS | x[s: s + step, None] << BITS | y[None, :]).ravel()
            add(pair, np.outer(nx[s: s + step], ny).ravel())
    if len(keys) == 1:
        return keys[0], times[0]
    return _distinct(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their times (each once by default)."""
    if times is None:
        return np.unique(keys, return_counts=True)
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times[by], at) if len(keys) else times


# ---------------------------------------------------------------- tokenizers

def byte_level_bytes(tokens: list[str]) -> list[bytes]:
    """A byte-level vocabulary's entries as bytes."""
    byte = {c: b for b, c in byte_signs().items()}
    return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]


class Both:
    """Two tokenizers as one memory of pieces: ids of A, ids of B, and whether
    the bytes of both are the piece's."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        words = [b""] * (vocab[-1][1] + 1)
        for (_, i), w in zip(vocab, byte_level_bytes([t for t, _ in vocab]), strict=True):
            words[i] = w
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(names))]
        other = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() if plain[i] else b""
                 for i, t in enumerate(names)]
        self.words = [words, other]
        self.size = [np.array([len(w) for w in x], dtype=np.int64) for x in self.words]
        self.table = [pa.array(x, type=pa.large_binary()) for x in self.words]
        if max(map(len, self.words)) > 1 << BITS:
            raise ValueError(f"vocabularies of more than 2^{BITS} entries")
        own = [t for i, t in enumerate(names) if plain[i]]
        self.space = self.b.piece_to_id("▁")
        # a piece may begin at white space that no entry of B holds behind another character
        glue = bytes(c for c in (9, 10, 11, 12, 13) if any(chr(c) in t for t in own))
        joins = self.b.is_unknown(self.space) or any(re.search("[^▁]▁", t) for t in own)
        self.level = ByteLevel(self.a)
        self.pieces = Pieces(self.learn, ["<i4", "<i4", "|u1"], glue + b" \t\n\x0b\x0c\r" * joins, most=REMEMBER)

    def learn(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        a, na = self.level.learn(pieces)
        # B writes a space before a text: it is the one that the piece begins with, or goes again
        spaced = [p[:1] == b" " for p in pieces]
        got = self.b.encode([p[x:].decode() for p, x in zip(pieces, spaced, strict=True)], num_threads=1) if pieces else []
        got = [(g or [self.space]) if x else g[1:] if g[:1] == [self.space] else [0] for g, x in zip(got, spaced, strict=True)]
        nb = np.fromiter(map(len, got), dtype=np.int32, count=len(got))
        b = np.fromiter((i for g in got for i in g), dtype=np.int32, count=int(nb.sum()))
        ok = self._spell(0, a, na, pieces) & self._spell(1, b, nb, pieces)
        return [(a, na), (b, nb), (ok.astype("|u1"), np.ones(len(pieces), dtype=np.int32))]

    def _spell(self, k: int, ids: np.ndarray, n: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes, joined, are the piece."""
        whole = self.table[k].take(pa.array(ids))
        if b"".join(pieces) == (whole.buffers()[2].to_pybytes() if len(ids) else b""):
            ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
            if (np.append(0, np.cumsum(self.size[k][ids]))[np.cumsum(n)] == ends).all():
                return np.ones(len(pieces), dtype=bool)
        end = np.cumsum(n)
        words = self.words[k]
        return np.array([b"".join(words[i] for i in ids[e - c: e]) == p for p, e, c in zip(pieces, end, n, strict=True)], dtype=bool)


@functools.lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    """One memory for all tasks of a worker."""
    return Both(path_a, path_b)


@functools.lru_cache(maxsize=2)
def _decimals(n_a: int, n_b: int) -> pa.Array:
    """Ids as text: A's followed by a comma, then by a bar; B's by a comma, then by a semicolon."""
    return pa.array([f"{i}{c}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for c in (",", last)], type=pa.large_binary())


class Aligned:
    """What a run of texts gives: per text n_a, n_b, n_groups, n_links and the
    groups' digest; per text and id pair, how often it is linked."""

    def __init__(self, tok: Both, texts: list[str | None], work: int = WORK):
        n = len(texts)
        data, ends = joined([(" " + t).encode() if t else b"" for t in texts])
        slots, begins = tok.pieces.slots(data, ends) if len(data) else (np.zeros(0, dtype=np.int64),) * 2
        doc = np.searchsorted(ends, begins, side="right")
        good = np.ones(n, dtype=bool)
        good[doc[tok.pieces.gather(slots, 2)[0] == 0]] = False
        slots, doc = slots[good[doc]], doc[good[doc]]
        (a, pa_), (b, pb) = (tok.pieces.gather(slots, k) for k in (0, 1))
        ends_a, ends_b = np.cumsum(tok.size[0][a]), np.cumsum(tok.size[1][b])
        i, j = shared_ends(ends_a, ends_b, work)
        na, nb = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        doc_a = np.repeat(doc, pa_)
        of = doc_a[i]  # a group's text
        self.n_a, self.n_b = (np.bincount(doc, weights=w, minlength=n).astype(np.int64) for w in (pa_, pb))
        self.n_groups = np.bincount(of, minlength=n)
        self.n_links = np.bincount(of, weights=(na * nb).astype(float), minlength=n).astype(np.int64)
        self.keys, self.times = links(of, a.astype(np.int64), na, b.astype(np.int64), nb)
        self.sha = self._digests(tok, a, b, i, j, na, nb)

    def _digests(self, tok, a, b, i, j, na, nb) -> list[str]:
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[i] = last_b[j] = 1
        order = np.empty(len(a) + len(b), dtype=np.int64)
        # a group's A tokens stand behind all B tokens of earlier groups, its B tokens behind its own A tokens too
        order[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = 2 * a.astype(np.int64) + last_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = 2 * len(tok.words[0]) + 2 * b.astype(np.int64) + last_b
        text = _decimals(len(tok.words[0]), len(tok.words[1])).take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], dtype=np.int64)[: len(order) + 1] if len(order) else np.zeros(1, dtype=np.int64)
        view = memoryview(text.buffers()[2]) if len(order) else memoryview(b"")
        end = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(view[at[e - c]: at[e] - 1]).hexdigest() if c else "" for e, c in zip(end, self.n_a + self.n_b, strict=True)]


# ---------------------------------------------------------------- on Spark

def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        own = len(t) if t else 0
        if k > start and (k - start >= DOCS or size + own > CHARS):
            yield start, k
            start, size = k, 0
        size += own
    if start < len(texts):
        yield start, len(texts)


_FIELDS = [("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
           ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
_SCHEMA = ("kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<long>")
_MASK = (1 << 2 * BITS) - 1


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def aligned_rows(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text: str = "text", work: int = WORK) -> str:
    """Aligns every text and writes, by ``kind``, 0: a row per document with
    its figures and its linked pairs (a << BITS | b) with their times; 1:
    pairs with the number of documents of a task's part that hold them.
    Returns the folder."""
    spark = docs.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "aligned")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        tok = both(tokenizer_a, tokenizer_b)
        pairs, docs_of, held = [], [], 0

        def counts(keep: int):
            nonlocal pairs, docs_of, held
            if not pairs:
                return
            p, n = _distinct(np.concatenate(pairs), np.concatenate(docs_of))
            pairs, docs_of, held = [p], [n], len(p)
            if held <= keep:
                return
            for s in range(0, len(p), 1 << 16):
                m = len(p[s: s + (1 << 16)])
                one = {"kind": pa.array([1], pa.int32()), "pairs": _lists(p[s: s + m], np.array([m])), "times": _lists(n[s: s + m], np.array([m]))}
                yield pa.RecordBatch.from_arrays([one.get(c, pa.nulls(1, t)) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])
            pairs, docs_of, held = [], [], 0

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in _runs(texts):
                got = Aligned(tok, texts[s:e], work)
                pair = got.keys & _MASK
                per = np.bincount(got.keys >> 2 * BITS, minlength=e - s)
                p, n = _distinct(pair)
                pairs.append(p), docs_of.append(n)
                held += len(p)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(e - s, dtype=np.int32)), batch.column("row").slice(s, e - s), batch.column("doc_id").slice(s, e - s),
                    *(pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)), pa.array(got.sha, pa.string()),
                    _lists(pair, per), _lists(got.times.astype(np.int64), per)], names=[c for c, _ in _FIELDS])
                if held > 4 * FLUSH:
                    yield from counts(FLUSH)
        yield from counts(-1)

    rows.mapInArrow(run, _SCHEMA).write.partitionBy("kind").parquet(path)
    return path


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether
    none of its A id's pairs is in more."""
    parts = spark.read.schema(_SCHEMA).parquet(path).filter("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stored(parts.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")), "pair-counts")
    # one row per id of A: bounded by its vocabulary
    top = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("top"))
    return stored(
        counts.join(F.broadcast(top), F.shiftright("pair", BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-best")


def frequent_from(counts: DataFrame, most: int) -> int:
    """A number such that at most ``most`` pairs are in as many documents (one row per power of two is collected)."""
    per = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    k, total = max(per, default=0) + 1, 0
    while k > 0 and total + per.get(k - 1, 0) <= most:
        k -= 1
        total += per.get(k, 0)
    return 1 << k


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text: str = "text", work: int = WORK,
          heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256), one row per row of ``docs``.

    A is a byte-level tokenizers file, asked for a space and the text; B a
    sentencepiece model that writes that space itself.  Special tokens'
    strings are plain text.  Texts that are null or empty, or whose tokens'
    bytes, joined, are not the space and the text, have no tokens: zeros and
    an empty digest.  A text of any length is aligned whole.  Rows are told
    apart by place, so repeated rows and ids, or no id, are documents of their
    own; an empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    path = aligned_rows(docs, tokenizer_a, tokenizer_b, id_col, text, work)
    counts = pair_counts(spark, path)
    per = spark.read.schema(_SCHEMA).parquet(path).filter("kind = 0")
    linked = per.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("p"), F.col("x.times").alias("t"))
    edge = frequent_from(counts, heavy)
    often, seldom = counts.filter(F.col("n") >= edge), counts.filter(F.col("n") < edge)
    on = F.col("p") == F.col("pair")
    sums = [F.sum(F.when(F.col("best"), F.col("t")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum")]
    first = linked.join(F.broadcast(often), on).groupBy("row").agg(*sums)
    rest = linked.join(F.broadcast(often.select("pair")), on, "left_anti").join(seldom, on).groupBy("row").agg(*sums)
    total = first.unionByName(rest).groupBy(F.col("row").alias("r")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return per.join(total, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"), *(tokenizers or default_tokenizers()))
