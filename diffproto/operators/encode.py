"""Text -> vector encoders and token pooling.

Two kinds of encoder:

* ``HashingEncoder(d)`` -- bag of words hashed into d buckets, L2-normalised,
  written entirely as Column expressions: each text is encoded in place,
  inside the scan stage, with no shuffle.
* ``PandasEncoder(fn, dim)`` -- any batch model (``fn(pd.Series[str]) ->
  ndarray (n, dim)``), run with ``mapInPandas`` over Arrow batches.  Texts
  are de-duplicated first (keyed by md5) so a claim shared by many pairs is
  encoded once, then joined back.  ``EncodingStore`` keeps encodings for
  later runs.

``pool_tokens`` turns token vectors into one text vector (mean / max /
first token), and ``LookupPoolEncoder`` combines both: tokens are hashed
into a vocabulary table of vectors and pooled.
"""

from __future__ import annotations

import functools
import urllib.parse
import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hex8_to_int
from ..functions.vectors import l2_normalize
from ..session import scratch_table
from ..sources import manifest
from .joins import frequent_keys, skew_join

# Token rule shared with the SQL oracle: lower-case, split on every run of
# characters that are neither letters nor digits, drop empty tokens.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element array and
    ``transform`` act as a let binding)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(_col(text)), TOKEN_SPLIT), lambda t: t != F.lit(""))


def token_buckets(text, d: int, hash_fn: str = "md5") -> Column:
    """Bucket of every token.  ``md5`` (first 8 hex digits) has an exact
    DuckDB twin; ``xxhash64`` is native and faster, for production runs."""
    if hash_fn == "md5":
        return F.transform(tokens(text), lambda t: F.pmod(hex8_to_int(F.md5(t)), F.lit(d)))
    if hash_fn == "xxhash64":
        return F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(d)))
    raise ValueError(f"unknown hash {hash_fn!r}")


class HashingEncoder:
    """Hashed bag of words, L2-normalised; a text without tokens gives zeros."""

    def __init__(self, d: int = 64, name: str | None = None, hash_fn: str = "md5"):
        self.d = int(d)
        self.hash_fn = hash_fn
        self.name = name or f"hashing-{self.d}"

    def counts(self, buckets) -> Column:
        """Bucket counts as a dense vector of d doubles.

        Native array functions do the per-token work: sort the bucket ids,
        take the distinct ones, find each one's first position; the count of
        a bucket is the gap to the next distinct bucket.  Lambdas then run
        about 3 d times per text instead of d times per token.  Intermediate
        arrays are bound once with ``_let`` so Catalyst cannot re-evaluate
        them inside a lambda."""
        d = self.d
        zeros = F.array_repeat(F.lit(0.0), F.lit(d))

        def dense(srt):
            return _let(F.array_distinct(srt), lambda dis: _let(
                F.transform(dis, lambda v: F.array_position(srt, v)), lambda first: _let(
                    F.map_from_arrays(dis, F.zip_with(F.concat(F.slice(first, 2, F.size(first)),
                                                               F.array((F.size(srt) + 1).cast("bigint"))),
                                                      first, lambda a, b: a - b)),
                    lambda cnt: F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(d - 1).cast("bigint")),
                                            lambda i: F.coalesce(F.element_at(cnt, i), F.lit(0)).cast("double")))))

        # a text without tokens is all zeros (and must not reach the map build)
        return _let(F.array_sort(_col(buckets)),
                    lambda srt: F.when(F.size(srt) == 0, zeros).otherwise(dense(srt)))

    def encode(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        """Adds ``out``; each stage is its own projection so the md5 of every
        token runs once (Catalyst keeps projections apart when collapsing
        them would repeat a costly expression)."""
        b = f"_{out}_b"
        return (df.withColumn(b, token_buckets(text_col, self.d, self.hash_fn))
                .withColumn(out, l2_normalize(self.counts(b)))
                .drop(b))

    def encode_pairs(self, pairs: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
        return self.encode(self.encode(pairs, claim, "claim_vec"), evidence, "evidence_vec")


_LOADED: dict[str, Callable] = {}


def _loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model, loaded once in a worker whatever number of tasks it runs."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


class PandasEncoder:
    """A batch model run with ``mapInPandas`` on de-duplicated texts.

    ``fn(texts) -> (n, dim)`` is the model itself; ``load() -> fn`` loads it,
    once per worker, under ``name``."""

    def __init__(self, fn: Callable | None = None, dim: int = 0, name: str = "pandas", load: Callable[[], Callable] | None = None,
                 batch: int = 1024):
        if (fn is None) == (load is None):
            raise ValueError("give fn or load")
        self.fn, self.load = fn, load
        self.dim = int(dim)
        self.name = name
        self.batch = int(batch)

    def keyed(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """The distinct texts with their digest; a text that many rows hold is reduced map-side."""
        return (texts.filter(F.col(text_col).isNotNull())
                .select(F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
                .dropDuplicates(["text_key"]))

    def encode_keyed(self, keyed: DataFrame) -> DataFrame:
        """``(text_key, vec)`` of ``(text_key, text)``.  Texts go to the model
        by length, so a batch's texts are about equally long, and ``batch``
        at a time."""
        from ..session import ship_package

        ship_package(keyed.sparkSession)
        fn, load, name, size, dim = self.fn, self.load, self.name, self.batch, self.dim

        def run(batches):
            import numpy as np
            import pandas as pd

            model = fn or _loaded(name, load)
            for pdf in batches:
                for a in range(0, len(pdf), size):
                    part = pdf.iloc[a: a + size]
                    mat = np.asarray(model(part["text"]), dtype="float64")
                    if mat.shape != (len(part), dim):
                        raise ValueError(f"encoder {name!r} gave {mat.shape} for {len(part)} texts, not {dim} values each")
                    yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "vec": list(mat)})

        by_length = keyed.withColumn("_n", F.length("text")).sortWithinPartitions("_n").drop("_n")
        return by_length.mapInPandas(run, ENCODING_SCHEMA)

    def encode_texts(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """``(text_key, vec)`` for the distinct texts of ``texts``."""
        return self.encode_keyed(self.keyed(texts, text_col))

    def encode_pairs(self, pairs: DataFrame, claim: str = "claim", evidence: str = "evidence", store: EncodingStore | None = None) -> DataFrame:
        """Adds ``claim_vec`` and ``evidence_vec``, null for a null text.  With
        a ``store``, texts it holds are not encoded again.  A text that many
        pairs share is joined by several tasks."""
        both = pairs.select(F.col(claim).alias("text")).unionByName(pairs.select(F.col(evidence).alias("text")))
        if store is not None:
            store.fill(both, self)
            vecs = store.encodings(self)
        else:
            vecs = self.encode_texts(both)
        out = pairs.withColumn("_ck", F.md5(F.col(claim))).withColumn("_ek", F.md5(F.col(evidence)))
        for key, other, vec in (("_ck", "_ek", "claim_vec"), ("_ek", "_ck", "evidence_vec")):
            often = frequent_keys(pairs.select(F.md5(F.col(claim if key == "_ck" else evidence)).alias(key)), key)
            out = skew_join(out, vecs.select(F.col("text_key").alias(key), F.col("vec").alias(vec)), key, [other, *[c for c in pairs.columns if c in KEY]],
                            "left", often)
        return out.drop("_ck", "_ek")


KEY = ("claim_id", "set_pos")
ENCODING_SCHEMA = T.StructType([T.StructField("text_key", T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


class EncodingStore:
    """Encodings that outlive a run: a table by encoder and text digest under
    ``path``.  ``fill`` finds the texts that are not in it by an anti join,
    encodes only these and commits them; a fill that fails leaves nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, encoder: PandasEncoder) -> str:
        return f"{self.path}/{urllib.parse.quote(encoder.name, safe='')}-{encoder.dim}"

    def encodings(self, encoder: PandasEncoder) -> DataFrame:
        """``(text_key, vec)``, one row per text; two fills at the same time may
        both have encoded a text, and one of the equal rows is taken."""
        got = manifest.read(self.spark, self._at(encoder), ENCODING_SCHEMA)
        return got.dropDuplicates(["text_key"]) if len(manifest.committed(self.spark, self._at(encoder))) > 1 else got

    def fill(self, texts: DataFrame, encoder: PandasEncoder, text_col: str = "text") -> int:
        """Encodes what is missing; returns the number of texts encoded."""
        known = manifest.read(self.spark, self._at(encoder), ENCODING_SCHEMA).select("text_key")
        missing = scratch_table(encoder.keyed(texts, text_col).join(known, "text_key", "left_anti"), "missing-texts")
        n = missing.count()
        if n:
            manifest.append(encoder.encode_keyed(missing), self._at(encoder), uuid.uuid4().hex)
        return n


POOL_MODES = ("mean", "max", "cls")
LARGE = 1 << 16  # rows of a group that are combined before the shuffle


def pool_tokens(token_vecs: DataFrame, group_cols: Sequence[str], vec_col: str = "vec",
                pos_col: str = "pos", mode: str = "mean", weight_col: str | None = None,
                out: str = "vec", large: DataFrame | None = None) -> DataFrame:
    """Pool token vectors into one vector per group.

    ``mean``: element-wise (weighted) mean; ``max``: element-wise max;
    ``cls``: the vector of the first token (smallest ``pos_col``).
    ``large`` is ``large_groups`` of the rows, if known already; finding them
    reads ``token_vecs`` once more.
    """
    group_cols = list(group_cols)
    if mode == "cls":
        return token_vecs.groupBy(*group_cols).agg(F.min_by(F.col(vec_col), F.col(pos_col)).alias(out))
    if mode not in POOL_MODES:
        raise ValueError(f"unknown pooling mode {mode!r} (expected one of {POOL_MODES})")
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    agg = F.sum(F.col("_x") * F.col("_w")) / F.sum("_w") if mode == "mean" else F.max("_x")
    rows = token_vecs.select(*group_cols, w.alias("_w"), F.col(vec_col).alias("_vec"))
    pooled = _pool(rows, group_cols, "_vec", {"_v": agg}, large_groups(token_vecs, group_cols) if large is None else large)
    return pooled.select(*group_cols, F.col("_s").getField("_v").alias(out))


def large_groups(rows: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """The groups of more than ``LARGE`` rows: at most a ``LARGE``-th of all rows."""
    n = rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    return scratch_table(n.filter(F.col("_n") > LARGE).select(*group_cols), "large-groups")


def _pool(rows: DataFrame, group_cols: list[str], vec_col: str, aggs: dict[str, Column], large: DataFrame) -> DataFrame:
    """``aggs`` of every element ``_x`` of a group's vectors, as ``_s``, an array by place.

    Whole vectors are shuffled by group and taken apart behind the shuffle:
    an element of its own would carry its group's key and place along.  Rows
    of ``large`` groups are taken apart and combined before the shuffle, so
    that no task gets such a group."""

    def pooled(part: DataFrame) -> DataFrame:
        each = part.select(*[c for c in part.columns if c != vec_col], F.posexplode_outer(vec_col).alias("_p", "_x")).filter(F.col("_p").isNotNull())
        per_pos = each.groupBy(*group_cols, "_p").agg(*[a.alias(c) for c, a in aggs.items()])
        return per_pos.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("_p", *aggs))).alias("_s"))

    if large.isEmpty():
        return pooled(rows.repartition(*group_cols))
    few = large.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(group_cols)])
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(group_cols)])
    rest = rows.join(few, same, "left_anti").repartition(*group_cols)
    return pooled(rest).unionByName(pooled(rows.join(few, same, "left_semi")))


class LookupPoolEncoder:
    """Tokens hashed into a vocabulary of vectors, then pooled.

    ``vocab``: ``(vocab_id BIGINT, vec ARRAY<DOUBLE>)`` with ids 0..V-1.  The
    per-text token counts are aggregated first (one row per distinct bucket),
    so a 20,000-word text costs one row per distinct token bucket.
    """

    def __init__(self, vocab: DataFrame, vocab_size: int, name: str = "lookup"):
        self.vocab = vocab
        # an int, or a Column such as a scalar subquery counting the vocabulary
        self.vocab_size = vocab_size if isinstance(vocab_size, Column) else int(vocab_size)
        self.name = name

    def encode_all(self, texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
        """``(key, mean, max, cls)``: all three poolings from one tokenisation,
        one vocabulary join and one aggregate.  Token counts are stored, a
        sketch of them finds the vocabulary entries that many texts hold, and
        only those are copied; the rest of the vocabulary is joined as it is."""
        counts = scratch_table(self._tokens(texts, key_col, text_col).groupBy(key_col, "vocab_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")), "token-counts")
        tv = skew_join(counts, self.vocab, "vocab_id", [key_col])
        aggs = {"mean": F.sum(F.col("_x") * F.col("n")) / F.sum("n"), "max": F.max("_x"), "cls": F.min_by("_x", "first")}
        whole = _pool(tv.select(key_col, "n", "first", "vec"), [key_col], "vec", aggs, large_groups(counts, [key_col]))
        return whole.select(key_col, *[F.col("_s").getField(m).alias(m) for m in POOL_MODES])

    def _tokens(self, texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
        hashes = F.transform(tokens(text_col), lambda t: hex8_to_int(F.md5(t)))
        # the modulo is taken after the explode: the vocabulary size may be a
        # scalar subquery, which cannot sit inside a higher-order function
        return (texts.select(key_col, F.posexplode_outer(hashes).alias("pos", "_h"))
                .filter(F.col("pos").isNotNull())
                .select(key_col, "pos", F.pmod(F.col("_h"), F.lit(self.vocab_size)).alias("vocab_id")))

    def stored_tokens(self, texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
        """``(key, pos, vocab_id)`` of every token, in a table of its own."""
        return scratch_table(self._tokens(texts, key_col, text_col), "tokens")

    def token_vectors(self, toks: DataFrame, key_col: str) -> DataFrame:
        """``(key, pos, vec)``: the vector of every token of ``stored_tokens``, for ``pool_tokens``."""
        return skew_join(toks, self.vocab, "vocab_id", [key_col, "pos"]).select(key_col, "pos", "vec")
