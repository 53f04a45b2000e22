"""Registered queries: one per operator of the inventory.

Every query reads the driver tables (through the views of
``sources.tables``) at ``sf_dir`` and returns a DataFrame whose column names
match the SQL oracle in ``plans.oracle``.  Floating outputs are rounded to
4 decimals so that the two engines' summation orders do not matter.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.labels import CLAIM_LABELS, decode_binary, decode_three, encode_label, label_to_binary
from ..functions.text import clean_brackets, merge_sentences, normalize_claim, normalize_evidence
from ..operators import evaluate, sampling, summary
from ..operators.encode import POOL_MODES, EncodingStore, HashingEncoder, LookupPoolEncoder, PandasEncoder, large_groups, pool_tokens
from ..operators.prototypes import predict, prototypes
from ..sources import claims as C
from ..sources import runlogs
from ..sources import tables as TB
from . import experiment, sweep
from .broadcast import bounded_broadcast
from .sinks import ERROR_COLUMNS, read_errors, write_errors

R = 4
SEED = 123
M = 20
HASH_D = 64
# Caps of the reference (binary pool, corpus dev file), the feature of the queries that use them.
BINARY_CAPS = {0: 3333, 1: 1666, 2: 1667}
DEV_CAP = 70
# Drift grids of the reference (consecutive 1..100; from base 1).
DRIFT_SHOTS = list(range(1, 101))
DRIFT_BASE_SHOTS = [1, 2, 4, 6, 8, 10, 20, 30, 40, 50, 100]
SMALL_SEEDS = [123, 124, 125]
SMALL_SHOTS = [2, 10, 20]
NEUTRAL_SEED = 0

Query = Callable[[SparkSession, str], DataFrame]


def _r(c, n: int = R):
    return F.round(c, n)


# ---------------------------------------------------------------- helpers

def flagship_pairs(spark, sf) -> DataFrame:
    return experiment.with_diff(TB.vec_pairs(spark, sf))


def flagship_scored(spark, sf) -> DataFrame:
    return experiment.score(TB.vec_pairs(spark, sf), SEED, M, prepare=experiment.with_diff)


def nested_pairs(spark, sf) -> DataFrame:
    return C.flatten_pairs(TB.nested_claims(spark, sf))


def nested_scored(spark, sf) -> DataFrame:
    """Entry A on texts: nested claims -> pairs -> hashing encoder -> split
    (every other pair is a dev row, with dataset_index) -> prototypes ->
    labels; keys and labels only, stored."""
    return experiment.score_stored(nested_pairs(spark, sf), SEED, M, hashed_diff)


def nested_errors(spark, sf, scored: DataFrame) -> DataFrame:
    """Scored rows with their texts, which are read for them only."""
    return nested_pairs(spark, sf).drop("label").join(scored, list(sampling.KEY))


def hashed_diff(rows: DataFrame) -> DataFrame:
    return experiment.with_diff(HashingEncoder(HASH_D).encode_pairs(rows))


def binary_pairs(spark, sf) -> DataFrame:
    """The vector pairs of the two-way task: support against the rest."""
    return TB.vec_pairs(spark, sf).withColumn("label", label_to_binary("label"))


def binary_scored(spark, sf) -> DataFrame:
    return experiment.score(binary_pairs(spark, sf), SEED, M, binary=True, prepare=experiment.with_diff)


BINARY_LETTERS = ("s", "not")


def corpus_view(spark, sf) -> DataFrame:
    return TB.corpus(spark, sf)


def corpus_pairs_all(spark, sf) -> DataFrame:
    return C.corpus_pairs(TB.corpus_claims(spark, sf), corpus_view(spark, sf), NEUTRAL_SEED)


# ---------------------------------------------------------------- sources

def q_flatten_pairs(spark, sf):
    return nested_pairs(spark, sf)


def q_flatten_single(spark, sf):
    return C.flatten_pairs(TB.nested_claims(spark, sf), single_only=True)


def q_flatten_first_evidence(spark, sf):
    return C.flatten_first_evidence(TB.first_evidence_claims(spark, sf))


def q_scan_claims(spark, sf):
    from ..session import scratch_path

    path = scratch_path(spark, "nested-claims-jsonl")
    TB.nested_claims(spark, sf).write.mode("overwrite").json(path)
    back = C.scan_claims(spark, path)
    return back.select("claim_id", "claim", "label", F.size("sentences").alias("n_sentences"),
                       F.size("evidence_sets").alias("n_sets"))


def corpus_versions(spark, sf) -> DataFrame:
    """Two snapshots of the corpus: every document as version 0 and the
    English documents again, normalised line by line, as version 1."""
    docs = TB.table(spark, sf, "documents").select("doc_id", "lang")
    base = TB.corpus(spark, sf)
    v0 = base.withColumn("version", F.lit(0))
    v1 = (base.join(docs.filter(F.col("lang") == "en").select("doc_id"), "doc_id")
          .withColumn("abstract", F.transform("abstract", lambda s: normalize_evidence(s)))
          .withColumn("version", F.lit(1)))
    return v0.unionByName(v1)


def q_corpus_dedup(spark, sf):
    d = C.corpus_dedup(corpus_versions(spark, sf), order_col="version")
    return d.select("doc_id", "version", F.size("abstract").alias("n_sentences"),
                    F.array_join("abstract", "\n").alias("abstract_text"))


def q_corpus_pairs_gold(spark, sf):
    return C.corpus_pairs_gold(TB.corpus_claims(spark, sf), corpus_view(spark, sf))


def q_corpus_pairs_neutral(spark, sf):
    return C.corpus_pairs_neutral(TB.corpus_claims(spark, sf), corpus_view(spark, sf), NEUTRAL_SEED)


def q_corpus_pairs(spark, sf):
    return corpus_pairs_all(spark, sf)


# ---------------------------------------------------------------- projections

def q_encode_label(spark, sf):
    nc = TB.nested_claims(spark, sf)
    return nc.select("claim_id", F.col("label").alias("label_word"), encode_label("label", CLAIM_LABELS).alias("code"))


def q_decode_three(spark, sf):
    p = nested_pairs(spark, sf)
    return p.select("claim_id", "set_pos", "label", decode_three("label").alias("letter"))


def q_decode_binary(spark, sf):
    p = nested_pairs(spark, sf)
    return p.select("claim_id", "set_pos", "label", decode_binary("label").alias("letter"))


def q_label_to_binary(spark, sf):
    p = nested_pairs(spark, sf)
    return p.select("claim_id", "set_pos", "label", label_to_binary("label").alias("blabel"))


def q_union_classes(spark, sf):
    # the union of the classes' rows is one pass with the class as the key
    p = nested_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return p.filter(F.col("label").isin(*sampling.LABEL_CODES))


# Fixed values of a rule: these words of a text become bracket tokens, as the tables hold none.
BRACKETED = [(" of ", " -LRB- "), (" to ", " -RRB- "), (" the ", " -LSB- "), (" de ", " -RSB- "), (" and ", " -lrb- ")]


def with_brackets(c):
    out = F.col(c)
    for word, token in BRACKETED:
        out = F.replace(out, F.lit(word), F.lit(token))
    return out


def q_clean_brackets(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", with_brackets("text").alias("text"))
    return d.select("doc_id", clean_brackets("text").alias("text"))


def q_normalize_text(spark, sf):
    p = TB.text_pairs(spark, sf).withColumn("claim", with_brackets("claim")).withColumn("evidence", with_brackets("evidence"))
    return p.select("claim_id", "set_pos", normalize_claim("claim").alias("claim"),
                    normalize_evidence("evidence").alias("evidence"))


def q_merge_sentences(spark, sf):
    return TB.corpus(spark, sf).select("doc_id", merge_sentences("abstract").alias("merged"))


# ---------------------------------------------------------------- sampling

def q_fit_sample(spark, sf):
    p = TB.vec_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.fit_sample(p, SEED, M)


def q_dev_complement(spark, sf):
    p = TB.vec_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.dev_complement(p, SEED, M)


def q_cap_per_class(spark, sf):
    p = TB.vec_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.cap_per_class(p, SEED, BINARY_CAPS)


def q_dev_capped(spark, sf):
    p = nested_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.dev_capped(p, SEED, DEV_CAP)


def q_binary_split(spark, sf):
    p = nested_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.binary_split(p, SEED, M)


def q_binary_split_capped(spark, sf):
    """Three-way caps first, then the merged pool is ranked again."""
    p = TB.vec_pairs(spark, sf).select("claim_id", "set_pos", "label")
    return sampling.binary_split(p, SEED, M, BINARY_CAPS)


def q_split_counts(spark, sf):
    b = q_binary_split(spark, sf)
    return evaluate.split_counts(b, "split", "blabel").withColumnRenamed("blabel", "label")


def q_prefix_property(spark, sf):
    """Per (seed, class, m): size of the m-shot sample and how many of its
    rows are inside the next larger sample of the grid."""
    p = TB.vec_pairs(spark, sf).select("claim_id", "set_pos", "label")
    shots = sweep.REFERENCE_SHOTS
    ranked = sampling.top_per_class(p, SMALL_SEEDS, max(shots))
    nxt = {a: b for a, b in zip(shots, shots[1:] + [shots[-1]])}
    grid = F.array(*[F.struct(F.lit(a).alias("m"), F.lit(b).alias("m_next")) for a, b in nxt.items()])
    g = ranked.select("seed", "label", "rank", F.explode(grid).alias("g")).filter(F.col("rank") <= F.col("g.m"))
    return (g.groupBy("seed", "label", F.col("g.m").alias("m"))
            .agg(F.count(F.lit(1)).alias("n_fit"),
                 F.sum(F.when(F.col("rank") <= F.col("g.m_next"), 1).otherwise(0)).cast("bigint").alias("n_in_next")))


# ---------------------------------------------------------------- vectors

def _vp(spark, sf):
    return TB.vec_pairs(spark, sf)


def q_pair_diff_abs(spark, sf):
    d = V.diff("evidence_vec", "claim_vec", True)
    return _vp(spark, sf).select("pair_id", d.alias("d")).select(
        "pair_id", _r(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("diff_sum"),
        _r(V.norm("d")).alias("diff_norm"), _r(F.array_max("d")).alias("diff_max"))


def q_pair_diff_signed(spark, sf):
    d = V.diff("evidence_vec", "claim_vec", False)
    return _vp(spark, sf).select("pair_id", d.alias("d")).select(
        "pair_id", _r(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("diff_sum"),
        _r(V.norm("d")).alias("diff_norm"), _r(F.array_min("d")).alias("diff_min"))


def _pair_metric(fn):
    def q(spark, sf):
        return _vp(spark, sf).select("pair_id", _r(fn("claim_vec", "evidence_vec")).alias("value"))
    return q


def q_vec_norm(spark, sf):
    return _vp(spark, sf).select("pair_id", _r(V.norm("claim_vec")).alias("claim_norm"),
                                 _r(V.norm("evidence_vec")).alias("evidence_norm"))


def q_encode_hashing(spark, sf):
    enc = HashingEncoder(HASH_D)
    p = enc.encode_pairs(TB.text_pairs(spark, sf))
    nnz = lambda v: F.size(F.filter(v, lambda x: x != 0))
    ssum = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return p.select("claim_id", "set_pos",
                    _r(ssum("claim_vec")).alias("claim_sum"), _r(ssum("evidence_vec")).alias("evidence_sum"),
                    nnz("claim_vec").cast("bigint").alias("claim_nnz"),
                    nnz("evidence_vec").cast("bigint").alias("evidence_nnz"),
                    _r(V.dot("claim_vec", "evidence_vec")).alias("dot"))


def lookup_encoder(spark, sf) -> LookupPoolEncoder:
    """Tokens hashed into the embeddings table used as a vocabulary (size = its row count)."""
    emb = TB.table(spark, sf, "embeddings")
    vocab = emb.select(F.col("vec_id").alias("vocab_id"), V.as_double("embedding").alias("vec"))
    return LookupPoolEncoder(vocab, emb.agg(F.count(F.lit(1))).scalar())


def claim_texts(spark, sf) -> DataFrame:
    return TB.text_pairs(spark, sf).select(
        F.concat_ws(":", F.col("claim_id").cast("string"), F.col("set_pos").cast("string")).alias("text_key"),
        F.col("claim").alias("text"))


def _pooled_digest(pooled: DataFrame) -> DataFrame:
    return pooled.select("text_key", "mode", _r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"),
                         _r(V.norm("vec")).alias("vec_norm"))


def q_pool_tokens(spark, sf):
    """Claims pooled by mean, max and first token, from counts of tokens."""
    pooled = lookup_encoder(spark, sf).encode_all(claim_texts(spark, sf), "text_key", "text")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("vec")) for m in POOL_MODES])
    return _pooled_digest(pooled.select("text_key", F.inline(modes)))


def q_pool_token_vectors(spark, sf):
    """The same poolings of a table of token vectors, one at a time."""
    enc, out = lookup_encoder(spark, sf), None
    toks = enc.stored_tokens(claim_texts(spark, sf), "text_key", "text")
    vecs, large = enc.token_vectors(toks, "text_key"), large_groups(toks, ["text_key"])
    for mode in POOL_MODES:
        p = pool_tokens(vecs, ["text_key"], mode=mode, large=large).select("text_key", F.lit(mode).alias("mode"), "vec")
        out = p if out is None else out.unionByName(p)
    return _pooled_digest(out)


# ---------------------------------------------------------------- prototypes

def q_prototypes(spark, sf):
    p = prototypes(experiment.fit_rows(TB.vec_pairs(spark, sf), SEED, M), "diff")
    return p.select("label", "n", F.posexplode("centroid").alias("pos", "value")).select(
        "label", "n", "pos", _r(F.col("value")).alias("value"))


def q_predict_three(spark, sf):
    s = flagship_scored(spark, sf)
    return s.select("claim_id", "set_pos", "truth", "pred")


def q_predict_binary(spark, sf):
    return binary_scored(spark, sf).select("claim_id", "set_pos", "truth", "pred")


def q_binary_accuracy(spark, sf):
    return evaluate.accuracy(binary_scored(spark, sf))


def q_binary_confusion(spark, sf):
    return evaluate.confusion_long(binary_scored(spark, sf), BINARY_LETTERS)


def q_binary_f1(spark, sf):
    per = evaluate.f1_per_class(q_binary_confusion(spark, sf), labels=BINARY_LETTERS)
    return per.select("label", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
                      _r(F.col("f1")).alias("f1"), "support")


def q_predict_multi_proto(spark, sf):
    """Six prototypes: two sets of three, fitted on the samples of two seeds;
    the winner is folded back to its class."""
    pairs = TB.vec_pairs(spark, sf)
    seeds = [SEED, SEED + 1]
    # one ranking for both seeds; vectors come after it
    keys = sampling.fit_sample(pairs.select(*sampling.KEY, "label"), seeds, M).drop("label")
    fit = experiment.with_diff(pairs.join(bounded_broadcast(keys, len(seeds) * 3 * M, 64), list(sampling.KEY)))
    protos = prototypes(fit, "diff", group_cols=["seed"]).withColumn(
        "proto_id", F.col("label") + 3 * (F.col("seed") - F.lit(SEED))).drop("seed")
    s = predict(experiment.with_diff(pairs), protos, "diff", out="pred")
    return s.select("claim_id", "set_pos", F.col("label").alias("truth"), "pred")


def q_baseline_logreg(spark, sf):
    """One distributed Newton fit on the m-shot sample; every other pair with its prediction and its probability."""
    from ..operators.baseline import linear_scores, newton_fit
    from ..session import scratch_table

    fit, dev = experiment.split_rows(TB.vec_pairs(spark, sf), SEED, M)
    weights = newton_fit(scratch_table(experiment.with_diff(fit).select("label", "diff"), "fit-rows"))
    scored = linear_scores(experiment.with_diff(dev), weights)
    return scored.select("claim_id", "set_pos", F.col("label").alias("truth"), "pred", _r(F.col("prob")).alias("prob"))


# ---------------------------------------------------------------- evaluation

def q_accuracy(spark, sf):
    return evaluate.accuracy(flagship_scored(spark, sf))


def q_accuracy_half_even(spark, sf):
    """Accuracy of every cell of the small grid, rounded half to even."""
    conf = sweep.sweep_counts(flagship_pairs(spark, sf), SMALL_SEEDS, SMALL_SHOTS)
    right = F.sum(F.when(F.col("y_truth") == F.col("y_pred"), F.col("n")).otherwise(0))
    return conf.groupBy("seed", "m").agg(evaluate.rounded(right * 100 / F.sum("n"), 0, "even").cast("int").alias("percent"))


def flagship_confusion(spark, sf):
    return evaluate.confusion_long(flagship_scored(spark, sf))


def q_confusion(spark, sf):
    return flagship_confusion(spark, sf)


def q_confusion_wide(spark, sf):
    return evaluate.confusion_matrix(flagship_confusion(spark, sf))


#: Caps of the capped experiment: a tenth of the reference's, so that they bind.
SMALL_CAPS = {0: 333, 1: 166, 2: 167}


def q_experiment_capped(spark, sf):
    """One experiment whose dev rows are the capped pool's, with their places."""
    s = experiment.score(TB.vec_pairs(spark, sf), SEED, M, caps=SMALL_CAPS, with_index=True, prepare=experiment.with_diff)
    return s.select("claim_id", "set_pos", F.col("dataset_index").cast("bigint").alias("dataset_index"), "truth", "pred")


def q_f1_per_class(spark, sf):
    per = evaluate.f1_per_class(flagship_confusion(spark, sf))
    return per.select("label", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
                      _r(F.col("f1")).alias("f1"), "support")


def q_f1_macro(spark, sf):
    return evaluate.f1_macro(flagship_confusion(spark, sf))


def q_f1_observed(spark, sf):
    conf = evaluate.confusion_long(nested_scored(spark, sf))
    return evaluate.f1_observed(conf)


def q_errors_wrong(spark, sf):
    wrong = nested_scored(spark, sf).filter(F.col("y_truth") != F.col("y_pred"))
    return nested_errors(spark, sf, wrong).select(*ERROR_COLUMNS)


def q_errors_correct(spark, sf):
    right = nested_scored(spark, sf).filter(F.col("y_truth") == F.col("y_pred"))
    return nested_errors(spark, sf, right).select(*ERROR_COLUMNS)


def q_error_sink(spark, sf):
    """Both error tables written from one scored pass, and read back."""
    from ..session import scratch_path

    path = scratch_path(spark, "errors-tsv")
    write_errors(nested_errors(spark, sf, nested_scored(spark, sf)), path)
    return read_errors(spark, path)


# ---------------------------------------------------------------- two sets, batch encoder

def q_corpus_experiment(spark, sf):
    """Fit on the nested claims' pairs, evaluate on the corpus pairs capped per class."""
    s = experiment.score_two_sets(nested_pairs(spark, sf), corpus_pairs_all(spark, sf), SEED, M, DEV_CAP, prepare=hashed_diff)
    return s.select("claim_id", "set_pos", "truth", "pred")


def text_features(texts):
    """A batch model for the encoder hook: per text, counts of five characters and its length, scaled."""
    import numpy as np

    return np.array([[t.count(c) for c in TEXT_FEATURES] + [len(t)] for t in texts], dtype=float).reshape(
        len(texts), len(TEXT_FEATURES) + 1) / 100


# The characters that the batch model counts.
TEXT_FEATURES = ["a", "e", "t", "n", " "]


def batch_encoder() -> PandasEncoder:
    return PandasEncoder(load=lambda: text_features, dim=len(TEXT_FEATURES) + 1, name="text-features")


def _vector_digest(p: DataFrame) -> DataFrame:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return p.select("claim_id", "set_pos", _r(total("claim_vec")).alias("claim_sum"), _r(total("evidence_vec")).alias("evidence_sum"),
                    _r(V.dot("claim_vec", "evidence_vec")).alias("dot"))


def q_encode_batch_model(spark, sf):
    return _vector_digest(batch_encoder().encode_pairs(TB.text_pairs(spark, sf)))


def encoding_store(spark) -> EncodingStore:
    from ..session import scratch_path

    return EncodingStore(spark, scratch_path(spark, "encodings"))


def q_encode_store(spark, sf):
    """Vectors of all pairs from a store that already holds those of the claims."""
    store, pairs = encoding_store(spark), TB.text_pairs(spark, sf)
    store.fill(pairs.select(F.col("claim").alias("text")), batch_encoder())
    return _vector_digest(batch_encoder().encode_pairs(pairs, store=store))


def q_encode_fills(spark, sf):
    """Texts encoded by three fills of one store: the claims, then claims and evidence, then the same again."""
    store, pairs = encoding_store(spark), TB.text_pairs(spark, sf)
    claims = pairs.select(F.col("claim").alias("text"))
    both = claims.unionByName(pairs.select(F.col("evidence").alias("text")))
    done = [(i + 1, store.fill(t, batch_encoder())) for i, t in enumerate((claims, both, both))]
    return spark.createDataFrame(done, "fill int, encoded long")


# ---------------------------------------------------------------- sweep

def q_sweep(spark, sf):
    pairs = flagship_pairs(spark, sf)
    return sweep.sweep_counts(pairs, sweep.REFERENCE_SEEDS, sweep.REFERENCE_SHOTS)


def q_sweep_encoders(spark, sf):
    """The sweep with an encoder dimension: absolute and signed differences as two encoders."""
    base = TB.vec_pairs(spark, sf)
    both = F.array(*[F.struct(F.lit(n).alias("encoder"), V.diff("evidence_vec", "claim_vec", a).alias("diff"))
                     for n, a in (("absolute", True), ("signed", False))])
    pairs = base.select("claim_id", "set_pos", "label", F.inline(both))
    return sweep.sweep_counts(pairs, SMALL_SEEDS, SMALL_SHOTS, encoder_col="encoder", n_encoders=2)


def q_sweep_summary(spark, sf):
    conf = q_sweep(spark, sf)
    return sweep.sweep_summary(conf, ["seed", "m"])


REGISTRY: dict[str, Query] = {
    # sources
    "scan_claims": q_scan_claims,
    "flatten_pairs": q_flatten_pairs,
    "flatten_single": q_flatten_single,
    "flatten_first_evidence": q_flatten_first_evidence,
    "corpus_dedup": q_corpus_dedup,
    "corpus_pairs_gold": q_corpus_pairs_gold,
    "corpus_pairs_neutral": q_corpus_pairs_neutral,
    "corpus_pairs": q_corpus_pairs,
    # projections / text
    "encode_label": q_encode_label,
    "decode_three": q_decode_three,
    "decode_binary": q_decode_binary,
    "label_to_binary": q_label_to_binary,
    "union_classes": q_union_classes,
    "clean_brackets": q_clean_brackets,
    "normalize_text": q_normalize_text,
    "merge_sentences": q_merge_sentences,
    # sampling
    "cap_per_class": q_cap_per_class,
    "fit_sample": q_fit_sample,
    "dev_complement": q_dev_complement,
    "dev_capped": q_dev_capped,
    "binary_split": q_binary_split,
    "binary_split_capped": q_binary_split_capped,
    "prefix_property": q_prefix_property,
    "split_counts": q_split_counts,
    # vectors
    "pair_diff_abs": q_pair_diff_abs,
    "pair_diff_signed": q_pair_diff_signed,
    "sim_euclidean": _pair_metric(V.sim_euclidean),
    "sim_cosine": _pair_metric(V.cosine),
    "dist_euclidean": _pair_metric(V.euclidean),
    "vec_norm": q_vec_norm,
    "vec_dot": _pair_metric(V.dot),
    "vec_theta": _pair_metric(V.theta),
    "vec_triangle": _pair_metric(V.triangle),
    "vec_magdiff": _pair_metric(V.magnitude_difference),
    "vec_sector": _pair_metric(V.sector),
    "dist_tsss": _pair_metric(V.ts_ss),
    "encode_hashing": q_encode_hashing,
    "pool_tokens": q_pool_tokens,
    "pool_token_vectors": q_pool_token_vectors,
    "encode_batch_model": q_encode_batch_model,
    "encode_store": q_encode_store,
    "encode_fills": q_encode_fills,
    # prototypes
    "prototypes": q_prototypes,
    "predict_three": q_predict_three,
    "predict_binary": q_predict_binary,
    "binary_accuracy": q_binary_accuracy,
    "binary_confusion": q_binary_confusion,
    "binary_f1": q_binary_f1,
    "corpus_experiment": q_corpus_experiment,
    "predict_multi_proto": q_predict_multi_proto,
    "baseline_logreg": q_baseline_logreg,
    # evaluation
    "accuracy": q_accuracy,
    "confusion": q_confusion,
    "confusion_wide": q_confusion_wide,
    "experiment_capped": q_experiment_capped,
    "f1_per_class": q_f1_per_class,
    "f1_macro": q_f1_macro,
    "f1_observed": q_f1_observed,
    "errors_wrong": q_errors_wrong,
    "errors_correct": q_errors_correct,
    "error_sink": q_error_sink,
    "accuracy_half_even": q_accuracy_half_even,
    # sweep
    "sweep": q_sweep,
    "sweep_summary": q_sweep_summary,
    "sweep_encoders": q_sweep_encoders,
}


# ---------------------------------------------------------------- drift

def q_drift_consecutive(spark, sf):
    from ..operators.drift import drift_consecutive

    return drift_consecutive(TB.vec_pairs(spark, sf), SEED, DRIFT_SHOTS, prepare=experiment.with_diff)


def q_drift_from_base(spark, sf):
    from ..operators.drift import drift_from_base

    return drift_from_base(TB.vec_pairs(spark, sf), SEED, DRIFT_BASE_SHOTS, prepare=experiment.with_diff)


def q_drift_metrics(spark, sf):
    """Drift from the first shot count by each of the metrics."""
    from ..operators.drift import drift_pairs

    steps, out = [(DRIFT_BASE_SHOTS[0], m) for m in DRIFT_BASE_SHOTS[1:]], None
    for metric in V.DISTANCES:
        d = drift_pairs(TB.vec_pairs(spark, sf), SEED, steps, prepare=experiment.with_diff, metric=metric).select(
            F.lit(metric).alias("metric"), "label", "start", "end", _r(F.col("drift")).alias("drift"))
        out = d if out is None else out.unionByName(d)
    return out


def q_read_drift(spark, sf):
    """The drift table written as TSV (3 decimals) and read back."""
    from ..session import scratch_path
    from .sinks import write_drift

    path = scratch_path(spark, "drift-tsv")
    write_drift(q_drift_consecutive(spark, sf).drop("seed"), path)
    return runlogs.read_drift(spark, path)


# ---------------------------------------------------------------- run logs and summaries

# A progress line the runner prints into the log between the
# header and the metrics; it is noise for the parser.
NOISE_LINE = "fever --> fever:"


# Fixed values of the run records: divisors whose remainders of n_chars stand for the metrics.
RECORD_METRICS = {"accuracy": 1009, "f1_s": 997, "f1_n": 991, "f1_c": 983, "f1": 977}


def run_records(spark, sf) -> DataFrame:
    """One record per run, from the documents of a source dealt by id to 3
    seeds x 4 shot counts x 5 runs: model (the source), seed, m, run, and
    metrics that are means of remainders of ``n_chars``."""
    d = TB.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    part = lambda div, n: F.pmod(F.floor(F.col("doc_id") / (20 * div)), F.lit(n)).cast("int")
    means = [(F.sum(F.pmod("n_chars", F.lit(q))) / (F.count(F.lit(1)) * q)).alias(n) for n, q in RECORD_METRICS.items()]
    return d.groupBy(F.col("source").alias("model"), (part(1, 3) + 123).alias("seed"),
                     (part(3, 4) * 2 + 2).alias("m"), (part(12, 5) + 1).alias("run")).agg(*means)


def layout_records(spark, sf) -> DataFrame:
    """The run records under the names that the layouts use."""
    r = run_records(spark, sf)
    pick = ["accuracy", "f1", "f1_s", "f1_n", "f1_c", "accuracy", "f1", "f1_s"]
    eight = [n for n, _ in runlogs.LAYOUTS["before_after"].fields[3:]]
    return r.select("*", F.col("f1_s").alias("s"), F.col("f1_n").alias("n"), F.col("f1_c").alias("c"), F.col("f1_n").alias("not"),
                    F.lit("0.1").alias("rate"), F.lit("3").alias("epochs"), *[F.col(c).alias(n) for n, c in zip(eight, pick)])


def written_run_log(spark, sf, layout: str = "prototype_plain", marker: str | None = runlogs.MARKER, noise: str | None = NOISE_LINE) -> str:
    from ..session import scratch_path

    path = scratch_path(spark, "run-log")
    runlogs.write_log(runlogs.render_records(layout_records(spark, sf), noise, runlogs.LAYOUTS[layout], marker), path)
    return path


def q_after_marker(spark, sf):
    lines = runlogs.read_lines(spark, written_run_log(spark, sf))
    return runlogs.after_marker(lines).select(F.regexp_extract("file", "model=([^/]*)", 1).alias("model"), "line_no", "line")


def q_drop_noise(spark, sf):
    lines = runlogs.read_lines(spark, written_run_log(spark, sf))
    return runlogs.drop_noise(lines, [NOISE_LINE]).select(F.regexp_extract("file", "model=([^/]*)", 1).alias("model"), "line_no", "line")


def q_parse_runs(spark, sf):
    return runlogs.parse_runs(spark, written_run_log(spark, sf), noise=[NOISE_LINE])


def q_parse_runs_stride(spark, sf):
    return runlogs.parse_runs(spark, written_run_log(spark, sf), noise=[NOISE_LINE], anchored=False)


def _parse_layout(name):
    def q(spark, sf):
        path = written_run_log(spark, sf, name, marker=None, noise=None)
        return runlogs.parse_runs(spark, path, runlogs.LAYOUTS[name], marker=None)
    return q


def q_runs_mean_stdpop(spark, sf):
    r = run_records(spark, sf).select("model", "m", F.col("accuracy").alias("acc"), F.col("f1_s").alias("s"),
                                      F.col("f1_n").alias("n"), F.col("f1_c").alias("c"))
    return summary.runs_mean_stdpop(r, ["acc", "s", "n", "c"])


def q_runs_mean_stdsamp(spark, sf):
    return summary.runs_mean_stdsamp(run_records(spark, sf), ["accuracy", "f1"])


def q_trend_series(spark, sf):
    return summary.trend_series(run_records(spark, sf))


def q_trend_point(spark, sf):
    """The trend series looked up at one shot count."""
    return summary.point(q_trend_series(spark, sf), m=4)


def q_trend_model(spark, sf):
    """The trend series of one model, the filter on the runs' records."""
    return summary.point(q_trend_series(spark, sf), model=TREND_MODEL)


# Fixed value: the source whose records the model filter picks.
TREND_MODEL = "src3"


def q_average_runs(spark, sf):
    """Mean over the five runs of each (model, seed, m)."""
    return summary.average_runs(run_records(spark, sf))


def q_drift_rate_log(spark, sf):
    """Drift rates of two seeds appended to one table, the first run a second
    time, and read back: one copy of each run."""
    from ..operators.drift import drift_from_base
    from ..session import scratch_path
    from .sinks import append_drift, read_appended

    path = scratch_path(spark, "drift-rate-tsv")
    for seed in (SEED, SEED + 1, SEED):
        rate = drift_from_base(TB.vec_pairs(spark, sf), seed, DRIFT_BASE_SHOTS, prepare=experiment.with_diff)
        append_drift(rate.drop("seed"), path, f"seed={seed}")
    return read_appended(spark, path, runlogs.DRIFT_RATE_SCHEMA)


def q_summary_sink(spark, sf):
    """Before/after summaries of every model, one folder each, read back."""
    from ..session import scratch_path
    from .sinks import write_summaries

    path = scratch_path(spark, "summaries-tsv")
    metrics = [n for n, _ in runlogs.LAYOUTS["before_after"].fields[3:]]
    s = summary.mean_std(layout_records(spark, sf), ["model", "m"], metrics, "pop", round_to=None)
    write_summaries(s.withColumn("dataset", F.lit("documents")), path)
    return runlogs.read_drift(spark, path, runlogs.BEFORE_AFTER_SCHEMA).drop("dataset")


def before_after_records(spark, sf) -> DataFrame:
    """Per (seed, m) of the small grid: accuracy and macro F1 on the fit rows
    (train) and the dev rows, before and after the cell's refinement is fitted."""
    conf = sweep.before_after_counts(flagship_pairs(spark, sf), SMALL_SEEDS, SMALL_SHOTS)
    per = sweep.sweep_summary(conf, ["phase", "split", "seed", "m"])
    pick = lambda c, p, s: F.max(F.when((F.col("phase") == p) & (F.col("split") == s), F.col(c)))
    return per.groupBy("seed", "m").agg(*[pick(c, p, s).alias(f"{p}_{n}_{s}") for p in sweep.PHASES for s in ("train", "dev")
                                          for c, n in (("accuracy", "acc"), ("f1_macro", "f1"))])


BEFORE_AFTER_METRICS = ["before_acc_train", "before_f1_train", "before_acc_dev", "before_f1_dev",
                        "after_acc_train", "after_f1_train", "after_acc_dev", "after_f1_dev"]


def q_before_after_summary(spark, sf):
    return summary.mean_std(before_after_records(spark, sf), ["m"], BEFORE_AFTER_METRICS, "pop")


BASELINE_RUNS = [1, 2, 3, 4, 5]


def q_sweep_baseline(spark, sf):
    """Confusion counts of the fitted baseline for every cell and run."""
    return sweep.sweep_baseline(flagship_pairs(spark, sf), SMALL_SEEDS, SMALL_SHOTS, runs=BASELINE_RUNS)


REGISTRY.update({
    "drift_consecutive": q_drift_consecutive,
    "drift_from_base": q_drift_from_base,
    "drift_metrics": q_drift_metrics,
    "read_drift": q_read_drift,
    "after_marker": q_after_marker,
    "drop_noise": q_drop_noise,
    "parse_runs": q_parse_runs,
    "parse_runs_stride": q_parse_runs_stride,
    **{f"parse_{name}": _parse_layout(name) for name in runlogs.LAYOUTS},
    "runs_mean_stdpop": q_runs_mean_stdpop,
    "runs_mean_stdsamp": q_runs_mean_stdsamp,
    "trend_series": q_trend_series,
    "trend_point": q_trend_point,
    "trend_model": q_trend_model,
    "average_runs": q_average_runs,
    "drift_rate_log": q_drift_rate_log,
    "summary_sink": q_summary_sink,
    "before_after_summary": q_before_after_summary,
    "sweep_baseline": q_sweep_baseline,
})
