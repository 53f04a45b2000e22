"""The join with frequent keys, stored encodings, drift on long grids, and both ways of the first n."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from diffproto.operators import drift, evaluate, sampling
from diffproto.operators.encode import EncodingStore, LookupPoolEncoder, PandasEncoder
from diffproto.operators.joins import frequent_keys, skew_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, how):
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(600)] + [(600, "gone")]
    df = spark.createDataFrame(data, "i int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    often = frequent_keys(df, "k", share=10)
    assert often == ["hot"]
    got = skew_join(df, table, "k", ["i"], how, often, copies=4)
    assert sorted(rows(got, "i", "k", "v"), key=repr) == sorted(rows(df.join(table, "k", how), "i", "k", "v"), key=repr)
    salts = "".join(x for x in skew_join(df, table, "k", ["i"], how, often)._jdf.queryExecution().toString().split("\n") if "_salt" in x)
    assert "_salt" in salts and "_salt" not in skew_join(df, table, "k", ["i"], how, [])._jdf.queryExecution().toString()


def test_store_encodes_only_what_is_new(spark, tmp_path):
    def length(texts):
        import numpy as np

        return np.array([[len(t), 1.0] for t in texts], dtype=float)

    enc = PandasEncoder(length, 2, name="len/1", batch=3)
    store = EncodingStore(spark, str(tmp_path / "enc"))
    text = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert rows(store.encodings(enc)) == []
    assert store.fill(text("a", "bb", "bb", None, *["hot"] * 50), enc) == 3
    assert store.fill(text("a", "bb", "hot"), enc) == 0
    assert store.fill(text("a", "new"), enc) == 1
    assert sorted(r["vec"] for r in store.encodings(enc).collect()) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [3.0, 1.0]]
    other = PandasEncoder(lambda texts: length(texts) * 2, 2, name="other")
    assert store.fill(text("a"), other) == 1  # encoders do not share
    pairs = spark.createDataFrame([(i, 0, "hot", "bb" if i % 2 else None) for i in range(40)], "claim_id bigint, set_pos int, claim string, evidence string")
    got = enc.encode_pairs(pairs, store=store)
    assert sorted(rows(got, "claim_id", "claim_vec", "evidence_vec")) == [(i, [3.0, 1.0], [2.0, 1.0] if i % 2 else None) for i in range(40)]


def test_encoder_mistakes_raise(spark):
    with pytest.raises(ValueError):
        PandasEncoder()
    with pytest.raises(Exception, match="values each"):
        PandasEncoder(lambda t: np.zeros((len(t), 3)), 2).encode_texts(spark.createDataFrame([("a",)], "text string")).collect()


def test_pooling_with_a_frequent_token(spark):
    """A token that every text holds is copied; sums are the same as with plain joins."""
    vocab = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vocab_id bigint, vec array<double>")
    texts = spark.createDataFrame([(i, f"the w{i} the x{i % 3}") for i in range(200)] + [(200, "")], "k int, t string")
    enc = LookupPoolEncoder(vocab, 7)
    toks = enc._tokens(texts, "k", "t").collect()
    want = {}
    for r in toks:
        want.setdefault(r["k"], []).append((r["pos"], r["vocab_id"]))
    for r in enc.encode_all(texts, "k", "t").collect():
        ids = [v for _, v in sorted(want[r["k"]])]
        assert r["mean"] == pytest.approx([np.mean(ids), 1.0]) and r["max"] == [float(max(ids)), 1.0] and r["cls"] == [float(ids[0]), 1.0]


def test_first_n_is_the_same_both_ways(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("claim_id"), F.lit(0).alias("set_pos"), F.expr("if(id % 3 = 0, null, id % 2)").cast("int").alias("label"))
    one = sorted(rows(sampling.top_per_class(df, [1, 2], 40)), key=repr)
    monkeypatch.setattr(sampling, "ONE_PASS", 0)
    assert sorted(rows(sampling.top_per_class(df, [1, 2], 40)), key=repr) == one and len(one) == 2 * 3 * 40


def test_first_n_reads_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(100).selectExpr("id AS claim_id", "0 AS set_pos", "cast(id % 3 AS int) AS label").write.parquet(path)
    plan = sampling.fit_sample(spark.read.parquet(path), [1, 2, 3], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan


def brute_drift(vecs, steps):
    mean = lambda m: np.mean(vecs[: min(m, len(vecs))], axis=0)
    return {(a, b): float(np.linalg.norm(mean(b) - mean(a))) for a, b in steps}


def test_drift_on_a_long_grid(spark, monkeypatch):
    """Shots up to the class's size and beyond, more grid values than one group of blocks."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("claim_id"), F.lit(0).alias("set_pos"), F.when(F.col("id") < 300, 1).otherwise(0).alias("label"),
                               F.array((F.col("id") % 101).cast("double"), F.sin("id")).alias("diff"))
    steps = [(m, m + 7) for m in range(1, n, 7)] + [(1, 100_000)]
    monkeypatch.setattr(drift, "GROUP", 256)
    got = {(r["label"], r["start"], r["end"]): r["drift"] for r in drift.drift_pairs(df, 5, steps).collect()}
    ranked = sampling.exact_rank(df, 5).select("label", "rank", "diff").orderBy("label", "rank").collect()
    assert len(got) == 2 * len(steps)
    for label in (0, 1):
        x = np.array([r["diff"] for r in ranked if r["label"] == label])
        c = np.cumsum(x, axis=0) / np.arange(1, len(x) + 1)[:, None]
        for a, b in steps:
            want = np.linalg.norm(c[min(b, len(x)) - 1] - c[min(a, len(x)) - 1])
            assert got[label, a, b] == pytest.approx(want, abs=1e-9)


def test_drift_metrics(spark):
    df = spark.createDataFrame([(i, 0, 0, [float(i), 1.0]) for i in range(4)], "claim_id bigint, set_pos int, label int, diff array<double>")
    for metric in ("euclidean", "cosine", "triangle"):
        assert drift.drift_pairs(df, 1, [(1, 3)], metric=metric).count() == 1
    with pytest.raises(ValueError):
        drift.drift_pairs(df, 1, [(1, 3)], metric="manhattan")


def test_rounding_of_halves(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(
        evaluate.rounded(F.col("x"), 0).alias("up"), evaluate.rounded(F.col("x"), 0, "even").alias("even")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (2.0, 2.0), (3.0, 2.0)]
    with pytest.raises(ValueError):
        evaluate.rounded(F.lit(1.0), ties="down")
