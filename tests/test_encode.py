import numpy as np
import pytest
from pyspark.sql import functions as F

from diffproto.operators import encode
from diffproto.operators.encode import HashingEncoder, LookupPoolEncoder, PandasEncoder, pool_tokens
from diffproto.operators.prototypes import predict
from conftest import rows


def test_pandas_encoder_dedups_and_joins(spark):
    def letter_counts(texts):
        """A stand-in batch model: counts of 'a', 'b', 'c' per text (defined
        inside the test so it is shipped to the workers by value)."""
        import numpy as np

        return np.array([[t.count(ch) for ch in "abc"] for t in texts], dtype=float)

    pairs = spark.createDataFrame([(1, 0, "aab", "c"), (2, 0, "aab", "bbc"), (3, 0, "cc", "c")],
                                  "claim_id bigint, set_pos int, claim string, evidence string")
    enc = PandasEncoder(letter_counts, 3)
    texts = pairs.select(F.col("claim").alias("text")).unionByName(pairs.select(F.col("evidence").alias("text")))
    assert enc.encode_texts(texts).count() == 4          # aab, c, bbc, cc: each encoded once
    got = {r.claim_id: (r.claim_vec, r.evidence_vec) for r in enc.encode_pairs(pairs).collect()}
    assert got[1] == ([2.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    assert got[2] == ([2.0, 1.0, 0.0], [0.0, 2.0, 1.0])
    assert got[3] == ([0.0, 0.0, 2.0], [0.0, 0.0, 1.0])


def test_hashing_encoder_properties(spark):
    df = spark.createDataFrame([(1, "Hello, hello WORLD"), (2, "   "), (3, "élan élan")], "k int, t string")
    enc = HashingEncoder(16)
    out = {r.k: r.v for r in enc.encode(df, "t", "v").collect()}
    assert out[2] == [0.0] * 16                            # no tokens -> zeros
    for k in (1, 3):
        assert len(out[k]) == 16 and np.linalg.norm(out[k]) == pytest.approx(1.0)
    assert sorted(x for x in out[3] if x) == [1.0]         # one distinct token
    fast = {r.k: r.v for r in HashingEncoder(16, hash_fn="xxhash64").encode(df, "t", "v").collect()}
    assert np.linalg.norm(fast[1]) == pytest.approx(1.0)


def test_pool_modes(spark):
    tv = spark.createDataFrame([("a", 0, [1.0, 4.0]), ("a", 1, [3.0, 0.0])], "g string, pos int, vec array<double>")
    assert pool_tokens(tv, ["g"], mode="mean").first().vec == [2.0, 2.0]
    assert pool_tokens(tv, ["g"], mode="max").first().vec == [3.0, 4.0]
    assert pool_tokens(tv, ["g"], mode="cls").first().vec == [1.0, 4.0]
    with pytest.raises(ValueError):
        pool_tokens(tv, ["g"], mode="median")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pooling_shuffles_vectors_not_elements(spark):
    tv = spark.range(100).selectExpr("cast(id % 7 as string) as g", "id as pos", "array(cast(id as double), 1.0D) as vec")
    for mode in ("mean", "max"):
        assert "hashpartitioning(g" in plan_of(pool_tokens(tv, ["g"], mode=mode)) and "_p#" not in "".join(
            line for line in plan_of(pool_tokens(tv, ["g"], mode=mode)).splitlines() if "hashpartitioning" in line)
    vocab = spark.range(50).selectExpr("id as vocab_id", "array(cast(id as double), 1.0D) as vec")
    texts = spark.createDataFrame([("a", "one two two"), ("b", "three")], "k string, t string")
    assert not [line for line in plan_of(LookupPoolEncoder(vocab, 50).encode_all(texts, "k", "t")).splitlines()
                if "hashpartitioning" in line and "_p#" in line]


def test_pooling_of_large_null_and_ragged_groups(spark, monkeypatch):
    data = [(g, i, [float(i), None if i % 3 else 2.0, 5.0][: 1 + i % 3]) for g, n in (("a", 9), ("b", 2), (None, 7)) for i in range(n)]
    data += [("c", 0, None), ("b", 2, [])]
    tv = spark.createDataFrame(data, "g string, pos int, vec array<double>")
    want = {}
    for g in ("a", "b", None):
        cols = [[v[p] for h, _, v in data if h == g and v and len(v) > p] for p in range(3)]
        vals = [[x for x in c if x is not None] for c in cols]
        want[g] = ([sum(v) / len(c) if v else None for c, v in zip(cols, vals, strict=True) if c],
                   [max(v) if v else None for c, v in zip(cols, vals, strict=True) if c])
    for least in (encode.LARGE, 3):
        monkeypatch.setattr(encode, "LARGE", least)
        got = [dict(rows(pool_tokens(tv, ["g"], mode=m), "g", "vec")) for m in ("mean", "max")]
        assert [{g: w[k] for g, w in want.items()} for k in (0, 1)] == got
    assert rows(encode.large_groups(tv, ["g"])) != []


def test_predict_per_group(spark):
    protos = spark.createDataFrame([("x", 0, 0, 1, [0.0]), ("x", 1, 1, 1, [10.0]), ("y", 0, 0, 1, [10.0]), ("y", 1, 1, 1, [0.0])],
                                   "g string, proto_id int, label int, n bigint, centroid array<double>")
    df = spark.createDataFrame([("x", [1.0]), ("y", [1.0])], "g string, diff array<double>")
    got = dict(rows(predict(df, protos, group_cols=["g"], out="p", dim=1, max_groups=2), "g", "p"))
    assert got == {"x": 0, "y": 1}
