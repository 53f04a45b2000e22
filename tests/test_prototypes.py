import numpy as np
import pytest
from pyspark.sql import functions as F

from diffproto.operators.prototypes import predict, prototypes
from conftest import rows


def _protos(spark, items):
    return spark.createDataFrame([(pid, lab, 1, c) for pid, lab, c in items],
                                 "proto_id int, label int, n bigint, centroid array<double>")


def _one(spark, vec, items, metric="euclidean"):
    df = spark.createDataFrame([(vec,)], "diff array<double>")
    return predict(df, _protos(spark, items), metric=metric, out="pred").first().pred


def test_tie_goes_to_lowest_class(spark):
    assert _one(spark, [0.0, 0.0], [(0, 0, [5.0, 5.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])]) == 1


def test_zero_vector_cosine_gives_class_0(spark):
    assert _one(spark, [0.0, 0.0], [(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [1.0, 1.0])], "cosine") == 0


def test_zero_prototype_cosine_always_wins(spark):
    assert _one(spark, [1.0, 0.0], [(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 0.0])], "cosine") == 2


def test_six_prototypes_fold_to_class(spark):
    items = [(i, i % 3, [float(10 + i), 0.0]) for i in range(6)]
    items[4] = (4, 1, [0.1, 0.0])
    assert _one(spark, [0.0, 0.0], items) == 1


def test_prototypes_mean_and_absent_class(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "label int, diff array<double>")
    got = {r.label: (r.n, r.centroid) for r in prototypes(df).collect()}
    assert got == {0: (2, [2.0, 3.0]), 1: (1, [5.0, 6.0])}
    # class 2 has no prototype, so it can never be predicted
    pred = predict(spark.createDataFrame([([9.0, 9.0],)], "diff array<double>"), prototypes(df), out="p").first().p
    assert pred == 1


def test_matches_numpy_argmax(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(3, 5))
    x = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "i int, diff array<double>")
    pr = _protos(spark, [(k, k, c[k].tolist()) for k in range(3)])
    got = dict(rows(predict(df, pr, out="p"), "i", "p"))
    ref = [int(np.argmax([1 - np.linalg.norm(x[i] - c[k]) for k in range(3)])) for i in range(50)]
    assert [got[i] for i in range(50)] == ref


def test_summarizer_mean_agrees(spark):
    rng = np.random.default_rng(1)
    data = [(int(i % 3), rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame(data, "label int, diff array<double>")
    a = {r.label: r.centroid for r in prototypes(df).collect()}
    b = {r.label: r.centroid for r in prototypes(df, method="summarizer").collect()}
    for k in a:
        assert np.allclose(a[k], b[k])
