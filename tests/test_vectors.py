import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffproto.functions import vectors as V


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 8))
    b = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(20)],
                               "i int, a array<double>, b array<double>")
    return df, a, b


def _cos(x, y):
    return float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))


def _theta(x, y):
    return math.acos(max(-1.0, min(1.0, _cos(x, y)))) + math.radians(10)


def _tsss(x, y):
    ed, md, th = np.linalg.norm(x - y), abs(np.linalg.norm(x) - np.linalg.norm(y)), _theta(x, y)
    tri = np.linalg.norm(x) * np.linalg.norm(y) * math.sin(math.radians(th)) / 2
    sec = math.pi * (ed + md) ** 2 * th / 360
    return tri * sec


CASES = {
    "euclidean": (V.euclidean, lambda x, y: float(np.linalg.norm(x - y))),
    "sim_euclidean": (V.sim_euclidean, lambda x, y: 1 - float(np.linalg.norm(x - y))),
    "cosine": (V.cosine, _cos),
    "dot": (V.dot, lambda x, y: float(np.dot(x, y))),
    "theta": (V.theta, _theta),
    "magdiff": (V.magnitude_difference, lambda x, y: abs(np.linalg.norm(x) - np.linalg.norm(y))),
    "tsss": (V.ts_ss, _tsss),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_against_numpy(vecs, name):
    df, a, b = vecs
    fn, ref = CASES[name]
    got = dict((r[0], r[1]) for r in df.select("i", fn("a", "b")).collect())
    for i in range(20):
        assert got[i] == pytest.approx(ref(a[i], b[i]), rel=1e-9, abs=1e-12)


def test_diff_and_norm(vecs):
    df, a, b = vecs
    r = df.select("i", V.diff("b", "a").alias("d"), V.diff("b", "a", False).alias("s"), V.norm("a").alias("n")).collect()
    for row in r:
        i = row.i
        assert np.allclose(row.d, np.abs(b[i] - a[i]))
        assert np.allclose(row.s, b[i] - a[i])
        assert row.n == pytest.approx(np.linalg.norm(a[i]))


def test_zero_vector_cosine_is_nan(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert math.isnan(df.select(V.cosine("a", "b")).first()[0])


def test_unequal_length_raises(spark):
    df = spark.createDataFrame([([0.0, 1.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        df.select(V.euclidean("a", "b")).collect()


def test_unknown_metric():
    with pytest.raises(ValueError):
        V.similarity("a", "b", "manhattan")
    with pytest.raises(ValueError):
        V.distance("a", "b", "manhattan")
