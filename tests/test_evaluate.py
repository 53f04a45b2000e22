import pytest
from pyspark.sql import functions as F

from diffproto.operators import evaluate as E
from diffproto.operators import summary as SM
from conftest import rows


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "y_truth string, y_pred string")


def test_class_never_predicted(spark):
    sc = _scored(spark, [("s", "s"), ("s", "n"), ("n", "n"), ("c", "n"), ("c", "s")])
    conf = E.confusion_long(sc)
    assert conf.count() == 9
    assert sum(r[0] for r in rows(conf, "n")) == 5
    f1 = dict(rows(E.f1_per_class(conf), "label", "f1"))
    assert f1["c"] == 0.0
    assert f1["s"] == pytest.approx(0.5)
    assert f1["n"] == pytest.approx(2 * 1 / (2 * 1 + 2 + 0))
    acc = E.accuracy(sc).first()
    assert acc.accuracy == pytest.approx(round(2 / 5, 4)) and acc.n == 5


def test_macro_over_seen_labels_only(spark):
    sc = _scored(spark, [("s", "s"), ("n", "n"), ("n", "s")])
    conf = E.confusion_long(sc)
    macro = E.f1_macro(conf).first()[0]
    f_s, f_n = 2 * 1 / (2 + 1), 2 * 1 / (2 + 1)
    assert macro == pytest.approx(round((f_s + f_n) / 2, 4))
    observed = sorted(rows(E.f1_observed(conf), "label"))
    assert observed == [("n",), ("s",)]


def test_cell_metrics_match_per_class(spark):
    sc = _scored(spark, [("s", "s"), ("s", "c"), ("n", "n"), ("c", "c"), ("c", "n")]).withColumn("g", F.lit(1))
    conf = E.confusion_long(sc, group_cols=["g"])
    cm = E.cell_metrics(conf, ["g"]).first()
    per = dict(rows(E.f1_per_class(conf, ["g"]), "label", "f1"))
    assert cm.f1_s == pytest.approx(round(per["s"], 4)) and cm.f1_c == pytest.approx(round(per["c"], 4))
    assert cm.accuracy == pytest.approx(0.6)
    assert cm.f1_macro == pytest.approx(round(sum(per.values()) / 3, 4))


def test_std_kinds(spark):
    runs = spark.createDataFrame([("x", 1, 0.0), ("x", 1, 1.0)], "model string, m int, accuracy double")
    pop = SM.runs_mean_stdpop(runs, ["accuracy"]).first()
    samp = SM.runs_mean_stdsamp(runs, ["accuracy"]).first()
    assert pop.std_accuracy == pytest.approx(0.5)
    assert samp.accuracy_sd == pytest.approx(0.7071)
    assert pop.mean_accuracy == pytest.approx(0.5)


def test_confusion_matrix_wide_order(spark):
    sc = _scored(spark, [("s", "s"), ("c", "n"), ("n", "n"), ("n", "n")])
    wide = E.confusion_matrix(E.confusion_long(sc)).collect()
    assert [r.y_truth for r in wide] == ["s", "n", "c"]          # fixed label order, zero rows kept
    assert [(r.s, r.n, r.c) for r in wide] == [(1, 0, 0), (0, 2, 0), (0, 1, 0)]
