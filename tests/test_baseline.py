"""Supervised baseline and refinement against independent solvers on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from diffproto.operators import baseline, evaluate
from diffproto.plans import experiment, registry, sweep


def some_data(seed, n=90, d=7, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, d)) + 0.8 * np.eye(classes, d)[y], y


def descended(x, y, classes, l2, steps=6000):
    """The optimum by accelerated gradient steps, from zero."""
    x = baseline.with_one(x)
    w = v = np.zeros((classes, x.shape[1]))
    smooth = 0.5 * (x ** 2).sum(axis=1).max() + l2
    beta = (1 - np.sqrt(l2 / smooth)) / (1 + np.sqrt(l2 / smooth))
    for _ in range(steps):
        g = (baseline.softmax(x @ v.T) - np.eye(classes)[y]).T @ x / len(x) + l2 * v
        new = v - g / smooth
        w, v = new, new + beta * (new - w)
    return w


def test_distributed_fit_equals_another_solver(spark, monkeypatch):
    x, y = some_data(1)
    want = descended(x, y, 3, baseline.L2)
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "label int, diff array<double>")
    for parts, most in ((1, baseline.DRIVER_BYTES), (5, 1)):  # the second adds the parts up in a tree
        monkeypatch.setattr(baseline, "DRIVER_BYTES", most)
        got = baseline.newton_fit(df.repartition(parts))
        assert np.abs(got - want).max() < 1e-7
    scored = baseline.linear_scores(df.unionByName(spark.createDataFrame([(0, None)], df.schema)), got).collect()
    p = baseline.softmax(baseline.with_one(x) @ want.T)
    assert [r["pred"] for r in scored[:-1]] == p.argmax(axis=1).tolist()
    assert np.allclose([r["prob"] for r in scored[:-1]], p.max(axis=1), atol=1e-7)
    assert scored[-1]["pred"] is None and scored[-1]["prob"] is None


def test_mistakes_raise(spark):
    schema = "label int, diff array<double>"
    for data, what in (([], "nothing"), ([(0, [1.0]), (1, [1.0, 2.0])], "components"), ([(3, [1.0])], "labels"), ([(None, [1.0])], "labels"),
                       ([(0, [0.0] * 2000)], "too large")):
        with pytest.raises(ValueError, match=what):
            baseline.newton_fit(spark.createDataFrame(data, schema))


def test_newton_on_separable_and_missing_classes():
    x = np.array([[3.0, 0.0], [2.5, 0.1], [-3.0, 0.2], [-2.0, 0.0]])
    y = np.array([0, 0, 2, 2])
    w = baseline.nested_fits(x, y, np.array([1, 2, 1, 2]), [2], [1], 3)[2][0]
    assert np.abs(w - descended(x, y, 3, baseline.L2, 20000)).max() < 1e-6


def test_stacked_cells_equal_single_fits(spark):
    """Every cell of the grid, whatever its run, has the counts of a fit of its own."""
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    got = {tuple(r[:5]): r[5] for r in rows(sweep.sweep_baseline(pairs, [123, 124], [10, 2], runs=[1, 7]))}
    assert len(got) == 2 * 2 * 2 * 9
    base = registry.TB.vec_pairs(spark, SF_SMALL)
    for seed, m in ((123, 2), (124, 10)):
        fit, dev = experiment.split_rows(base, seed, m)
        w = baseline.newton_fit(experiment.with_diff(fit))
        scored = baseline.linear_scores(experiment.with_diff(dev), w).withColumn("y_truth", F.element_at(F.array(*map(F.lit, "snc")), F.col("label") + 1)) \
            .withColumn("y_pred", F.element_at(F.array(*map(F.lit, "snc")), F.col("pred") + 1))
        for t, p, n in rows(evaluate.confusion_long(scored)):
            assert got[seed, m, 1, t, p] == got[seed, m, 7, t, p] == n


def test_grid_in_several_passes(spark, monkeypatch):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    one = sorted(rows(sweep.sweep_baseline(pairs, [123, 124], [2, 4])))
    two = sorted(rows(sweep.before_after_counts(pairs, [123, 124], [2, 4])))
    monkeypatch.setattr(sweep, "broadcast_limit", lambda s: 1)
    assert sorted(rows(sweep.sweep_baseline(pairs, [123, 124], [2, 4]))) == one
    assert sorted(rows(sweep.before_after_counts(pairs, [123, 124], [2, 4]))) == two


def test_ridge_map_is_the_closed_form_of_both_systems():
    for n, d in ((5, 9), (40, 9)):
        x, y = some_data(3, n, d)
        to = baseline.ridge_map(x, y, 3)
        # at the optimum the gradient of the penalised squares is zero
        assert np.abs(x.T @ (x @ to - np.eye(3)[y]) + baseline.RIDGE * to).max() < 1e-9


def test_before_fitting_is_the_prototype_sweep(spark):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    conf = sweep.before_after_counts(pairs, [123], [4, 10]).filter("phase = 'before'")
    for split, tag in (("fit", "train"), ("dev", "dev")):
        want = sweep.sweep_counts(pairs, [123], [4, 10], split=split)
        got = conf.filter(F.col("split") == tag).drop("phase", "split")
        assert sorted(rows(got)) == sorted(rows(want))
