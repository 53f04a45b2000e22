import pytest
from pyspark.sql import functions as F

from diffproto.operators import evaluate, sampling
from diffproto.plans import experiment, registry, sweep
from conftest import SF_SMALL, rows


def test_numpy_and_sql_engines_agree(spark):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    a = sweep.sweep_counts(pairs, [123, 124], [2, 10], engine="numpy")
    b = sweep.sweep_counts(pairs, [123, 124], [2, 10], engine="sql")
    assert sorted(rows(a)) == sorted(rows(b))


def test_sweep_cell_equals_single_experiment(spark):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    conf = sweep.sweep_counts(pairs, [123], [20]).drop("seed", "m")
    single = evaluate.confusion_long(experiment.score(pairs, 123, 20))
    assert sorted(rows(conf, "y_truth", "y_pred", "n")) == sorted(rows(single, "y_truth", "y_pred", "n"))


def test_capped_sweep(spark):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    caps = {0: 100, 1: 50, 2: 60}
    conf = sweep.sweep_counts(pairs, [123], [10], caps=caps)
    total = sum(r[0] for r in rows(conf, "n"))
    assert total == (100 - 10) + (50 - 10) + (60 - 10)


def test_fit_split_scores_fit_rows(spark):
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    conf = sweep.sweep_counts(pairs, [123], [4], split="fit")
    assert sum(r[0] for r in rows(conf, "n")) == 12


def test_grid_split_when_pack_exceeds_limit(spark, monkeypatch):
    """A grid whose prototype pack is over the broadcast limit is scored in
    several passes, with the same counts."""
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    one = sweep.sweep_counts(pairs, [123, 124, 125], [2, 4])
    cell = 3 * (8 * 64 + 32)
    for limit, n in ((5 * cell, 2), (cell, 6), (1, 6)):
        monkeypatch.setattr(sweep, "broadcast_limit", lambda s, limit=limit: limit)
        groups = sweep.cell_groups(spark, [123, 124, 125], [2, 4], 64)
        assert len(groups) == n
        assert sorted((s, m) for a, b in groups for s in a for m in b) == [(s, m) for s in (123, 124, 125) for m in (2, 4)]
    monkeypatch.setattr(sweep, "broadcast_limit", lambda s: 5 * cell)
    assert sorted(rows(one)) == sorted(rows(sweep.sweep_counts(pairs, [123, 124, 125], [2, 4])))


def test_mistakes_raise(spark):
    """A vector of another length, a class without a cap, and an encoder without fit rows."""
    pairs = registry.flagship_pairs(spark, SF_SMALL).select("claim_id", "set_pos", "label", "diff")
    odd = pairs.withColumn("diff", F.when(F.col("claim_id") == 499, F.array(F.lit(1.0))).otherwise(F.col("diff")))
    with pytest.raises(Exception, match="vector length|must match|same shape"):
        sweep.sweep_counts(odd, [123], [2], dim=64).collect()
    with pytest.raises(Exception, match="no cap for class"):
        sampling.cap_per_class(pairs, 123, {0: 10, 1: 10}).collect()
    two = pairs.withColumn("encoder", F.when(F.col("label") >= 0, F.lit("a"))).unionByName(
        pairs.limit(1).withColumn("claim_id", F.lit(10 ** 6)).withColumn("label", F.lit(0)).withColumn("encoder", F.lit("b")))
    with pytest.raises(Exception, match="no prototypes for encoder"):
        sweep.sweep_counts(two, [123], [2], encoder_col="encoder", n_encoders=2).collect()


def test_two_set_experiment(spark):
    """Fit on one pair set, evaluate on another capped per class."""
    pairs = registry.flagship_pairs(spark, SF_SMALL)
    fit_set = pairs.filter(F.col("claim_id") < 250)
    dev_set = pairs.filter(F.col("claim_id") >= 250)
    sc = experiment.score_two_sets(fit_set, dev_set, 123, 10, dev_cap=40)
    per_class = dict(rows(sc.groupBy("truth").count(), "truth", "count"))
    assert per_class == {0: 40, 1: 40, 2: 40}
    assert not set(rows(sc, "claim_id")) & set(rows(fit_set, "claim_id"))
    acc = evaluate.accuracy(sc).first().accuracy
    assert acc > 0.9
