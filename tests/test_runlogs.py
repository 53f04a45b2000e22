import os

import pytest
from pyspark.sql import functions as F

from diffproto.operators.summary import runs_mean_stdpop
from diffproto.sources import runlogs as RL
from conftest import rows

# A run log in the three-line layout (marker line, then "m model seed",
# "Accuracy: x", "F1-macro: y" per run), given from outside the repository.
REF_LOG = os.environ.get("DIFFPROTO_RUN_LOG", "")


def _log(tmp_path, text):
    d = tmp_path / "log"
    d.mkdir()
    (d / "part-0.txt").write_text(text)
    return str(d)


def test_cut_off_record_dropped(spark, tmp_path):
    text = "noise\nfever_fever\n2 m1 123\nAccuracy: 0.5\nF1-macro: 0.4\n4 m1 123\nAccuracy: 0.6\n"
    got = rows(RL.parse_runs(spark, _log(tmp_path, text)), "m", "model", "seed", "accuracy", "f1")
    assert got == [(2, "m1", 123, 0.5, 0.4)]


def test_noise_lines_removed(spark, tmp_path):
    text = "fever_fever\n2 m1 1\nfever --> fever:\nAccuracy: 0.5\nF1-macro: 0.4\n"
    got = rows(RL.parse_runs(spark, _log(tmp_path, text), noise=["fever --> fever:"]), "m", "accuracy")
    assert got == [(2, 0.5)]


def test_run_line_layout_and_tokens(spark, tmp_path):
    text = "seed: 7; # of shots: 10; index of run:2\nx\ny\nz\nAcc: 0.7; F1-macro: [0.6]\n"
    got = rows(RL.parse_runs(spark, _log(tmp_path, text), RL.LAYOUTS["baseline_five"], marker=None))
    assert got == [(7, 10, 2, 0.7, 0.6)]


def test_missing_marker_raises(spark, tmp_path):
    with pytest.raises(Exception, match="no line 'fever_fever'"):
        RL.parse_runs(spark, _log(tmp_path, "2 m1 1\nAccuracy: 0.5\nF1-macro: 0.4\n")).collect()


@pytest.mark.parametrize("anchored", [True, False])
def test_long_files_in_many_splits(spark, tmp_path, anchored, monkeypatch):
    monkeypatch.setattr(RL, "BUCKET", 7)
    n = 300
    body = "".join(f"{i} m{i % 3} 1\nnoise line\nAccuracy: 0.{i:04d}\nF1-macro: 0.5\n" for i in range(n))
    path = _log(tmp_path, "before\nfever_fever\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = RL.parse_runs(spark, path, noise=["noise line"], anchored=anchored)
        assert sorted(rows(got, "m", "accuracy")) == [(i, float(f"0.{i:04d}")) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_render_and_parse_roundtrip(spark, tmp_path):
    recs = spark.createDataFrame([("m1", 1, 2, 0.5, 0.25), ("m1", 2, 2, 0.75, 0.5), ("m2", 1, 4, 1.0, 1.0)],
                                 "model string, seed int, m int, accuracy double, f1 double")
    path = str(tmp_path / "rt")
    RL.write_log(RL.render_records(recs, "noise"), path)
    got = sorted(rows(RL.parse_runs(spark, path, noise=["noise"]), "model", "seed", "m", "accuracy", "f1"))
    assert got == sorted(rows(recs, "model", "seed", "m", "accuracy", "f1"))


@pytest.mark.skipif(not (REF_LOG and os.path.exists(REF_LOG)), reason="set DIFFPROTO_RUN_LOG to a run log")
def test_shipped_log_means(spark, tmp_path):
    """Parsing a published multi-seed run log reproduces the means and
    """
    d = tmp_path / "ref"
    d.mkdir()
    (d / "log.txt").write_text(open(REF_LOG).read())
    runs = RL.parse_runs(spark, str(d))
    assert runs.count() == 300
    summ = runs_mean_stdpop(runs, ["accuracy", "f1"])
    got = {(r.model, r.m): (r.mean_accuracy, r.std_accuracy) for r in summ.collect()}
    assert got[("bert-base-uncased", 2)][0] == pytest.approx(0.3831, abs=1e-4)
    assert got[("bert-base-uncased", 2)][1] == pytest.approx(0.0235, abs=1e-4)
    assert got[("bert-base-nli-mean-tokens", 100)][0] == pytest.approx(0.6941, abs=1e-4)
    assert got[("bert-large-uncased", 100)][0] == pytest.approx(0.5936, abs=1e-4)
