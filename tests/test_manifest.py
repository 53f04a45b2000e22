"""Appended tables: one copy of a repeated run, whole runs only; error tables that keep every character."""

import pytest

from conftest import rows
from diffproto.plans import sinks
from diffproto.sources import manifest
from diffproto.sources.runlogs import DRIFT_RATE_SCHEMA


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2, "b"), (3, None)], "x int, y string")
    assert rows(manifest.read(spark, path, a.schema)) == []
    manifest.append(a, path, "run/1 é")
    manifest.append(b, path, "2")
    manifest.append(b, path, "run/1 é")
    assert [e["run"] for e in manifest.committed(spark, path)] == ["2", "run/1 é"]
    assert sorted(rows(manifest.read(spark, path, a.schema), "x")) == [(2,), (2,), (3,), (3,)]


def test_a_lost_run_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1,)], "x int")
    manifest.append(a, path, "1")

    def half(df, folder):
        df.write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        manifest.append(a, path, "2", half)
    assert rows(manifest.read(spark, path, a.schema)) == [(1,)]


def test_appended_drift(spark, tmp_path):
    path = str(tmp_path / "d")
    d = spark.createDataFrame([(1, 0.12345, 1.0, 2.0)], DRIFT_RATE_SCHEMA)
    for run in ("a", "b", "a"):
        sinks.append_drift(d, path, run)
    assert rows(sinks.read_appended(spark, path, DRIFT_RATE_SCHEMA)) == [(1, 0.123, 1.0, 2.0)] * 2


def test_error_tables_keep_every_character(spark, tmp_path):
    odd = ["a\tb", "line\nend", "cr\rlf\r\n", ' "quoted" ', "", " blanks  ", "back\\slash\\", '"', "é 日本", "\\\"", "#x", None, "end\\"]
    got = [(i, c, odd[-1 - i], "s", "s" if i % 2 else "n") for i, c in enumerate(odd)]
    df = spark.createDataFrame(got, "dataset_index bigint, claim string, evidence string, y_truth string, y_pred string")
    path = str(tmp_path / "err")
    sinks.write_errors(df.repartition(3), path)
    back = sinks.read_errors(spark, path)
    assert sorted(rows(back)) == sorted((*r, r[3] == r[4]) for r in got)
