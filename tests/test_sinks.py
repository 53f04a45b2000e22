import os

from pyspark.sql import functions as F

from diffproto.plans import sinks
from diffproto.sources.runlogs import DRIFT_SCHEMA, read_drift
from conftest import rows


def test_write_errors_one_pass(spark, tmp_path):
    sc = spark.createDataFrame([(0, "a", "b", "s", "s"), (1, "c", "d", "s", "n")],
                               "dataset_index bigint, claim string, evidence string, y_truth string, y_pred string")
    path = str(tmp_path / "err")
    sinks.write_errors(sc, path)
    assert sorted(x for x in os.listdir(path) if x.startswith("is_correct")) == ["is_correct=false", "is_correct=true"]
    back = spark.read.option("sep", "\t").option("header", "true").csv(path)
    assert sorted((a, str(b).lower()) for a, b in rows(back, "dataset_index", "is_correct")) == [("0", "true"), ("1", "false")]


def test_drift_overwrite_append_roundtrip(spark, tmp_path):
    d = spark.createDataFrame([("1_2", 1, 2, 3.2764, 4.8861, 2.7849)], DRIFT_SCHEMA)
    path = str(tmp_path / "drift")
    sinks.write_drift(d, path)
    sinks.write_drift(d, path, append=True)
    back = read_drift(spark, path)
    assert rows(back) == [("1_2", 1, 2, 3.276, 4.886, 2.785)] * 2


def test_summaries_partitioned(spark, tmp_path):
    s = spark.createDataFrame([("fever", "m1", 2, 0.12345), ("fever", "m2", 2, 0.5)],
                              "dataset string, model string, m int, mean_acc double")
    path = str(tmp_path / "summ")
    sinks.write_summaries(s, path)
    assert sorted(x for x in os.listdir(os.path.join(path, "dataset=fever")) if x.startswith("model=")) == ["model=m1", "model=m2"]



def test_scratch_tables_can_be_dropped(spark):
    from diffproto.session import drop_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path.removeprefix("file:"))
    drop_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
