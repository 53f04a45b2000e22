import pytest
from pyspark.sql import functions as F

from diffproto.functions import labels as L
from diffproto.functions import text as TX


def test_brackets_and_case_order(spark):
    df = spark.createDataFrame([(" -LRB-X-RRB- ",)], "s string")
    r = df.select(TX.normalize_evidence("s").alias("e"), TX.normalize_claim("s").alias("c"),
                  TX.normalize_claim("s", fix_order=True).alias("f")).first()
    assert r.e == "(x)"
    assert r.c == "-lrb-x-rrb-"          # claim is lowered before cleaning
    assert r.f == "(x)"


def test_clean_brackets_all_tokens(spark):
    df = spark.createDataFrame([("a -LSB-b-RSB- -LRB-c-RRB- -lrb-",)], "s string")
    assert df.select(TX.clean_brackets("s")).first()[0] == "a [b] (c) -lrb-"


def test_strip_unicode_blanks(spark):
    df = spark.createDataFrame([("\t  Text here  \n\x0b",)], "s string")
    assert df.select(TX.strip_text("s")).first()[0] == "Text here"


def test_join_selected_order_repeats_empty(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [2, 0, 2]), (["a"], [])], "s array<string>, i array<int>")
    assert [r[0] for r in df.select(TX.join_selected("s", "i")).collect()] == ["c a c", ""]


def test_join_selected_out_of_range_raises(spark):
    df = spark.createDataFrame([(["a"], [3])], "s array<string>, i array<int>")
    with pytest.raises(Exception):
        df.select(TX.join_selected("s", "i")).collect()


def test_encode_label_and_unknown(spark):
    df = spark.createDataFrame([("SUPPORTS",), ("NOT ENOUGH INFO",), ("REFUTES",)], "w string")
    assert [r[0] for r in df.select(L.encode_label("w")).collect()] == [0, 1, 2]
    bad = spark.createDataFrame([("OTHER",)], "w string")
    with pytest.raises(Exception):
        bad.select(L.encode_label("w")).collect()
    c = spark.createDataFrame([("SUPPORT",), ("CONTRADICT",)], "w string")
    assert [r[0] for r in c.select(L.encode_label("w", L.CORPUS_LABELS)).collect()] == [0, 2]


def test_decode_and_binary(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (7,)], "c int")
    out = df.select(L.decode_three("c"), L.decode_binary("c")).collect()
    assert [tuple(r) for r in out] == [("s", "s"), ("n", "not"), ("c", "not"), ("c", "not")]
    ok = spark.createDataFrame([(0,), (1,), (2,)], "c int")
    assert [r[0] for r in ok.select(L.label_to_binary("c")).collect()] == [0, 1, 1]
    with pytest.raises(Exception):
        df.select(L.label_to_binary("c")).collect()


def test_doc_id_cast(spark):
    df = spark.createDataFrame([("4",), (" 5",)], "s string")
    assert [r[0] for r in df.select(TX.to_doc_id("s")).collect()] == [4, 5]
    with pytest.raises(Exception):
        spark.createDataFrame([("x4",)], "s string").select(TX.to_doc_id("s")).collect()
