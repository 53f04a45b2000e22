"""Columns whose names clash with the operators' own, and texts that hold every sentinel."""

from pyspark.sql import functions as F

from diffproto.llm import chat, mixing, url_filter


def test_mix_returns_the_callers_columns(spark):
    names = ["rate", "weight", "target", "size", "copies", "source_size", "__s", "level", "limit"]
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    plain = mixing.mix(df.select("doc_id", "text", "source"))
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names)
    counted = mixing.mix_counts(df.drop("__s")).collect()
    assert {r["rate"] for r in counted} == {f"rate{i}" for i in range(300)} and {r["weight"] for r in counted} == {f"weight{i}" for i in range(300)}
    assert all(isinstance(r["target"], float) and isinstance(r["size"], int) for r in counted)


def test_mix_with_other_column_names(spark):
    df = spark.createDataFrame([(i, "a b c", "x", "own") for i in range(20)], "id long, body string, origin string, source string")
    got = mixing.mix(df, id_col="id", source="origin", text="body")
    assert got.columns == df.columns and {r["source"] for r in got.collect()} == {"own"}


def test_url_filter_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "https://a.org/x", "c", "d"), (2, "https://b.org/y", "c", "d")], "page_id long, url string, w0 string, w7 string")
    listed = spark.createDataFrame([("a.org/x",)], "canonical string")
    got = {r["page_id"]: (r["verdict"], r["w0"], r["w7"]) for r in url_filter.filter_urls(df, listed).collect()}
    assert got == {1: ("block", "c", "d"), 2: ("allow", "c", "d")}


def test_a_text_with_every_sentinel(spark):
    every = "".join(map(chr, range(0xE000, 0xF900)))
    for text in (every, every + "\ue000" * 5 + "x", "\ue001\ue000" + every):
        s = chat._absent(text)
        assert s not in text and (text + s + text).count(s) == 1
    rows = [(1, 1, "user", every), (1, 2, "assistant", "\ue000" * 3 + every), (1, 3, "user", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = spark.createDataFrame([(c, t, r, "x" * len(x)) for c, t, r, x in rows], df.schema)
    spans = lambda d: sorted((r["seq"], r["lo"], r["hi"], r["rewrites"]) for r in chat.format_conversations(d).collect())
    assert spans(df) == spans(plain)
