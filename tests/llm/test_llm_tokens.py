"""Cross-tokenizer alignment and piecewise encoding: brute force and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL

from diffproto.llm import pieces, tokalign

DOCS = "doc_id long, text string, row string, pairs string, n_a string, kind string"
ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb \n c", "x\r\ny;\r", "tab\tb \t", "don't we'll 'tis rock'n'roll", "<|endoftext|> a<|endoftext|>",
       "<s> </s> <unk> <0x41>", "▁ mark ▁▁", "naïve café à la carte", "à b   c", "a　 b c", "日本語 テスト 漢字。", "emoji 😀😀 x😀", "ﬁ ½ ① Å",
       "\u0000 nul", "é combining ́", "1234567890 12,345.67", "....    ....", "a" * 3000, "é " * 500, "x\x1cy \x1d z", "a\u0085 b", "    indented\n        code()"]


@pytest.fixture(scope="module")
def tok():
    return tokalign.both(*tokalign.default_tokenizers())


def brute_one(tok, text):
    """(a ids, b ids, groups) of a whole text, walked token by token."""
    if not text:
        return [], [], []
    whole = (" " + text).encode()
    a = tok.a.encode(" " + text, add_special_tokens=False).ids
    b = tok.b.encode(text)
    wa, wb = [tok.words[0][i] for i in a], [tok.words[1][i] for i in b]
    if b"".join(wa) != whole or b"".join(wb) != whole:
        return [], [], []
    groups, i, j = [], 0, 0
    while i < len(a):
        x, y, ga, gb = len(wa[i]), len(wb[j]), [a[i]], [b[j]]
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                x, i = x + len(wa[i]), i + 1
                ga.append(a[i - 1])
            else:
                y, j = y + len(wb[j]), j + 1
                gb.append(b[j - 1])
        groups.append((ga, gb))
    return a, b, groups


def brute(tok, rows):
    got = [brute_one(tok, t) for _, t in rows]
    per = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in got]
    count = Counter(p for c in per for p in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for (i, _), (a, b, g), c in zip(rows, got, per, strict=True):
        sha = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if g else ""
        out.append((i, len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in c.items()), sha))
    return sorted(out, key=repr)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *"abcd") for i, t in rows], DOCS)


def result(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=repr)


def some_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).collect()]
    rnd = random.Random(3)
    mixed = ["".join(rnd.choice("ab \n\té😀.'▁日\r Z1") for _ in range(rnd.randrange(1, 60))) for _ in range(150)]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD + mixed)]
    return rows + [(None, "no id here"), rows[0], rows[0]]


@pytest.mark.parametrize("work,heavy,dense", [(64, 50, 2), (1 << 16, 1 << 20, 4096)])
def test_alignment_equals_brute_force(spark, tok, work, heavy, dense, monkeypatch):
    rows = some_rows(spark)
    # the second case's limits hold in this process only, the first's through the arguments and below
    got = result(tokalign.align(docs(spark, rows), *tokalign.default_tokenizers(), work=work, heavy=heavy))
    assert got == brute(tok, rows)
    monkeypatch.setattr(tokalign, "DENSE", dense)
    monkeypatch.setattr(tokalign, "SLICE", 37)
    one = tokalign.Aligned(tok, [t for _, t in rows], work)
    keys = {(int(k) >> 40, (int(k) >> 20) & (1 << 20) - 1, int(k) & (1 << 20) - 1): int(n) for k, n in zip(one.keys, one.times, strict=True)}
    want = {(d, x, y): n for d, (_, t) in enumerate(rows) for (x, y), n in
            Counter((x, y) for ga, gb in brute_one(tok, t)[2] for x in ga for y in gb).items()}
    assert keys == want


def test_alignment_of_nothing(spark):
    assert tokalign.align(docs(spark, []), *tokalign.default_tokenizers()).collect() == []
    got = result(tokalign.align(docs(spark, [(1, None), (1, ""), (None, "▁")]), *tokalign.default_tokenizers()))
    assert got == sorted([(1, *[0] * 6, ""), (1, *[0] * 6, ""), (None, *[0] * 6, "")], key=repr)


@pytest.mark.parametrize("work", [1, 2, 7, 1000])
def test_merge_path_pieces_are_equal_and_complete(work):
    rng = np.random.default_rng(work)
    for n_a, n_b in ((0, 0), (0, 5), (5, 0), (1, 1), (300, 40), (200, 200)):
        a, b = (np.unique(rng.integers(0, 400, n)) for n in (n_a, n_b))
        i, j = tokalign.merge_path(a, b, work)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        steps = np.diff(i + j)
        assert (steps[:-1] == work).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        for x, y in zip(i, j, strict=True):  # all before a boundary comes before all behind it
            assert not x or y == len(b) or a[x - 1] <= b[y]
            assert not y or x == len(a) or b[y - 1] < a[x]
        x, y = tokalign.shared_ends(a, b, work)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_pieces_equal_whole_texts(tok):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokalign.default_tokenizers()[0])
    level = pieces.ByteLevel(plain)
    rnd = random.Random(5)
    texts = [t for t in ODD if t] + ["".join(rnd.choice("ab \n\té😀.'▁日\r  Z1,%") for _ in range(rnd.randrange(1, 80))) for _ in range(800)]
    texts += ["".join(chr(c) for c in range(s, s + 40) if not 0xD800 <= c < 0xE000) + " x" for s in range(1, 0x3100, 37)]
    for marks, most in ((False, 50), (True, 10_000)):
        mem = pieces.Pieces(lambda p: [level.learn(p)], ["<i4"], marks=marks, most=most)
        # a special token's string is cut at its marks: such texts are for the caller to encode whole
        own = [t for t in texts if not marks or "<|endoftext|>" not in t]
        for part in (own[::2], own[1::2], own):
            data, ends = pieces.joined([t.encode() for t in part])
            slots, begins = mem.slots(data, ends)
            ids, n = mem.gather(slots)
            per = np.bincount(np.searchsorted(ends, begins, side="right"), weights=n, minlength=len(part)).astype(int)
            got = np.split(ids, np.cumsum(per)[:-1])
            for t, g in zip(part, got, strict=True):
                assert g.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_one_id_on_many_rows_is_dealt_out(spark):
    """A third of the rows without an id, many of them equal, lie in several partitions."""
    from pyspark.sql import functions as F

    from diffproto.llm import binary_records

    rows = [(None if i % 3 == 0 else i, "same text" if i % 6 == 0 else f"text {i} " + "word " * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one partition
    try:
        data, _ = binary_records.write_records(df, binary_records.default_tokenizer())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = binary_records.read_records(spark, data.removesuffix("/data"))
    per = [r["count"] for r in got.filter("doc_id IS NULL").groupBy(F.substring("file", 1, 10).alias("part")).count().collect()]
    assert got.count() == 3000 and sum(per) == 1000 and len(per) > 1
    at = 0
    for r in got.orderBy("start").collect():
        assert r["start"] == at
        at += r["n_tokens"]
    enc = binary_records.Encoder(binary_records.default_tokenizer())
    assert enc.batch(["", "a b", "<|endoftext|> x", ""]) == enc.whole(["", "a b", "<|endoftext|> x", ""])


def test_files_roll_by_bytes(spark):
    from pyspark.sql import functions as F

    from diffproto.llm import binary_records

    # two texts of about 5 MB of ids each do not share a file of 8 MB
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.repeat(F.lit("zq "), 900_000)).otherwise(F.lit("short")).alias("text"))
    data, index = binary_records.write_records(df.coalesce(1), binary_records.default_tokenizer())
    got = binary_records.read_records(spark, data.removesuffix("/data")).orderBy("doc_id").collect()
    big = [r for r in got if r["doc_id"] < 2]
    assert len(got) == 4 and sum(r["length"] for r in big) > binary_records.FILE_BYTES // 2
    per = {}
    for r in got:
        per[r["file"]] = per.get(r["file"], 0) + r["length"]
    assert all(v <= binary_records.FILE_BYTES + 8 or sum(r["file"] == f for r in got) == 1 for f, v in per.items())
