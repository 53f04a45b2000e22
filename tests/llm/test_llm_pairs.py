"""N-gram join, decontamination, mixing, line dedup and URL filters: edge cases and brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import SF_SMALL

from diffproto.llm import decontam, line_dedup, mixing, ngram_join, url_filter

DOCS = "doc_id long, text string, source string, lang string, n_shingles string, component_id string, size string, key string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", None, "x", "y", "z", "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1))


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets}


def near_copies(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows, bases = [], [text(n) for n in (6, 9, 14, 30, 60, 120, 300)]
    passage = text(40)
    for _ in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 4)):
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            else:
                w = w[: rnd.randrange(max(1, len(w) - 8), len(w) + 1)]
        if rnd.random() < 0.2:
            w = w + passage
        rows.append(" ".join(w))
    rows += [" ".join(text(rnd.randrange(1, 30)) + passage) for _ in range(40)]
    rows += ["a b", "A  b", "a b c d", "a b c d e", "", "   ", rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1])
def test_join_equals_brute_force(spark, seed, monkeypatch):
    rows = near_copies(seed)
    monkeypatch.setattr(ngram_join, "SALT_FROM", 8)  # the salted path too
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("boundary", [0, 64])
def test_any_boundary_gives_the_same_links(spark, boundary, monkeypatch):
    rows = near_copies(5)[:120]
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: boundary)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (None, "a b c d e f"), (5, "a b c d e f"),
            (5, "a b c d e f"), (0, "q r s"), (7, "Q R S")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs(spark, rows)).collect()),
                 key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 29996, 3), (4, 29997, 3), (None, 2, None), (5, 2, 5), (5, 2, 5),
                          (0, 1, 0), (7, 1, 0)], key=repr)
    kept = ngram_join.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, None, 5, 0], key=repr)
    assert ngram_join.link_components(docs(spark, [])).collect() == []


def test_keep_one_tells_texts_under_one_id_apart(spark):
    base = [f"w{i}" for i in range(40)]
    far = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, " ".join(base)), (5, " ".join([*base, "end"])), (5, far("a")), (5, far("b")), (5, far("b").upper()), (5, ""), (5, None),
            (7, far("c")), (7, far("c") + " end"), (8, far("d"))]
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in ngram_join.keep_one(docs(spark, rows)).collect()))
    assert [r for r in kept if r[0] != 7] == sorted([(1, rows[0][1]), (5, far("a")), (5, far("b")), (5, ""), (5, ""), (8, far("d"))])
    assert sum(r[0] == 7 for r in kept) == 1


def test_words_are_hashed_alike_wherever_they_stand():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abAB\x85é🙂") for _ in range(rnd.choice([1, 2, 9, 64, 65, 300])))
    some = [word() for _ in range(300)] + ["x" * 70000, "x" * 70001]
    of = {}
    for n in (1, 4, 500, 20000):
        ws = [rnd.choice(some) for _ in range(n)]
        text = "\n" + "".join(w + rnd.choice([" ", "\t\v", "\f\r "]) for w in ws)
        got = ngram_join.word_hashes(text[:-1] if n == 4 else text).tolist()
        want = text.encode().lower().split()
        assert len(got) == len(want) and all(of.setdefault(w, h) == h for w, h in zip(want, got, strict=True))
    assert len(set(of.values())) == len(of) > 200
    for none in (None, "", " \n " * 40000):
        assert not len(ngram_join.word_hashes(none)) and not len(ngram_join.shingles(none))


def test_keep_one_reads_texts_once_without_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "g h i j k l"), (None, "a b c d e f"), (4, None)]
    kept = ngram_join.keep_one(docs(spark, rows))
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, None, 4], key=repr)


@pytest.mark.parametrize("salts", [np.uint16, np.int64])
def test_frames_of_listed_keys_are_bounded(salts):
    rnd = random.Random(4)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(n)) for n in [20000, *[400] * 2000, 0, 3]]
    levels = np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.uint8)
    heavy = np.full(len(levels), 4094, dtype=salts)
    shared = SimpleNamespace(value=(levels, heavy, 24))
    run = ngram_join._second_pass(5, 0, shared, 75, 100)
    got = list(run([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]))
    assert max(f["key"].map(len).sum() for f in got) <= 1 << 17 and len(got) > 1
    sets = [h for t in texts if len(h := ngram_join.shingles(t))]
    want = [ngram_join.identity(h, 0)[0] for h in sets]
    assert [c for f in got for c in f["cid"]] == want and [n for f in got for n in f["n"]] == [len(h) for h in sets]
    keys = [k for f in got for k in f["key"]]
    assert all((k == ngram_join.signed(ngram_join.class_keys(h, levels, 24, 75, 100)[0])).all() for k, h in zip(keys, sets, strict=True))
    assert {int(a) & 4095 for f in got for c, at in zip(f["cid"], f["at"], strict=True) for a in at if c == want[0]} == {want[0] % 4094 + 1}


def test_links_inside_components_are_listed(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    rnd = random.Random(5)
    rows = []
    for g in range(2):
        base = [f"{g}w{i}" for i in range(200)]
        for i in range(12):
            t = list(base)
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(200)] = f"z{rnd.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(t)))
    rows += [(50, rows[0][1]), (51, "one two three"), (52, None), (None, rows[0][1]), (53, "a b c d e f g h"), (54, "a b c d e f g h i")]
    pairs, members = ngram_join.links(docs(spark, rows))
    of = {r["doc_id"]: r["cid"] for r in members.collect()}
    sets = {of[d]: shingle_set(t) for d, t in rows if d is not None and t}
    want = {(x, y, len(a), len(b), len(a & b)) for x, a in sets.items() for y, b in sets.items()
            if x < y and 100 * len(a & b) >= 75 * len(a | b)}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    known = [(d, shingle_set(t)) for d, t in rows if d is not None and t]
    n = {d: sum(100 * len(a & b) >= 75 * len(a | b) for e, b in known if e != d) for d, a in known}
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(pairs, members).collect()} == n


def test_components_of_a_long_chain(spark):
    from diffproto.llm.common import components

    ids = list(range(60))
    random.Random(3).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101), (101, 101), (102, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 100}


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 50))) for i in range(30)] + [(30, "one two"), (31, None), (32, ""), (None, "z " * 9)]
    rows = []
    for i in range(150):
        body = text(rnd.choice([3, 20, 200, 3000]))
        if i % 3 == 0:
            w = items[rnd.randrange(30)][1].split()
            w = w[: max(1, int(len(w) * rnd.choice([0.5, 0.75, 0.8, 0.9, 1])))]
            body = f"{body} {' '.join(w).upper()} {text(4)}"
        rows.append((i, body))
    rows += [(500, "one two"), (501, "one two three four five six"), (502, None), (503, ""), (None, items[0][1]), (504, items[1][1]), (504, items[1][1])]
    its = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontam.contained(docs(spark, rows), its).collect()}
    want = {}
    for d, t in rows:
        for i, u in items:
            x, q = shingle_set(t), shingle_set(u)
            if d is not None and i is not None and q and 4 * len(x & q) >= 3 * len(q):
                want[d, i] = (len(q), len(x & q))
    assert got == want and want
    clean = decontam.decontaminate(docs(spark, rows), its)
    assert clean.columns == docs(spark, []).columns
    hit = {d for d, _ in want}
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(d) for d, _ in rows if d not in hit)
    assert decontam.contained(docs(spark, []), its).collect() == []
    assert decontam.contained(docs(spark, rows), its.limit(0)).collect() == []


def test_decontamination_goes_by_row(spark):
    item = " ".join(f"i{n}" for n in range(20))
    clean = " ".join(f"c{n}" for n in range(50))
    rows = [(None, "before " + item + " after"), (None, clean), (1, clean), (1, clean + " " + item), (2, None), (3, item), (4, "")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in decontam.decontaminate(docs(spark, rows), items, null_ids=True).collect()), key=repr)
    assert got == sorted([(None, clean), (1, clean), (2, None), (4, "")], key=repr)


def brute_targets(sizes, weights=(3, 1, 2), cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, todo, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while todo:
        level = left / sum(w[s] for s in todo)
        over = {s for s in todo if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in todo}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        todo -= over
    return target


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randrange(1, 40)), rnd.choice(["a", "b", "B", "é", None, "c"])) for i in range(3000)]
    rows += [(3000, None, "empty"), (3001, "  ", "empty"), (None, "x y", "a"), (7, "p q", "b"), (7, "p q", "b")]
    df = docs(spark, rows)
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.15)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_counts(df.repartition(7)).collect()))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mix_counts(docs(spark, [(1, "", "a")])).collect()[0]["copies"] == 0


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nshared line\n  near \n\nshared line", f"s{i}") for i in range(20)]
    rows += [(100 + i, f"near\nlocal\nx{i}", f"s{i % 3}") for i in range(9)]
    rows += [(None, "shared line\nkeep", "s1"), (200, None, "s1"), (201, "", "s1"), (202, "shared line", None),
             (203, "y " * 100000, "s2"), (0, "own 0\nshared line\n  near \n\nshared line", "s0")]
    df = docs(spark, rows)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(df, min_sites=10).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        ls = (t or "").split("\n") if t is not None else []
        kept = [x for x in ls if x.strip() not in ("shared line", "near")]
        want.append((d, len(ls), len(ls) - len(kept), t if len(kept) == len(ls) else "\n".join(kept)))
    assert got == sorted(want, key=repr)
    # spread just at, under and over the threshold, with a sketch too small to tell
    edge = [(i, f"line{k}", f"s{i}") for k in (9, 10, 11, 30) for i in range(k)]
    found = {r["line"] for r in line_dedup.spread(docs(spark, edge), min_sites=10, lg_k=4).collect()}
    assert len(found) == 3
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


URLS = [None, "", "no scheme", "http://EXAMPLE.net/en/x", "https://a.example.net/EN/", "https://net", "https://net/", "x://y.org/fr/?q#f",
        "http://b.example.com/de/1.html", "http://example.com/den", "HTTP://www.Bad.org/p/?x", "https://m.bad.org/p.html#z", "a://b://c.net/q",
        "http://notexample.net", "http://h\nx/p"]


def test_url_filters(spark):
    rows = [(i, u, "c", "d") for i, u in enumerate(URLS)] + [(0, URLS[0], "c", "d"), (None, URLS[3], "c", "d"), (99, "http://bad.org/p/" + "q" * 100000, "c", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("bad.org/p",), (None,), ("bad.org/p",), ("x.y/z",)], "canonical string")
    got = url_filter.filter_urls(pages, listed).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["page_id"] is not None}
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by[4] == ("a.example.net", "/EN/", "net/", "block")
    assert by[5] == ("net", "", None, "allow") and by[6] == ("net", "/", "net/", "block")
    assert by[7] == ("y.org", "/fr/", "org/fr/", "allow")
    assert by[8][2:] == ("example.com/de/", "block") and by[9][2:] == (None, "allow")
    assert by[10] == ("www.bad.org", "/p/", None, "block") and by[11][3] == "block"
    assert by[12] == ("b:", "//c.net/q", None, "allow") and by[13][2:] == (None, "allow")
    assert by[14] == ("h\nx", "/p", None, "allow") and by[99][3] == "allow"
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0)).collect() if r["rule"] is None} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed).collect() == []


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k/"), "id").alias("canonical"))
    probe = spark.range(10000).select("id", F.concat(F.lit("k/"), "id").alias("u"))
    got = url_filter.listed_urls(probe, F.col("u"), keys)
    assert got.filter(F.col("listed") != (F.col("id") < 5000)).count() == 0 and got.count() == 10000


SQL_QUERIES = ["op2_ngram_jaccard_join", "op3_benchmark_decontamination", "op7_source_mixing", "op8_url_filters", "op9_line_dedup",
               "op10_nearest_neighbours"]


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
    import oracle_check

    from diffproto.llm.queries import ORACLE_SQL, QUERIES

    r = oracle_check.compare(spark, oracle_check.duck(SF_SMALL), name, QUERIES[name], ORACLE_SQL[name], SF_SMALL)
    assert r["cols_match"] and r["rows"] == r["oracle_rows"] and r["hash_match"], r
