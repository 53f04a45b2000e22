"""HTML extraction, language ID, binary records, chat formatting, nearest neighbours and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL

from diffproto.llm import ann, binary_records, chat, html_extract, langid


def table(name, sf=SF_SMALL):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# -- HTML --------------------------------------------------------------------

def article_of(html):
    """The article's headings and paragraphs, read with another parser."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "h1"):
                self.blocks.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    p = P()
    p.feed(html)
    p.close()
    return "\n".join(b for b in (" ".join(x.split()) for x in p.blocks) if b)


def test_pages_equal_another_parser():
    for r in table("pages", "/root/testdata/sf0.01"):
        assert html_extract.main_text(r["html"]) == article_of(r["html"]), r["page_id"]


MIXED = """<html><body><header><a href=/>Site</a></header><div class="top-nav"><p>Home, News, Sport, and more.</p></div>
<div id=cookie-banner><p>We use cookies, as you know. Accept, or leave.</p></div>
<div class=content><h1>A title</h1><p>The first paragraph, which is long enough, has commas.</p><p>Short.</p>
<ul><li>one &amp; two<li>three</ul><table><tr><td>cell a<td>cell b</table><p>Last <b>bold</b>, and <i>done</i>&hellip;</p></div>
<aside>Other, stories.</aside><section id="comments"><p>I liked this, very much, indeed it was good, really.</p></section>
<form><p>Name, email, and the rest, please.</p></form><script>if (a < b) document.write("<p>no, never, nope.</p>")</script></body></html>"""


def test_parts_that_are_no_article_go():
    assert html_extract.main_text(MIXED).split("\n") == [
        "A title", "The first paragraph, which is long enough, has commas.", "Short.", "one & two", "three", "cell a", "cell b",
        "Last bold, and done…"]


def test_sections_beside_the_longest_one_stay():
    long = "".join(f"<p>Paragraph {i}, which is long enough, has commas, and goes on for a while, as they do.</p>" for i in range(30))
    page = ("<body><div class=top><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div id=content><div class=lead><p>A lead.</p></div>"
            "<section><ul><li>one<li>two, <a href=/x>linked</a></ul></section><div class=body>" + long + "</div>"
            "<section><h2><a href=#n>Notes</a></h2><p>Short.</p><p>Also here, a sentence, with commas, of some length.</p></section></div></body>")
    got = html_extract.main_text(page).split("\n")
    assert got[:3] == ["A lead.", "one", "two, linked"] and len(got) == 36
    assert got[-3:] == ["Notes", "Short.", "Also here, a sentence, with commas, of some length."]


@pytest.mark.parametrize("wrap", ["div class=has-sidebar", "div class='page no-sidebar'", "div class=elementor-widget-theme-post-content",
                                  "div id=login-page", "form", "div class=sidebar"])
@pytest.mark.parametrize("article", ["article", "main", "div"])
def test_a_wrapper_with_a_dropped_word_keeps_the_article(wrap, article):
    text = "".join(f"<p>Paragraph {i}, which is long enough, has commas.</p>" for i in range(8))
    page = (f"<body><div class=related><p>Read this, too.</p></div><{wrap}><{article}>{text}"
            f"<div class=share-bar><p>Share it, now.</p></div></{article}>"
            f"<div id=comments><article><p>I liked this, very much, indeed.</p></article></div></{wrap.split()[0]}></body>")
    if article == "div":
        page = page.replace("<article>", "").replace("</article>", "")
    got = html_extract.main_text(page).split("\n")
    assert got == [f"Paragraph {i}, which is long enough, has commas." for i in range(8)]


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt;", "plain <text>"), ("<nav>menu</nav>", ""),
    ("<script>var a = 1", ""), ("<p>cut off <b", "cut off"), ("<!-- <p>no</p> --><p>a\n\t b&nbsp;c</p>", "a b c"),
    ("</p></div><p>x</p>", "x"), ("<style>p{}</style><p>y<br>z", "y z"),
])
def test_small_pages(html, text):
    assert html_extract.main_text(html) == text


def test_extract_keeps_rows_and_columns(spark):
    deep = "<div>" * 20000 + "<p>deep, down here.</p>"
    rows = [(1, "u", MIXED, "t", 5), (1, "u", MIXED, "t", 5), (None, None, None, "t", 6), (2, "v", "<p>" + "a, " * 200000, None, 7), (3, "w", deep, "", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[None] == "" and len(by[2]) == 599999 and by[3] == "deep, down here."
    assert html_extract.extract(df.limit(0)).collect() == []


# -- language ID --------------------------------------------------------------

def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).select("lang", "lang_pred", "score", langid.held_out(docs["doc_id"]).alias("h")).collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edge_cases(spark):
    en, fr = "the cat and the dog went with this", "le chat est avec les chiens dans une école"
    rows = [(i, (en, fr)[i % 2] + f" {i}", ("en", "fr")[i % 2], "x", "y") for i in range(40)]
    rows += [(50, None, "en", "x", "y"), (51, "", "en", "x", "y"), (52, "12 !!", "fr", "x", "y"), (None, en, None, "x", "y"),
             (53, fr * 20000, None, "x", "y"), (1, rows[1][1], "fr", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")
    model = langid.fit(df)
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "und" if r["doc_id"] in (50, 51, 52) else ("en" if "the" in r["text"] else "fr")
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1
        assert (r["score"] == 0) if want == "und" else r["score"] > 0.5
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


def test_language_stage_without_labels_and_with_many(spark):
    import corpus_pipeline as C

    en, fr, de = "the cat and the dog went with this", "le chat est avec les chiens dans une école", "der Hund ist mit den Katzen"
    rows = [(i, (en, fr, de)[i % 3] + f" {i}", ("en", "fr", "de")[i % 3]) for i in range(60)] + [(90, None, "en"), (91, "12 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda d: sorted(r["doc_id"] for r in C.language_id(spark, d, "").collect())
    assert kept(df.withColumn("lang", langid.F.lit(None).cast("string"))) == list(range(60))
    assert kept(df) == list(range(60))
    model = langid.fit(df)
    scores = sorted(r["score"] for r in langid.identify(df, model).filter("doc_id < 60").collect())
    assert langid.accepted(df, min_score=scores[30]).count() == sum(x >= scores[30] for x in scores)
    # every label is learned, however many there are, and the score rule holds
    many = spark.createDataFrame([(i, (en, fr, de)[i % 3] + f" {i}" + f" word{i % 300}x" * 9, f"l{i % 300:03d}") for i in range(2400)], df.schema)
    model = langid.fit(many)
    assert model.langs == sorted({f"l{k:03d}" for k in range(300)}) and model.weights.shape == (langid.LANDMARKS, 300)
    scores = [r["score"] for r in langid.identify(many, model).collect()]
    assert langid.accepted(many, min_score=0.3).count() == sum(x >= 0.3 for x in scores)


@pytest.mark.parametrize("relabel", [False, True])
def test_language_stage_predicts_each_text_once(spark, relabel):
    rows = [(i, ("the cat and the dog", "le chat est une école")[i % 2] + f" {i}", ("en", "fr")[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plan = langid.accepted(df, relabel=relabel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # each one more is one more worker a task


def test_predictions_equal_dense_kernel_ridge(spark, monkeypatch):
    """With every training text a landmark, the model is kernel ridge regression on the whole kernel matrix."""
    rnd = random.Random(3)
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randrange(2, 7)))
    texts = [" ".join(word(a) for _ in range(rnd.randrange(3, 30))) for a in ("abcde", "cdefg", "efghia") for _ in range(40)]
    rows = [(i, t, "xyz"[i // 40]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid.fit_bits, "__defaults__", (10_000, langid.RIDGE))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, langid.fit(df)).collect()}
    learned = {r["doc_id"] for r in df.filter(~langid.held_out(langid.F.col("doc_id"))).collect()}

    def grams(t):
        p = langid._points(t)
        return {b for n in range(1, langid.SPECTRUM + 1) for b in langid.grams(p, n).tolist()}

    sets = [grams(t) for _, t, _ in rows]
    fit = [i for i, _, _ in rows if i in learned]
    seen = set().union(*[sets[i] for i in fit])
    sets = [s & seen for s in sets]  # n-grams of no landmark have no column
    k = np.array([[len(a & sets[j]) / np.sqrt(max(1, len(a)) * max(1, len(sets[j]))) for j in fit] for a in sets])
    y = np.array([[1.0 if rows[j][2] == c else -1.0 for c in "xyz"] for j in fit])
    f = k @ np.linalg.solve(k[fit] + langid.RIDGE * len(fit) / 100 * np.eye(len(fit)), y)
    assert 60 < len(fit) < 120
    for i, _, _ in rows:
        assert got[i][1] == pytest.approx(min(1, max(0, (f[i].max() + 1) / 2)), abs=2e-3)
        top = np.sort(f[i])
        assert top[-1] - top[-2] < 1e-2 or got[i][0] == "xyz"[f[i].argmax()]


def test_kernel_is_the_normalised_count_of_shared_grams():
    texts = ["abc abd", "abd xyz", "hello"]
    every = np.arange(langid.BUCKETS)
    x = langid.presence(texts, every, langid.BUCKETS)
    for t, row in zip(texts, x, strict=True):
        p = langid._points(t)
        grams = {b for n in range(1, langid.SPECTRUM + 1) for b in langid.grams(p, n).tolist()}
        assert set(np.flatnonzero(row)) == grams
    m = langid.fit_bits(x.astype(np.uint8), ["a", "a", "b"])
    k = m.kernel(langid.presence(texts, m.column, m.landmarks.shape[0]))
    assert np.allclose(np.diag(k), 1) and k[0, 1] == pytest.approx((x[0] * x[1]).sum() / np.sqrt(x[0].sum() * x[1].sum()))


# -- binary records ------------------------------------------------------------

def tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(tokens, "tok"):
        tokens.tok = Tokenizer.from_file(binary_records.default_tokenizer())
    return tokens.tok.encode(text, add_special_tokens=False).ids


def test_pieces_equal_whole_texts():
    rnd = random.Random(1)
    parts = ["a", "Word", "don't", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "12", "%%%", "...", "<|endoftext|>", "\u00a0", "\u3000", "日本", "🙂", "x\x1cy", ""]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    texts += [r["text"] for r in table("documents")]
    enc = binary_records.Encoder(binary_records.default_tokenizer())
    for t, ids in zip(texts, enc.batch(texts), strict=True):
        assert np.frombuffer(ids, dtype=enc.type).tolist() == tokens(t), t


def test_a_small_memory_of_pieces_gives_the_same(monkeypatch):
    monkeypatch.setattr(binary_records, "CACHE", 50)
    texts = [r["text"] for r in table("documents")][:40]
    enc = binary_records.Encoder(binary_records.default_tokenizer())
    assert [np.frombuffer(x, dtype=enc.type).tolist() for x in enc.batch(texts)] == [tokens(t) for t in texts]


def test_round_trip(spark):
    rows = [(r["doc_id"], r["text"], "x") for r in table("documents")]
    rows += [(10_000, None, "x"), (10_001, "", "x"), (None, "no id", "x"), (5, rows[0][1], "x"), (5, rows[0][1], "x"), (-3, "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    data, index = binary_records.write_records(df, binary_records.default_tokenizer(), per_file=37)
    got = binary_records.read_records(spark, data.removesuffix("/data")).orderBy("start").collect()
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokens(t or ""), 0]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    # the index leads straight to a record
    place = {(r["file"], r["record"]): r for r in spark.read.parquet(index).collect()}
    r = place[got[3]["file"], got[3]["record"]]
    with open(f"{data.removeprefix('file:')}/{r['file']}", "rb") as f:
        f.seek(r["offset"])
        (_, _, payload), = binary_records.records(f.read(r["length"]))
    assert binary_records.unpack(payload)[0] == got[3]["doc_id"]
    empty, _ = binary_records.write_records(df.limit(0), binary_records.default_tokenizer())
    assert binary_records.read_records(spark, empty.removesuffix("/data")).collect() == []


def test_offsets_hold_beyond_a_thousand_files_of_a_task(spark):
    df = spark.createDataFrame([(None, f"{i:04d}" + " word" * (i % 5)) for i in range(1003)], "doc_id long, text string")
    data, _ = binary_records.write_records(df, binary_records.default_tokenizer(), per_file=1)
    got = binary_records.read_records(spark, data.removesuffix("/data")).orderBy("start").collect()
    assert any("-c1002" in r["file"] for r in got)
    upto = 0
    for i, r in enumerate(got):
        ids = np.array([*tokens(f"{i:04d}" + " word" * (i % 5)), binary_records.END_ID], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (upto, len(ids), zlib.crc32(ids.tobytes()))
        upto += len(ids)


def test_damage_is_found():
    good = b"".join(binary_records.frame(binary_records.pack(i, 2, b"\x01\x00" * i)) + b"\n" for i in range(3))
    assert len(list(binary_records.records(good))) == 3
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            list(binary_records.records(bytes(bad)))
    with pytest.raises(ValueError):
        list(binary_records.records(good[:-3]))


# -- chat -----------------------------------------------------------------------

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "\\", "<", "[", " ", "\n", "a", "é", "🙂"]


def test_parts_join_to_the_whole_rendering():
    rnd = random.Random(2)
    for n in (0, 1, 2, 31, 32, 33, 64, 65, 200):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "</s>"]), "".join(rnd.choice(CONTROL) for _ in range(rnd.randrange(9)))) for _ in range(n)]
        inc = chat.Incremental(chat.inst_template)
        got = [inc.feed(*t) for t in turns]
        assert "".join(g[0] for g in got) == chat.inst_template(turns)
        assert [chat.parse_part(*g[:3]) for g in got] == turns and not any(g[3] for g in got)


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{r}>{'' if r == 'assistant' and i < last else t}" for i, (r, t) in enumerate(turns))

    inc = chat.Incremental(forgetful)
    assert [inc.feed(*t)[3] for t in [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]] == [False, False, True, False]
    counting = chat.Incremental(lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns)), window=4)
    assert any(counting.feed("user", "x")[3] for _ in range(12))


def test_full_prefixes_find_rewrites_beyond_the_window(spark):
    last = lambda turns: "".join(t for _, t in turns[-40:])
    rows = [(1, i, "user", f"t{i};") for i in range(50)] + [(2, i, "user", f"u{i};") for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = {(r["conv_id"], r["seq"]): r for r in chat.format_conversations(df, last, window=None).collect()}
    assert [r for r in full if full[r]["rewrites"]] and all((s >= 40) == full[1, s]["rewrites"] for s in range(50))
    assert not any(r["windowed"] for r in full.values())
    some = {(r["conv_id"], r["seq"]): r["windowed"] for r in chat.format_conversations(df, last).collect()}
    assert all(some[1, s] == (s >= chat.WINDOW) for s in range(50)) and not any(some[2, s] for s in range(3))


def test_long_conversations_are_rendered_whole_whatever_the_template(spark):
    numbered = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    ends = lambda turns: "".join(t for _, t in turns[-40:]) + "."
    rows = [(1, i, "user", f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df, numbered).orderBy("seq").collect()
    assert "".join(r["part"] for r in got) == numbered([(r[2], r[3]) for r in rows]) and not any(r["rewrites"] for r in got)
    assert [r["part"][r["lo"]: r["hi"]] for r in got] == [r[3] for r in rows]
    exact = chat.Incremental(ends, None)
    want = [exact.feed(r[2], r[3]) for r in rows]
    got = chat.format_conversations(df, ends).orderBy("seq").collect()
    assert [(r["part"], r["lo"], r["hi"], r["rewrites"]) for r in got] == want
    # a template that declares itself append-only is streamed, and comes out the same
    turns = [(r[2], r[3]) for r in rows]
    got = chat.format_conversations(df).orderBy("seq").collect()
    assert "".join(r["part"] for r in got) == chat.inst_template(turns) and not any(r["rewrites"] for r in got)


def brute_digest(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest(), len(chat.inst_template(turns)))
    return out


def test_chat_digests(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    rnd = random.Random(3)
    rows += [(9000, i, rnd.choice(["user", "assistant"]), "".join(rnd.choice(CONTROL) for _ in range(6))) for i in range(150)]
    rows += [(9001, None, None, None), (9001, 1, "assistant", None), (9001, 1, "assistant", "b"), (9001, 1, "assistant", "b"),
             (None, 0, "user", "x"), (None, 1, "assistant", "y" * 100000), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, seq int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got == brute_digest(rows)
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


# -- nearest neighbours -----------------------------------------------------------

def brute_nearest(rows, k=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_nearest_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # ties
    rows += [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (380, [float("nan")] * 6), (400, [float("inf")] * 6),
             (None, rows[0][1]), (0, rows[0][1]), (420, [1.0, 2.0]), (441, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert got[420] == [(-5.0, 441)]
    assert [i for _, i in got[220]] == [i for _, i in want[220]]  # a tie among equal vectors goes to the smaller ids
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_recall_where_the_search_stops_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    v = centres[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 32))
    v *= rng.uniform(0.8, 1.2, size=(6000, 1))
    found, share = ann.search_block(np.arange(6000), v, np.arange(0, 6000, 60), v[::60])
    hit = 0
    for row, ids, scores in found:
        s = v @ v[row * 60]
        s[row * 60] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(ids))
        assert np.allclose(scores, s[ids])
    assert share < 0.6 and hit >= 0.95 * 20 * len(found)


def test_chi_square_law():
    x = np.random.default_rng(3).chisquare(8, 200_000)
    for p in (0.1, 0.5, 0.9):
        assert (x <= ann.chi2_quantile(p, 8)).mean() == pytest.approx(p, abs=0.01)


# -- pipeline ---------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as C
    from test_llm_pairs import brute_components, brute_targets, shingle_set

    docs = [r for r in table("documents") if r["text"] and any(c.isalpha() for c in r["text"])]
    comp = brute_components([(r["doc_id"], r["text"]) for r in docs])
    docs = [r for r in docs if comp[r["doc_id"]][1] == r["doc_id"]]
    items = [shingle_set(r["text"]) for r in table("benchmark")]
    docs = [r for r in docs if not any(q and 4 * len(shingle_set(r["text"]) & q) >= 3 * len(q) for q in items)]
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode().split())
    target = brute_targets(sizes)
    out, start = [], 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        rate = target[r["source"]] / sizes[r["source"]]
        draw = int(hashlib.md5(f"17:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        ids = [*tokens(r["text"]), 0]
        for _ in range(int(rate) + (draw < rate - int(rate))):
            out.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
    got = C.run(spark, SF_SMALL).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == out
    names = pq.read_schema(f"{SF_SMALL}/documents.parquet").names
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, d.limit(0), SF_SMALL).columns == names


def test_the_language_found_goes_into_the_records(spark):
    import corpus_pipeline as C

    en, fr = "the cat and the dog went with this", "le chat est avec les chiens dans une école"
    rows = [(i, (en, fr)[i % 2] + f" {i}", None if i % 5 == 0 else ("en", "fr")[i % 2]) for i in range(60)] + [(90, "12 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = C.language_id(spark, df, "")
    want = {i: ("en", "fr")[i % 2] for i in range(60)}
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == want
    got = C.binary_output(spark, found, "").collect()
    assert {r["doc_id"]: r["lang"] for r in got} == want and len(got) == 60
    blank = C.binary_output(spark, df.withColumn("lang", langid.F.lit(None).cast("string")).limit(3), "").collect()
    assert [r["lang"] for r in blank] == [None] * 3
    one, = [p for *_, p in binary_records.records(binary_records.frame(binary_records.pack(None, 2, b"\x01\x00", "é")) + b"\n")]
    assert binary_records.unpack(one)[0] is None and binary_records.tag_of(one) == "é" and binary_records.body(one) == (None, 2, 1)


def test_frames_hold_null_and_large_ids():
    big = (1 << 62) + 1
    f = binary_records._frame([("f", 0, None), ("f", 1, big)], ["file", "record", "doc_id"])
    assert f["doc_id"].isna().tolist() == [True, False] and f["doc_id"][1] == big
