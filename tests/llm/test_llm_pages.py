"""Pages on which class words, foreign elements or missing marks once lost or leaked text; path ratios by brute force."""

import math
import re

import pytest

from diffproto.llm import html_extract as H

LONG = "This is a sentence of the article, with commas, and with a full stop at its end. "


def page(body, nav="<nav><a href=/>Home</a></nav>"):
    return f"<html><head><title>t</title></head><body>{nav}{body}<footer>Foot of the page</footer></body></html>"


@pytest.mark.parametrize("part,text", [
    ('<h2 id="comments-on-method">On method</h2>', "On method"),
    ('<h2 id="menu">The menu</h2>', "The menu"),
    ('<p id="share">' + LONG.strip() + "</p>", LONG.strip()),
    (f'<div class="related-work"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG.strip()}\n{LONG.strip()}"),
    (f'<div class="login-flow-explained"><p>{LONG * 2}</p></div>', (LONG * 2).strip()),
])
def test_parts_of_an_article_stay(part, text):
    got = H.main_text(page(f"<article><h1>Head</h1><p>{LONG}</p>{part}<p>{LONG * 3}</p></article>"))
    assert got == "\n".join(["Head", LONG.strip(), text, (LONG * 3).strip()])


def test_a_section_of_main_stays():
    got = H.main_text(page(f'<main><h1>Head</h1><p>{LONG}</p><section class="social-history"><p>{LONG * 2}</p></section></main>'))
    assert got == f"Head\n{LONG.strip()}\n{(LONG * 2).strip()}"


@pytest.mark.parametrize("part", ['<div class="comments"><p>I say this, too. And that.</p></div>', '<div class="comment-list"><p>Nice, very nice.</p></div>',
                                  '<div class="share">Share this</div>', '<p class="notice">A notice</p>', '<div class="related"><a href=1>More</a></div>',
                                  '<div class="share-buttons"><a href=1>A</a> <a href=2>B</a></div>'])
def test_named_parts_of_an_article_go(part):
    got = H.main_text(page(f"<article><h1>Head</h1><p>{LONG * 4}</p><p>{LONG * 5}</p>{part}</article>"))
    assert got == f"Head\n{(LONG * 4).strip()}\n{(LONG * 5).strip()}"


@pytest.mark.parametrize("inner,text", [
    ("before <svg><g><text>LEAK</text></g></svg> after", "before after"),
    ("before <svg><foreignObject><div><p>LEAK</p></div></foreignObject></svg> after", "before after"),
    ("before <math><mi>x</mi><mo>=</mo></math> after", "before after"),
    ("before <button>Press <div>me</div></button> after", "before after"),
    ("before <select><option>one<option>two</select> after", "before after"),
    ("before <my-word>inside</my-word> after", "before inside after"),
    ("before <custom-el attr='x'><b>bold</b></custom-el>, after", "before bold, after"),
    ("before <video><p>LEAK</p></video> after", "before after"),
])
def test_what_stands_in_a_paragraph_does_not_end_it(inner, text):
    assert H.main_text(page(f"<article><p>{inner}</p><p>{LONG}</p></article>")) == f"{text}\n{LONG.strip()}"


def test_block_elements_end_a_paragraph():
    assert H.main_text(page(f"<article><p>one<div>two</div>three<ul><li>four<li>five</ul><p>six<p>{LONG}</article>")) == \
        f"one\ntwo\nthree\nfour\nfive\nsix\n{LONG.strip()}"


def test_a_page_without_marks_keeps_content_paths():
    body = "".join(f"<p>{LONG * 3}</p>" if i != 2 else "<p>Short one.</p>" for i in range(6))
    got = H.main_text(page(f'<div><div><h1>Head</h1>{body}</div><table><tr><td>Copyright 2024</td></tr></table><span>Print this page</span></div>'))
    assert got == "\n".join(["Head"] + [(LONG * 3).strip() if i != 2 else "Short one." for i in range(6)])


def test_content_nodes_are_those_of_the_ratios():
    """Text length and punctuation per tag path, fused, smoothed by a Gaussian over neighbours, cut at half a deviation."""
    p = H._Page(page("".join(f"<div><p>{LONG * (i % 3 + 1)}</p><ul><li>item {i}</li></ul></div>" for i in range(7)) + "<table><tr><td>x</td></tr></table>"))
    path = {el: "/".join(p.tag[x] for x in chain(p, el)) for el, _ in p.blocks}
    groups = {}
    for el, t in p.blocks:
        groups.setdefault(path[el], []).append(t)
    ratio = {k: sum(map(len, v)) / len(v) * (1 + sum(len(re.findall(r"[.,]", t)) for t in v) / len(v)) for k, v in groups.items()}
    raw = [ratio[path[el]] for el, _ in p.blocks]
    w = lambda d: math.exp(-d * d / 2) if abs(d) <= 2 else 0
    smooth = [sum(w(i - j) * r for j, r in enumerate(raw)) / sum(w(i - j) for j in range(len(raw))) for i in range(len(raw))]
    mean = sum(smooth) / len(smooth)
    cut = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)) / 2
    assert H.content_nodes(p) == [i for i, s in enumerate(smooth) if s >= cut]


def chain(p, el):
    out = []
    while el > 0:
        out.append(el)
        el = p.parent[el]
    return out[::-1]
