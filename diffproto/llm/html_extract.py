"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with the path of tags from the root
to its element.  Text length and punctuation are aggregated per path; a
block's feature is its path's mean text length times its path's mean number
of punctuation marks (fused), smoothed over neighbouring blocks by a
Gaussian.  Blocks over a share of the standard deviation are content nodes.
They locate the article: if the deepest element that holds nearly all of
their text lies in an <article> or <main>, that one, and its blocks are
returned.  On other pages nothing marks where the article ends, and only
menus are left out: blocks of link text alone, outside the lowest element
that holds all content nodes.

Elements that are no article by their kind (navigation, forms, scripts ...)
or by the words of their class, id and role (sidebar, cookie, comments ...)
take no part.  A form, or an element with such a word in its class or id, that
holds the page's only <article> or <main> or most of the content nodes' text
is a wrapper and stays.

One page is one row, and a task holds one Arrow batch: no shuffle.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import read

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q "
    "rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
#: Elements that end a line of text.  Anything else, known or not, stands within a block.
BLOCKS = frozenset(
    "html head body address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol p plaintext pre search section summary table "
    "caption colgroup thead tbody tfoot tr td th title ul xmp".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("html head body frameset legend caption colgroup thead tbody tfoot tr td th title".split())
#: A start tag of these closes an open element of the listed kinds, up to the nearest of the barriers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_BARRIER = frozenset("applet table td th caption button marquee object template html foreignobject desc".split())

#: Elements that are never part of an article.
DROP_TAGS = frozenset(
    "head script style title nav footer aside form button select option textarea input label iframe object embed "
    "noscript template svg math canvas audio video dialog menu noembed noframes".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of a class or id that mark menus, sidebars, notices, adverts, forms and comments.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination paywall popup promo promotion recommended related replies reply respond "
    "share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Class words that an article's own parts may carry.
_INSIDE_ARTICLE = frozenset({"header"})
#: Words that say nothing beside one of DROP_WORDS: ``comments-area`` names comments, ``has-sidebar`` does not name a sidebar.
_NEUTRAL = frozenset("area bar block box container inner list outer section wrap wrapper".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING = re.compile(r"h[1-6]")
_WORD = re.compile(r"[^\W_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡\"'()«»“”-]")

SIGMA = 1.0  # of the Gaussian over neighbouring blocks
RADIUS = 2
CUT = 0.5  # times the standard deviation
HOLDS = 0.9  # share of the content nodes' text that the article's element holds
MOST = 0.5  # share of it in an element that a class word or a form does not drop


_STAYS, _FORM, _WORDED, _NAMED, _GONE = range(5)


def _dropped(tag: str, attrs: str, in_article: bool) -> int:
    """Does an element go, and by what: ``_GONE`` for good; else unless it
    turns out to hold the article: as a form, by a word in a class or id, or
    by a whole class or id that names such a part."""
    if tag == "form":
        level = _FORM
    elif tag in DROP_TAGS or (tag == "header" and not in_article):
        return _GONE
    else:
        level = _STAYS
    if not attrs or attrs.isspace():
        return level
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return _GONE
        if name == "style" and _HIDDEN.search(value):
            return _GONE
        if name == "role" and value.lower() in DROP_ROLES:
            return _GONE
        if name == "id" and in_article and (tag == "p" or _HEADING.fullmatch(tag)):
            continue  # a place to link to
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            part = DROP_WORDS - _INSIDE_ARTICLE if in_article else DROP_WORDS
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                if words & part:
                    level = max(level, _WORDED if words - part - _NEUTRAL else _NAMED)
    return _GONE if level and tag in INLINE else level


class _Page:
    """Elements and text blocks of one page.  Element i has ``parent[i]``,
    ``tag[i]``, ``path[i]`` (an interned number, so that deep nesting costs
    nothing), ``gone[i]`` (in no article), ``art[i]`` (in <article> or <main>)
    and ``level[i]`` (what may drop it)."""

    def __init__(self, text: str):
        self.parent, self.tag, self.path, self.gone, self.art = [-1], [""], [0], [False], [False]
        self.level = [_STAYS]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[bool] = []  # of each block: are its letters and digits all in <a>?
        self._plain = False
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [0]
        self._count: dict[str, int] = {}
        self._buffer: list[str] = []
        self._parse(text)
        if any(self.level):
            self._drop()

    def _drop(self) -> None:
        """Takes out the blocks of elements that go by a word or as a form.
        One that holds the page's only <article> or <main>, or most of the
        content nodes' text, stays, and those in it are looked at in turn."""
        texts = _held(self, list(range(len(self.blocks))))
        held = _held(self, content_nodes(self))
        prose = _held(self, [i for i in content_nodes(self, own=True) if not self.links[i]])
        for el in range(1, len(self.tag)):
            # beside other words, a word says nothing of a part of the article that its path ratios keep
            if self.level[el] == _WORDED and self.art[el] and 2 * prose.get(el, 0) >= texts.get(el, 0) > 0:
                self.level[el] = _STAYS
        over = [0] * len(self.tag)  # the nearest such element, itself included
        above: dict[int, int] = {}
        within: dict[int, list[int]] = {}
        for el in range(1, len(self.tag)):
            over[el] = over[self.parent[el]]
            if self.level[el]:
                above[el] = over[el]
                within.setdefault(over[el], []).append(el)
                over[el] = el
        articles = {over[el] for el in range(1, len(self.tag)) if self.tag[el] in ("article", "main") and texts.get(el)}
        holds = set()
        for el in articles:
            while el and el not in holds:
                holds.add(el)
                el = above[el]
        free = 0 in articles
        stay = {0}
        rank = lambda el: (el not in holds, -held.get(el, 0), el)
        heap = [rank(el) for el in within.get(0, [])]
        heapq.heapify(heap)
        while heap:
            _, mass, el = heapq.heappop(heap)
            share = -mass / max(1, held.get(0, 0))
            if free and self.level[el] == _NAMED:
                continue
            if not (el in holds and not free or share > (HOLDS if free or self.level[el] == _NAMED else MOST)):
                continue
            stay.add(el)
            free = free or el in articles
            for x in within.get(el, []):
                heapq.heappush(heap, rank(x))
        kept = [i for i, (el, _) in enumerate(self.blocks) if over[el] in stay]
        self.blocks, self.links = [self.blocks[i] for i in kept], [self.links[i] for i in kept]

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer = []
            if text:
                top = next((i for i in reversed(self._stack) if self.tag[i] in BLOCKS), 0)
                self.blocks.append((top, text))
                self.links.append(not self._plain)
        self._plain = False

    def _in_link(self) -> bool:
        """Is the text at this place in an <a> of its own block?"""
        if self._count.get("a"):
            for i in reversed(self._stack):
                if self.tag[i] in BLOCKS:
                    return False
                if self.tag[i] == "a":
                    return True
        return False

    def _open(self, tag: str, attrs: str) -> None:
        up = self._stack[-1]
        art = self.art[up] or tag in ("article", "main")
        level = _GONE if self.gone[up] else _dropped(tag, attrs, art)
        gone = level == _GONE
        if gone and not self.gone[up] and tag in BLOCKS:
            self._flush()
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self._paths.setdefault((self.path[up], tag), len(self._paths) + 1))
        self.gone.append(gone)
        self.level.append(_STAYS if gone else level)
        self.art.append(art)
        self._stack.append(len(self.tag) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _pop(self) -> str:
        t = self.tag[self._stack.pop()]
        self._count[t] -= 1
        return t

    def _close_open(self, kinds, barrier) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            el = self._stack[k]
            t = self.tag[el]
            if t in kinds:
                while len(self._stack) > k:
                    self._pop()
                return
            # what is inside an element that goes does not end what is around it
            if t in barrier or self.gone[el] and not self.gone[self.parent[el]]:
                return

    def _parse(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            m = _TAG.search(text, at)
            end = m.start() if m else n
            if end > at and not self.gone[self._stack[-1]]:
                piece = text[at:end]
                self._buffer.append(entities.unescape(piece) if "&" in piece else piece)
                self._plain = self._plain or bool(_WORD.search(self._buffer[-1])) and not self._in_link()
            if not m:
                break
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if tag in BLOCKS and not self.gone[self._stack[-1]]:
                    self._flush()
                if self._count.get(tag):
                    while self._pop() != tag:
                        pass
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag == "br":
                self._buffer.append(" ")
                continue
            if tag in BLOCKS and not self.gone[self._stack[-1]]:
                self._flush()
            if tag in CLOSES:
                self._close_open(*CLOSES[tag])
            if tag in ENDS_P and self._count.get("p"):
                self._close_open({"p"}, P_BARRIER)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = close.end() if close else n
                continue
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
                continue
            self._open(tag, attrs)
        self._flush()


def content_nodes(page: _Page, own: bool = False) -> list[int]:
    """The numbers of the blocks over the cut; ``own``: of those whose path is
    over it without its neighbours' help, too."""
    blocks = page.blocks
    if not blocks:
        return []
    total: dict[int, list[int]] = {}
    for el, text in blocks:
        t = total.setdefault(page.path[el], [0, 0, 0])
        t[0] += 1
        t[1] += len(text)
        t[2] += len(_PUNCT.findall(text))
    fused = {p: (chars / n) * (1 + marks / n) for p, (n, chars, marks) in total.items()}
    raw = [fused[page.path[el]] for el, _ in blocks]
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    smooth = []
    for i in range(len(raw)):
        lo, hi = max(0, i - RADIUS), min(len(raw), i + RADIUS + 1)
        ks = kernel[lo - i + RADIUS: hi - i + RADIUS]
        smooth.append(sum(a * b for a, b in zip(ks, raw[lo:hi], strict=True)) / sum(ks))
    mean = sum(smooth) / len(smooth)
    cut = CUT * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    return [i for i, s in enumerate(smooth) if s >= cut and not (own and raw[i] < cut)]


def content(page: _Page) -> list[str]:
    """The texts of the article's blocks, in page order."""
    blocks, nodes = page.blocks, content_nodes(page)
    root = _deepest(page, nodes, HOLDS)
    up = root
    while up > 0 and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    marked = up > 0
    # the Gaussian lifts a menu or a line beside the article over the cut
    own = [] if marked else [i for i in content_nodes(page, own=True) if not page.links[i]]
    root = up if marked else _deepest(page, own, 1)
    inside = [False] * len(page.tag)
    for el in range(len(page.tag)):
        inside[el] = el == root or (el > 0 and inside[page.parent[el]])
    paths = {page.path[blocks[i][0]] for i in own}
    heads = [el for el, _ in blocks if _HEADING.fullmatch(page.tag[el])]
    if marked:
        heads = [el for el in heads if page.tag[el] == "h1"]
        heads = heads if len(heads) == 1 else []
    keep = set(heads)
    # outside the root, on a page that marks no article, blocks stay whose path is a content path
    return [text for (el, text), link in zip(blocks, page.links, strict=True)
            if inside[el] or el in keep or not (marked or link) and page.path[el] in paths]


def _held(page: _Page, nodes: list[int]) -> dict[int, int]:
    """Element -> length of the text of these blocks in it."""
    held: dict[int, int] = {}
    for i in nodes:
        el, text = page.blocks[i]
        held[el] = held.get(el, 0) + len(text)
    # children come after their parents, so one backward pass sums up the tree
    for el in range(len(page.tag) - 1, 0, -1):
        if el in held:
            held[page.parent[el]] = held.get(page.parent[el], 0) + held[el]
    return held


def _deepest(page: _Page, nodes: list[int], share: float) -> int:
    """The deepest element that holds this share of the text of these blocks."""
    held = _held(page, nodes)
    if not held:
        return 0
    root, least = 0, share * held.get(0, 0)
    for el in range(len(page.tag)):  # the deepest comes last along a chain of parents
        if held.get(el, 0) >= least and (el == 0 or page.parent[el] == root or _under(page, el, root)):
            root = el
    return root


def _under(page: _Page, el: int, root: int) -> bool:
    while el > root:
        el = page.parent[el]
    return el == root


def main_text(html: str | None) -> str:
    """The article's text: blocks joined by one newline, white space inside a
    block turned into one space, character references decoded.  Null, empty
    and text-less pages give an empty string."""
    return "\n".join(content(_Page(html))) if html else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text", n_out: str = "n_chars") -> DataFrame:
    """``pages`` with ``out``, the page's main text, and ``n_out``, its length
    in code points; the html column goes.

    Every row gives one row, whatever it repeats; null or empty html gives an
    empty text.  Columns of ``pages`` named ``out`` or ``n_out`` are replaced."""
    ship_package(pages.sparkSession)
    rest = pages.drop(*[c for c in (out, n_out) if c != html])

    @F.pandas_udf("string")
    def run(col):
        return col.map(main_text)

    done = rest.withColumn(out, run(F.col(html)))
    done = done if out == html else done.drop(html)
    return done.withColumn(n_out, F.length(out).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
