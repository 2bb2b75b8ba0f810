"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into flat blocks of text at block-level tags.  Each block is described by its
word count and link density, those of its neighbours and of its box (the blocks that stand directly in the same
container), and by hints of the markup: whether it is a heading, stands in an article or main element, or in a container that
is named like a menu, header, footer, sidebar, notice, advert, form or comment.  A decision tree trained on the
small labelled table ``LABELLED_PAGES`` says which blocks are the article.

A name is a hint about a container that does not hold the page: a form or a class word around most of the page's text (or
around its articles) says nothing, and inside an article only names of things that are never its text drop a
part unseen; other names, and longer ones that hold such a word beside a subject, leave the part to its words and links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# Element names of HTML by their part here.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
BOX_TAGS = frozenset("article aside body center details dialog div fieldset footer form header main nav section td".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands up to the end tag, or to the end of the page, is no text.
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
#: What stands up to the end tag is no text; without one the tag says nothing.
CLOSED_TAGS = frozenset("template svg math object datalist audio video canvas select".split())
FRINGE_TAGS = frozenset("nav aside footer menu dialog button legend search".split())
FRINGE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar form".split())
# Words in class and id names.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: With one of these a name tells the state of a page or post, not what the element is.
STATE_WORDS = frozenset("has have with without no not is open opened closed on off enabled disabled count layout".split())
#: Never the text of an article, also where they stand in one.
FRINGE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar rail widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs topbar cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing toolbar pagination pager popup modal overlay hidden".split())
#: Not the text of a page, but a part of an article may be named so.
WEAK_WORDS = frozenset("discussion related recommended side header masthead footer foot copyright legal disclaimer notice notices notification alert social tags".split())
#: Say where or how an element stands, not what it is about.
PLACE_WORDS = frozenset("area author bar block body bottom box button buttons card cell center column container content desktop email float form google group holder icon icons inline inner item items large left link links list main meta mobile module native outer page panel policy post reader readers right row section shell site slot small sticky text this thread tools top unit user users video wrap wrapper zone".split())
CORE_WORDS = frozenset("article articlebody post entry story content maincontent main body text".split())
HINT_WORDS = COMMENT_WORDS | FRINGE_WORDS | WEAK_WORDS

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What a container's tag and names say of it, from nothing to never seen.
NOTHING, WEAK, WRAP, COMMENT, STRONG = range(5)


@dataclass(eq=False)
class Area:
    """A container: its hint, and the words and blocks within (its own first, all of them after ``_resolve``)."""

    parent: Area | None
    hint: int = NOTHING
    #: 2: article, 1: main.
    core: int = 0
    soft: bool = False
    box: bool = False
    words: int = 0
    links: int = 0
    blocks: int = 0
    own_words: int = 0
    own_links: int = 0
    core_words: int = 0
    #: 0: none, 1: weak, 2: fringe; and the core level and softness it stands in.
    fringe: int = 0
    level: int = 0
    within_soft: bool = False


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    area: Area
    box: Area


@dataclass
class Page:
    blocks: list[Block]
    areas: list[Area]


def _hints(tag: str, attrs: str, inside_core: bool) -> tuple[int, int, bool]:
    """(hint, core, soft) of an element."""
    hint, core, soft = NOTHING, 0, False
    if tag in FRINGE_TAGS:
        hint = STRONG
    elif tag in ("form", "fieldset") or (tag == "header" and not inside_core):
        hint = WRAP
    elif tag == "article":
        core = 2
    elif tag == "main":
        core = 1
    if not attrs or attrs.isspace():
        return hint, core, soft
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            hint = STRONG
        elif name == "role":
            role = value.lower()
            hint = max(hint, WRAP if role == "form" else STRONG if role in FRINGE_ROLES else NOTHING)
            core = max(core, {"main": 1, "article": 2}.get(role, 0))
        elif name == "itemprop":
            core = 2 if value.lower() == "articlebody" else core
        elif name in ("class", "id") and tag not in ("html", "body"):
            for word in value.split():
                names = {x.lower() for x in _NAME.findall(word)}
                if names & STATE_WORDS:
                    continue
                # Inside an article "menu-of-the-day" is a subject, and its words and links say what it is; "menu-list" is a menu.
                if inside_core and names & HINT_WORDS and any(len(x) > 2 for x in names - HINT_WORDS - PLACE_WORDS):
                    hint = hint if core else max(hint, WEAK)
                elif names & COMMENT_WORDS:
                    hint = max(hint, COMMENT)
                elif core:
                    continue
                elif names & FRINGE_WORDS:
                    hint = max(hint, WRAP)
                elif names & WEAK_WORDS:
                    hint = max(hint, WEAK if inside_core else WRAP)
                elif names & CORE_WORDS:
                    soft = True
    return hint, core, soft


_SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "td", "th", "blockquote", "body", "html", "form", "aside", "nav", "header", "footer")
_CELL = ("td", "th")
_ACROSS_CELLS = frozenset("table tbody thead tfoot tr td th body html".split())


class _Parser:
    """One pass over the markup; every step is constant or paid for by what it removes."""

    def __init__(self, html: str):
        self.html = html
        root = Area(None, box=True)
        self.page = Page([], [root])
        self.stack: list[tuple[str, Area, Area]] = []
        self.open: dict[str, list[int]] = defaultdict(list)
        self.area = self.box = root
        self.cores = 0
        self.parts: list[tuple[str, bool]] = []
        self.heading, self.breaks = False, 0
        #: How many elements were open where the open anchor began; -1: none is open.
        self.anchor = -1
        self.unseen: list[str] = []
        self.unclosed: set[str] = set()

    def top(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=-1)

    def flush(self) -> None:
        if not self.parts:
            return
        words = unescape("".join(x for x, _ in self.parts)).split()
        if words:
            linked = min(len(words), sum(len(unescape(x).split()) for x, link in self.parts if link))
            self.page.blocks.append(Block(" ".join(words), len(words), linked, self.heading, self.area, self.box))
            self.area.words += len(words) - linked
            self.area.links += linked
            self.area.blocks += 1
            self.box.own_words += len(words) - linked
            self.box.own_links += linked
        self.parts.clear()

    def text(self, x: str) -> None:
        if not self.unseen:
            self.parts.append((x, self.anchor >= 0))
        if self.breaks and not x.isspace():
            self.breaks = 0

    def cut(self, depth: int) -> None:
        """Closes all elements from the given depth on."""
        while len(self.stack) > depth:
            tag, area, box = self.stack.pop()
            self.open[tag].pop()
            if self.area is not area:
                self.cores -= bool(self.area.core)
            self.area, self.box = area, box
        if self.anchor > len(self.stack):
            self.anchor = -1

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading, self.unseen = False, []
            at = self.open[tag][-1] if self.open[tag] else -1
            if at >= 0 and (tag in _ACROSS_CELLS or at > self.top(_CELL)):
                self.cut(at)
        elif tag == "a":
            self.anchor = -1
        elif self.unseen and self.unseen[-1] == tag:
            self.unseen.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag not in BLOCK_TAGS:
            if self.unseen:
                if self.unseen[-1] == tag and tag not in VOID_TAGS:
                    self.unseen.append(tag)
            elif tag == "a":
                self.anchor = len(self.stack)
            elif attrs and tag not in VOID_TAGS and not attrs.endswith("/") and ("hidden" in attrs or "none" in attrs) and _hints(tag, attrs, False)[0] == STRONG:
                self.unseen = [tag]
            return
        self.flush()
        self.unseen = []
        self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in _SELF_CLOSING:
            at = self.top(_SELF_CLOSING[tag])
            if at > self.top(_BARRIER) or (at >= 0 and at == self.top(_BARRIER)):
                self.cut(at)
        if tag in VOID_TAGS:
            return
        hint, core, soft = _hints(tag, attrs, self.cores > 0)
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, self.area, self.box))
        box = tag in BOX_TAGS
        if hint or core or soft or box:
            self.area = Area(self.area, hint, core, soft, box)
            self.page.areas.append(self.area)
            self.cores += bool(core)
            if box:
                self.box = self.area

    def run(self) -> Page:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag == "br":
                self.breaks += 1
                if self.breaks == 2:
                    self.flush()
                elif not self.unseen:
                    self.parts.append((" ", False))
                continue
            self.breaks = 0
            if m[1]:
                self.end(tag)
            elif tag in RAW_TAGS or tag in CLOSED_TAGS:
                if not m[3].rstrip().endswith("/"):
                    close = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    if close:
                        at = close.end()
                    elif tag in RAW_TAGS:
                        at = n
                    else:
                        self.unclosed.add(tag)
            else:
                self.start(tag, m[3])
        self.flush()
        return self.page


def _resolve(page: Page) -> None:
    """Sums words of areas, and settles which hints hold and where the core is."""
    areas = page.areas
    dead = {}
    for a in areas:
        dead[a] = (a.parent is not None and dead[a.parent]) or a.hint in (COMMENT, STRONG)
    live = sum(a.words for a in areas if not dead[a])
    held = {a: (0 if dead[a] else a.words) for a in areas}
    for a in reversed(areas):
        if a.parent is not None:
            a.parent.words += a.words
            a.parent.links += a.links
            a.parent.blocks += a.blocks
            held[a.parent] += held[a]
            a.parent.core_words += max(a.core_words, 0 if dead[a] or not a.core else held[a])
    cores = areas[0].core_words
    for a in areas:
        up = a.parent
        a.fringe = up.fringe if up else 0
        a.level = max(up.level if up else 0, a.core)
        a.within_soft = a.soft or bool(up and up.within_soft)
        if a.hint in (COMMENT, STRONG):
            a.fringe = 2
        elif a.hint == WRAP:
            wraps = 2 * a.core_words >= cores if cores else 2 * held[a] > live and a.blocks >= 3
            a.fringe = max(a.fringe, 0 if wraps else 2)
        elif a.hint == WEAK:
            a.fringe = max(a.fringe, 1)


FEATURES = (
    "words", "link density", "words before", "link density before", "words after", "link density after", "words of the box", "link density of the box",
    "share of the page in the box", "box of its own", "heading", "fringe", "core", "page has a core", "core follows",
)


def features(page: Page) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    _resolve(page)
    found = page.blocks
    n = len(found)
    x = np.zeros((n + 2, len(FEATURES)))
    level = np.array([0 if b.area.fringe == 2 else b.area.level for b in found], int)
    words = np.array([b.words for b in found], float)
    in_articles, in_core = words[level == 2].sum(), words[level > 0].sum()
    # An article that is only a part of main, a teaser say, is not the page's core.
    least = 2 if in_articles and (3 * in_articles >= in_core) else 1
    live = max(1, sum(b.words - b.link_words for b in found if b.area.fringe < 2))
    for i, b in enumerate(found, 1):
        fringe, box = b.area.fringe, b.box
        core = 0 if fringe == 2 else 2 if level[i - 1] >= least else 1 if b.area.within_soft and not in_core else 0
        of_box = box.own_words + box.own_links
        own = box.parent is not None and box.parent.parent is not None
        x[i] = b.words, b.link_words / b.words, 0, 0, 0, 0, box.own_words, box.own_links / max(1, of_box), min(1.0, box.own_words / live), own, b.heading, fringe, core, 0, 0
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, 0:2], x[2:, 0:2]
    x[1:-1, 13] = x[1:-1, 12].max(initial=0)
    x[1:-1, 14] = x[2:, 12] == 2
    return x[1:-1]


def blocks(html: str) -> Page:
    """The flat text blocks of a page, in order, and the containers they stand in."""
    return _Parser(html).run()


@dataclass
class Tree:
    """A binary decision tree by Gini impurity; equal splits go to the first feature."""

    max_depth: int = 12
    least: int = 6

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.root = self._grow(x, y, self.max_depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        total, n = y.sum(), len(y)
        if not depth or total in (0, n):
            return bool(2 * total >= n)
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, left = x[order, j], np.cumsum(y[order])[:-1]
            size = np.arange(1, n)
            score = left * (size - left) / size + (total - left) * (n - size - total + left) / (n - size)
            score[(v[1:] == v[:-1]) | (size < self.least) | (n - size < self.least)] = np.inf
            k = int(score.argmin())
            if np.isfinite(score[k]) and (best is None or score[k] < best[0] - 1e-9):
                best = (score[k], j, (v[k] + v[k + 1]) / 2)
        if best is None or best[0] >= total * (n - total) / n - 1e-9:
            return bool(2 * total >= n)
        left = x[:, best[1]] <= best[2]
        below, above = self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)
        return below if isinstance(below, bool) and below is above else (best[1], best[2], below, above)

    def predict(self, row: np.ndarray) -> bool:
        node = self.root
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


def _filler(n: int) -> str:
    return " ".join(["word"] * n)


def _labelled(seed: int) -> list[str]:
    """The table's pages, with lengths drawn anew: w(n) is about n words, x() any number of words."""
    rng = np.random.default_rng(seed)

    def w(n: int) -> str:
        return _filler(n if n < 4 else max(1, round(n * rng.uniform(0.8, 1.25))))

    def x() -> str:
        return _filler(int(2 ** rng.uniform(0, 7.5)))

    def before() -> str:
        return rng.choice(["", "", f"<nav>-{w(2)}</nav>", f"<div class=ad>-{x()}</div>", f"<header><p>-{w(4)}</p></header>", f"<div><a>-{w(2)}</a> <a>{w(3)}</a></div>", f"<div class=cookie-notice>-{x()}</div>"])

    def after() -> str:
        return rng.choice(["", "", f"<footer>-{x()}</footer>", f"<div class=footer><p>-{w(7)}</p></div>", f"<div class=ad>-{x()}</div>", f"<aside><p>-{x()}</p></aside>", f"<section class=comments><p>-{x()}</p><p>-{x()}</p></section>"])

    menu = f"<ul><li><a>-{w(1)}</a><li><a>-{w(2)}</a><li><a>-{w(1)}</a></ul>"
    return [
        # An article element with everything around it; short and long paragraphs.
        f"<body><nav><ul><li><a>-{w(1)}</a><li><a>-{w(2)}</a></ul></nav><div class=ad>-{x()}</div><article><h1>+{x()}</h1><p>+{x()}</p><p>+{w(1)}</p><p>+{x()}</p><p>+{x()}</p><p>+{w(2)}<a>{w(1)}</a></p><p>+{w(1)}</p></article><aside><p>-{x()}</p></aside><footer>-{x()}</footer>",
        f"<body>{before()}<article><h1>+{x()}</h1><p>+{x()}</p></article>{after()}",
        f"<body>{before()}<article><p>+{x()}</p><p>+{x()}</p><p>+{x()}</p></article>{after()}",
        f"<body>{before()}<div class=content><p>+{x()}</p><p>+{x()}</p><p>+{x()}</p></div>{after()}",
        f"<body>{before()}<main><p>+{x()}</p><p>+{x()}</p></main>{after()}",
        f"<body>{before()}<article><section><h2>+{w(3)}</h2><p>+{x()}</p><p>+{x()}</p></section><section class=legal><p>+{x()}</p><p>+{w(25)}</p></section></article>{after()}",
        f"<body>{before()}<article><div><h1>+{x()}</h1></div><div><p>+{x()}</p></div><div><p>+{x()}</p><div><p>+{x()}</p></div></div></article>{after()}",
        f"<body>{before()}<main><div><h1>+{x()}</h1><p>+{x()}</p></div><blockquote><p>+{x()}</p></blockquote><div><p>+{x()}</p></div></main>{after()}",
        f"<body>{before()}<div class=entry><div><h1>+{x()}</h1></div><div><p>+{x()}</p></div><div><p>+{x()}</p><div><p>+{x()}</p></div></div></div>{after()}",
        f"<body>{before()}<div><div><h1>+{w(5)}</h1></div><div><p>+{w(45)}</p></div><div><p>+{w(60)}</p><div><p>+{w(30)}</p></div></div></div>{after()}",
        f"<body>{before()}<div><p>+{x()}</p><p>+{x()}</p><p>+{x()}</p></div>{after()}",
        f"<body>{before()}<div><h1>+{w(3)}</h1><p>+{w(2)}</p><p>+{w(3)}</p><p>+{w(40)}</p></div>{after()}",
        f"<body>{before()}<div><h1>+{w(3)}</h1><ul><li>+{x()}<li>+{w(3)}</ul><blockquote><p>+{x()}</p></blockquote><p>+{w(40)}</p><p>+{w(6)}</p></div>{after()}",
        f"<body><form>{before()}<div><h1>+{w(3)}</h1><p>+{w(30)}</p><p>+{w(3)}</p><p>+{w(40)}</p></div></form>",
        f'<body><div class="layout with-sidebar">{before()}<div><h1>+{w(5)}</h1><p>+{w(30)}</p><p>+{x()}</p></div>{after()}</div>',
        f"<body>{menu}<article><h1>+{x()}</h1></article><footer>-{x()}</footer>",
        f"<body><header><a>-{w(2)}</a><p>-{x()}</p></header><div>-{x()}</div><div class=notice>-{x()}</div><h1>+{w(5)}</h1><article><p>+{x()}</p><p>+{x()}</p><ul><li>+{x()}<li>+{w(3)}</ul><div class=share><a>-{w(1)}</a></div></article><section id=comments><h2>-{w(2)}</h2><p>-{x()}</p><p>-{x()}</p></section><p>-{x()}</p><form>-{x()}</form>",
        f"<body><main><div class=breadcrumb><a>-{w(1)}</a> - <a>{w(1)}</a></div><article><header><h1>+{x()}</h1><p>+{w(5)}</p></header><p>+{w(35)}</p><h2>+{w(2)}</h2><p>+{x()}</p></article><div><p>-{w(20)}</p><ul><li><a>-{w(6)}</a><li><a>-{w(7)}</a></ul></div></main><footer><p>-{x()}</p></footer>",
        f"<body>{before()}<article><p>+{x()}</p><p><a>+{w(4)}</a></p><p>+{x()}</p><ul><li><a>+{w(5)}</a><li><a>+{w(3)}</a></ul></article>{after()}",
        f"<body>{before()}<main><p>+{w(30)}</p><p><a>+{x()}</a></p><ul><li><a>+{w(2)}</a><li><a>+{w(6)}</a></ul></main>{after()}",
        # Parts of an article with names that may be its text: words and links say.
        f"<body><article><h1>+{x()}</h1><p>+{w(50)}</p><section id=discussion><h2>+{w(1)}</h2><p>+{x()}</p><p>+{w(30)}</p></section><section class=related-work><h2>+{w(2)}</h2><p>+{x()}</p></section><div class=related><a>-{w(6)}</a> <a>{w(5)}</a></div><div class=tags><a>-{w(1)}</a> <a>{w(1)}</a></div></article>{menu}",
        f"<body><article><p>+{w(30)}</p><section class=legal><h3>+{w(2)}</h3><p>+{x()}</p><p>+{w(33)}</p></section><section class=social-effects><p>+{w(28)}</p><p>+{x()}</p></section><div class=social><a>-{w(1)}</a> <a>{w(1)}</a> <a>{w(1)}</a></div><div class=footer><a>-{w(3)}</a></div></article><footer>-{x()}</footer>",
        # Wrapped by a form, by layout names, by names of what stands beside.
        f"<body><form id=aspnetForm><div class=header><p>-{w(4)}</p></div><div><h1>+{w(5)}</h1><p>+{w(44)}</p><p>+{x()}</p><p>+{w(27)}</p></div><div class=footer>-{w(7)}</div></form>",
        f'<body><div class="layout has-sidebar"><div class=menu>{menu}</div><article><h1>+{x()}</h1><p>+{x()}</p><p>+{x()}</p></article><div class=sidebar><p>-{x()}</p></div></div>',
        f'<body><div id=content class="content sidebar-right"><h1>+{w(4)}</h1><p>+{w(52)}</p><p>+{x()}</p><p>+{w(21)}</p><div class=sidebar><p>-{w(9)}</p></div></div><div class=legal>-{w(12)}</div>',
        # main without article, and with a teaser.
        f"<body><div><a>-{w(2)}</a></div><main><h1>+{x()}</h1><p>+{x()}</p><p>+{w(1)}</p><p>+{x()}</p></main><div>-{x()}</div>",
        f"<body><main><h1>+{x()}</h1><p>+{w(60)}</p><p>+{w(35)}</p><p>+{w(2)}</p><article><p>+{w(7)}</p></article></main><div>-{x()}</div>",
        # A container named so.
        f"<body><div id=header><p>-{x()}</p></div><div class=menu><a>-{w(1)}</a></div><div id=content><h1>+{x()}</h1><p>+{w(50)}</p><p>+{x()}</p><div class=sidebar><p>-{w(33)}</p></div><p>+{w(11)}</p></div><div class=footer>-{x()}</div><p>-{w(6)}</p>",
        # A box without a name that holds the text: its short blocks too; boxes beside it.
        f"<body>{menu}<div class=ad>-{x()}</div><div><h1>+{x()}</h1><p>+{x()}</p><p>+{x()}</p><p>+{w(1)}</p><p>+{x()}</p></div><footer>-{x()}</footer>",
        f"<body><nav>{menu}</nav><div class=ad>-{x()}</div><div><h1>+{x()}</h1><p>+{x()}</p><p>+{w(1)}</p></div><footer>-{x()}</footer>",
        f"<body><nav>{menu}</nav><div class=ad>-{x()}</div><div><h1>+{w(2)}</h1><p>+{w(1)}</p></div><footer>-{x()}</footer>",
        f"<body><div><div>-{w(3)}</div><div><a>-{w(2)}</a> <a>{w(2)}</a></div></div><div><h2>+{w(5)}</h2><p>+{w(80)}</p><p>+{w(3)}</p><p>+{w(40)}</p></div><div><h3>-{w(2)}</h3><ul><li><a>-{w(6)}</a><li><a>-{w(5)}</a></ul></div><div>-{w(9)}</div>",
        f"<body><div><div><div><h1>+{w(5)}</h1></div><div><p>+{w(64)}</p><p>+{w(38)}</p></div><div><p>+{w(48)}</p><p>+{w(5)}</p></div></div></div><div><p><a>-{w(4)}</a></p><p><a>-{w(6)}</a></p></div>",
        f"<body><table><tr><td>{menu}</td><td><h1>+{w(6)}</h1><p>+{w(45)}</p><p>+{w(2)}</p><p>+{w(29)}</p></td><td><p><a>-{w(3)}</a></p><p>-{w(6)}</p></td></tr></table><div>-{w(7)}</div>",
        f"<body><div><h1>+{w(4)}</h1><p>+{w(3)}</p><p>+{w(6)}</p><p>+{w(4)}</p><p>+{w(5)}</p></div><div><a>-{w(1)}</a> <a>{w(1)}</a></div>",
        # No container at all: word counts and link densities of the neighbourhood.
        f"<body><table><tr><td><a>-{w(1)}</a></td><td><a>-{w(2)}</a></td><td><a>-{w(1)}</a></td></tr></table><h1>+{w(5)}</h1><p>+{w(40)}</p><p>+{w(25)}</p><p>+{w(6)}</p><p>+{w(55)}</p><p>+{w(12)}<a>{w(2)}</a></p><p>+{w(28)}</p><p><a>-{w(3)}</a></p><p><a>-{w(2)}</a></p><p>-{w(4)}</p>",
        f"<body><p><a>-{w(2)}</a></p><p><a>-{w(1)}</a></p><p>-{w(3)}</p><h2>+{w(4)}</h2><p>+{w(30)}</p><p>+{w(4)}</p><p>+{w(20)}</p><p>+{w(16)}</p><p><a>-{w(9)}</a></p><p><a>-{w(12)}</a></p><p>-{w(5)}</p>",
        f"<body><div><a>-{w(3)}</a> <a>{w(4)}</a></div><p>+{w(70)}</p><p>+{w(15)}</p><p>+{w(33)}</p><div>-{w(2)} <a>{w(2)}</a></div><div><a>-{w(15)}</a></div>",
        f"<body><header><p>-{w(12)}</p></header><nav><p>-{w(2)}</p></nav><h1>+{w(7)}</h1><p>+{w(40)}</p><p>+{w(9)}</p><aside><p>-{w(30)}</p></aside><p>+{w(20)}</p><div class=cookie>-{w(18)}</div><p>+{w(13)}</p><form>-{w(5)}</form><footer>-{w(15)}</footer>",
        f"<body><h1>+{w(6)}</h1><p>+{w(19)}</p><p>+{w(26)}</p><p>+{w(8)}</p><p>+{w(31)}</p>",
        f"<body><p>+{w(12)}</p><p>+{w(5)}</p>",
        f"<body><p>+{x()}</p>",
        f"<body>{before()}<p>+{w(6)}</p>",
        f"<p>+{w(1)}",
        f"<body>+{w(2)}",
        # Text around an article that no name gives away, of any length.
        f"<body><div>-{x()}</div><div>-{x()}</div><p>-{x()}</p><h3>-{w(3)}</h3><p>-{x()}</p><article><h1>+{x()}</h1><p>+{x()}</p></article><p>-{x()}</p><h3>-{w(4)}</h3><p>-{x()}</p><p>-{w(3)}</p>",
        f"<body><div>-{x()}</div><article><p>+{x()}</p><p>+{w(4)} <a>{w(30)}</a></p><p>+{x()}</p></article><div>-{x()}</div><div>-{x()}</div>",
        # Readers' comments behind an article, in boxes that no name gives away; their last block has nothing behind it.
        f"<body>{menu}<article><h1>+{x()}</h1><p>+{x()}</p><p>+{x()}</p></article><div><p>-{w(30)}</p><p>-{w(30)}</p></div>",
        f"<body><article><h1>+{w(5)}</h1><p>+{x()}</p><p>+{w(45)}</p></article><div><div><p>-{x()}</p></div><div><p>-{x()}</p><p>-{x()}</p></div><div><p>-{x()}</p></div></div>{after()}",
        f"<body>{before()}<main><article><h1>+{x()}</h1><p>+{x()}</p><p>+{x()}</p></article><div><p>-{x()}</p><p>-{x()}</p></div></main>",
        # Adverts and asides between the blocks of a box without a name.
        f"<body>{before()}<div><h1>+{w(4)}</h1><aside>-{x()}</aside><p>+{w(40)}</p><div class=ad>-{x()}</div><p>+{x()}</p><p>+{w(50)}</p><form>-{x()}</form></div>{after()}",
        f"<body>{before()}<div class=content><h1>+{x()}</h1><div class=ad>-{x()}</div><p>+{x()}</p><aside>-{x()}</aside><p>+{x()}</p></div>{after()}",
        # Parts of an article that name their subject.
        f"<body>{menu}<article><h1>+{w(5)}</h1><p>+{x()}</p><section class=menu-of-may><h2>+{w(2)}</h2><p>+{x()}</p><p>+{w(48)}</p></section><section class=banner-history><p>+{x()}</p></section><section class=replies-from-experts><h2>+{w(3)}</h2><p>+{w(40)}</p><p>+{x()}</p></section></article>{after()}",
    ]


#: The labelled table: pages whose blocks start with + (article) or - (not).
LABELLED_PAGES = [page for seed in range(12) for page in _labelled(seed)]


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    rows, labels = [], []
    for html in LABELLED_PAGES:
        page = blocks(html)
        rows.append(features(page))
        labels += [b.text[0] == "+" for b in page.blocks]
    return Tree().fit(np.concatenate(rows), np.array(labels, float))


def main_text(html: str | None, tree: Tree | None = None) -> str:
    """The article of a page: its blocks, one a line; empty for a null page or one without."""
    if not html:
        return ""
    page = blocks(html)
    if not page.blocks:
        return ""
    tree = tree or trained_tree()
    return "\n".join(b.text for b, row in zip(page.blocks, features(page), strict=True) if tree.predict(row))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    The whole html is read.  A null or empty page, or one without an article, has an empty text
    and 0 characters; broken markup is read as far as it goes.  Repeated rows give
    repeated results; other columns are neither read nor returned."""

    tree = trained_tree()  # on the driver, once

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
