"""Main text of web pages from flat text blocks.

A page is scanned once into flat blocks: text between block-level tags, with what encloses it. A block's features are
its own and its neighbours' word count and link density, and what its enclosing elements say: article body, and
boilerplate by tag, role or name. Names are whole: ``cookie-notice`` is one, ``with-sidebar`` and ``comments-open`` tell
of a layout or a state. Names that articles use too (``search``, ``notice``) are a feature of their own, which many words
outvote. An element that holds most of the page's words beside links, with its headline or article, isn't boilerplate
whatever its name; nor is one inside an article's body that only an id names so and whose heading says something else (a
chapter). Inline elements aren't cut out of a line by their names, but for readers' comments: a block is boilerplate by
them if all its words are in such. What isn't rendered goes (``hidden``, ``display: none``). A small decision tree, grown from ``LABELLED`` when the module is loaded, keeps or drops each block.
Scripts, styles, markup and other unrendered content are never blocks.

Defined cases: null and empty html give an empty text; unclosed elements reach to the end of their parent or of the
page, and close tags without an open one are ignored; a ``<`` that opens no tag is text; an unended comment swallows the
rest, an unended quote in a tag ends with the tag; references without a semicolon are decoded as HTML5 does; a very
long or deeply nested page takes time and memory in proportion to its length, in one task; repeated rows repeat; null ids and urls pass through; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cirrostrat.llm.common import bounded

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^>]*)(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"h[1-6]")
_ID = re.compile(r"""(?<![^\s"'/])id\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# How element names behave.
_UNSEEN = frozenset("script style noscript template head title textarea select option iframe object svg math canvas audio video datalist button".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rt rp input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ALWAYS = frozenset("nav footer menu".split())
_BOILER = frozenset("aside form dialog".split())
_MAIN = frozenset("article main".split())
_ENDS_P = frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure address fieldset".split())
_REPEATS = frozenset("li option tr td th dt dd".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
# Parts of class and id names: boilerplate, boilerplate that articles name too, and what may stand beside.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter subscribe subscription signup nav navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar share sharing sharebar social comment comments commentlist disqus respond reply replies pagination pager promo promotion related recommended"
    " recommendations werbung anzeige anzeigen kommentar kommentare seitenleiste publicite commentaires publicidad comentarios".split()
)
_WEAK = frozenset("banner notice alert overlay login side header feedback tags copyright legal skip search".split())
_NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global box bar list item items link links wrap wrapper container area block section inner outer panel content text row col column form post posts article"
    " user reader thread body title count footer button buttons icons icon media slot unit group holder region module layer message policy law stories news teaser teasers".split()
)
# Names of what readers add, also within a line.
_READERS = frozenset("comment comments disqus reply replies kommentar kommentare commentaires comentarios".split())
# Words that headings of boilerplate have beside such names.
_LABELS = frozenset("a add all an and at from join leave let more no now of on our post read see show the this to us view we what write you your".split())
_BODIES = frozenset("article post entry story content main".split())
_OF_BODY = frozenset("article post entry story content main body text inner page".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "weak", "body", "page_has_body")
# Blocks of pages in order, labelled: words, linked words, boiler, weak, body, and 1 for article text.
LABELLED = [
    # a news page: menu, advert, article with headline, paragraphs and a linked one, footer
    [(1, 1, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (9, 0, 1, 0, 0, 0), (8, 0, 0, 0, 1, 1), (45, 0, 0, 0, 1, 1), (62, 6, 0, 0, 1, 1), (4, 4, 0, 0, 1, 1), (30, 0, 0, 0, 1, 1), (7, 2, 1, 0, 0, 0)],
    # an article of one short line, and of single words, between menu and footer
    [(1, 1, 1, 0, 0, 0), (3, 0, 0, 0, 1, 1), (1, 0, 0, 0, 1, 1), (6, 0, 1, 0, 0, 0)],
    [(2, 2, 1, 0, 0, 0), (1, 0, 0, 0, 1, 1), (1, 0, 0, 0, 1, 1), (12, 8, 0, 0, 1, 1), (2, 0, 1, 0, 0, 0)],
    # teasers, a box and long comments around an article body
    [(12, 0, 0, 0, 0, 0), (30, 4, 0, 0, 0, 0), (10, 0, 0, 0, 1, 1), (80, 2, 0, 0, 1, 1), (55, 0, 0, 0, 1, 1), (40, 0, 1, 0, 1, 0), (70, 0, 1, 0, 1, 0), (35, 0, 1, 0, 0, 0), (3, 3, 0, 0, 0, 0), (25, 2, 0, 0, 0, 0)],
    [(30, 0, 0, 0, 0, 0), (50, 1, 0, 0, 0, 0), (10, 0, 0, 0, 1, 1), (40, 1, 0, 0, 1, 1), (2, 2, 0, 0, 1, 1), (40, 0, 0, 0, 1, 1), (1, 0, 0, 0, 0, 0), (60, 1, 0, 0, 0, 0), (18, 0, 0, 0, 0, 0)],
    [(45, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (7, 0, 0, 0, 1, 1), (66, 0, 0, 0, 1, 1), (20, 0, 0, 0, 0, 0), (28, 0, 0, 0, 0, 0), (33, 0, 0, 0, 0, 0)],
    # an article of lists and links
    [(62, 2, 0, 0, 1, 1), (2, 2, 0, 0, 1, 1), (3, 3, 0, 0, 1, 1), (45, 0, 0, 0, 1, 1), (5, 5, 0, 0, 1, 1), (4, 3, 0, 0, 1, 1), (90, 10, 0, 0, 1, 1), (12, 11, 0, 0, 1, 1)],
    [(30, 28, 0, 0, 1, 1), (6, 6, 0, 0, 1, 1), (6, 6, 0, 0, 1, 1), (8, 0, 0, 0, 1, 1), (2, 2, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0)],
    # a notice and a form in an article body; a chapter of an article that is named like a box
    [(9, 0, 0, 0, 1, 1), (50, 0, 0, 0, 1, 1), (14, 0, 0, 1, 1, 0), (60, 0, 0, 0, 1, 1), (2, 0, 0, 1, 1, 0), (20, 1, 0, 1, 1, 0), (70, 0, 0, 0, 1, 1), (5, 0, 1, 0, 1, 0)],
    [(8, 0, 0, 0, 1, 1), (40, 0, 0, 0, 1, 1), (60, 0, 0, 1, 1, 1), (75, 3, 0, 1, 1, 1), (52, 0, 0, 1, 1, 1), (45, 0, 0, 0, 1, 1)],
    # no element says what the article is: menu lines, headline, paragraphs with a short heading, link lists, imprint
    [(2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (7, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (55, 3, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1), (4, 4, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0), (5, 4, 0, 0, 0, 0)],
    [(1, 1, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (5, 0, 0, 0, 0, 1), (18, 0, 0, 0, 0, 1), (22, 4, 0, 0, 0, 1), (14, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 1), (30, 27, 0, 0, 0, 0), (8, 7, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)],
    [(8, 0, 1, 0, 0, 0), (35, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 1), (30, 0, 0, 0, 0, 1), (50, 0, 1, 0, 0, 0), (20, 0, 0, 1, 0, 0), (33, 0, 1, 0, 0, 0)],
    [(2, 2, 0, 0, 0, 0), (6, 0, 0, 0, 0, 1), (35, 0, 0, 0, 0, 1), (41, 2, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1), (4, 4, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0)],
    [(9, 0, 0, 0, 0, 1), (44, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 1), (9, 9, 0, 0, 0, 0), (7, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)],
    [(1, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (52, 0, 0, 0, 0, 1), (1, 0, 0, 0, 0, 1), (33, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (60, 0, 0, 0, 0, 1)],
    [(1, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (1, 0, 0, 0, 0, 1), (38, 0, 0, 0, 0, 1)],
    [(25, 0, 0, 0, 0, 1)],
    [(50, 0, 0, 0, 0, 1), (60, 0, 0, 0, 0, 1), (46, 2, 0, 0, 0, 1), (70, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1), (90, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 1)],
    [(3, 3, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (4, 0, 0, 0, 0, 1), (80, 5, 0, 0, 0, 1), (64, 0, 0, 0, 0, 1), (24, 0, 0, 1, 0, 0), (55, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0)],
    [(3, 0, 0, 0, 0, 1), (40, 1, 0, 0, 0, 1), (4, 0, 0, 0, 0, 1)],
]


def rows_of(blocks: list[tuple]) -> list[tuple]:
    """FEATURES of each block (words, linked words, boiler, weak, body, ...) of a page."""
    has_body = any(b[4] and not b[2] for b in blocks)
    own = [(b[0], min(1.0, b[1] / b[0])) for b in blocks]
    return [(*o, *before, *after, b[2], b[3], b[4], has_body) for b, o, before, after in zip(blocks, own, [(0, 0.0), *own], [*own[1:], (0, 0.0)], strict=False)]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree (feature, threshold, at most, above) by Gini impurity; leaves are shares of label 1. Of equally
    good splits the earliest feature wins."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return float(y.mean())
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


TREE = grow(np.array([r for page in LABELLED for r in rows_of(page)], dtype=float), np.array([b[5] for page in LABELLED for b in page], dtype=float))


def keeps(row: tuple, tree=TREE) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def _named(names: str) -> tuple[str, bool]:
    """What class or id names say: ``boiler``, ``weak`` or nothing, and whether they name an article's body."""
    kind, body = "", False
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        while parts and parts[-1].isdigit():
            parts.pop()
        known = all(p in _SURE or p in _WEAK or p in _NEUTRAL for p in parts)
        if known and "header" in parts and any(p in _BODIES for p in parts):
            continue  # an article's own header has its headline
        if known and any(p in _SURE for p in parts):
            kind = "boiler"
        elif known and any(p in _WEAK for p in parts):
            kind = kind or "weak"
        elif parts and parts[0] in _BODIES and all(p in _OF_BODY for p in parts):
            body = True
    return kind, body and not kind


def _said(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(``always``, ``boiler``, ``weak`` or nothing; article body; unseen) by an element's name and attributes."""
    kind, body, unseen = ("always" if name in _ALWAYS else "boiler" if name in _BOILER else ""), name in _MAIN, False
    if attributes and not attributes.isspace():
        heading = name in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6")
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden":
                unseen = True
            elif key == "style":
                plain = value.replace(" ", "").lower()
                unseen |= "display:none" in plain or "visibility:hidden" in plain
            elif key == "role":
                if value.lower() in _ROLES:
                    kind = "always"
                body |= value.lower() in ("main", "article")
            elif key == "itemprop":
                body |= value == "articleBody"
            elif key in ("class", "id") and not heading and name != "main":
                told, own = _named(value)
                kind = kind or told if told != "boiler" else kind if kind == "always" else told
                body |= own and name not in _INLINE
    return kind, body, unseen


class _Element:
    """An open block-level element. ``mark`` is the innermost boilerplate element it is in, by number (-1: none); open
    inline elements are kept by name, with how many of them are unseen, named as boilerplate, or code."""

    __slots__ = ("name", "mark", "body", "unseen", "raw", "inline", "counts")

    def __init__(self, name: str, mark: int, body: bool, unseen: bool, raw: bool):
        self.name, self.mark, self.body, self.unseen, self.raw = name, mark, body, unseen, raw
        self.inline: dict[str, list[tuple[bool, bool, bool]]] = {}
        self.counts = [0, 0, 0]

    def open(self, name: str, said: tuple[bool, bool, bool]) -> None:
        self.inline.setdefault(name, []).append(said)
        self.counts = [n + s for n, s in zip(self.counts, said, strict=True)]

    def close(self, name: str) -> None:
        if self.inline.get(name):
            self.counts = [n - s for n, s in zip(self.counts, self.inline[name].pop(), strict=True)]


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Flat blocks of a page in order: text, words, linked words, boiler, weak, body."""
    found: list[tuple[str, int, int, int, bool, bool]] = []
    kinds: list[str] = []  # of each boilerplate element, by its number
    parents: list[int] = []
    holds: list[bool] = []  # whether a headline or an article is inside
    heads: dict[int, str] = {}  # first headings of elements that only an id names, inside an article's body
    text: list[str] = []
    stack, open_ = [_Element("", -1, False, False, False)], Counter()
    linked, named, in_link, headed = 0, 0, False, False

    def flush() -> None:
        nonlocal linked, named
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                block, words = stack[-1], whole.count(" ") + 1
                found.append((whole, words, linked, block.mark, block.body, named >= words))
                if _HEADING.fullmatch(block.name) and block.mark in heads and not heads[block.mark]:
                    heads[block.mark] = whole
            text.clear()
        linked = named = 0

    def say(raw: str) -> None:
        nonlocal linked, named
        here = stack[-1]
        if not here.unseen and not here.counts[0]:
            said = _html.unescape(raw)
            text.append(said)
            if in_link:
                linked += len(said.split())
            if here.counts[1]:
                named += len(said.split())

    def leave(depth: int) -> None:
        for e in stack[depth:]:
            open_[e.name] -= 1
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] if m[3] is not None else m[4]
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            here = stack[-1]
            if closing:
                here.close(name)
            elif name not in _VOID:
                kind, _, unseen = _said(name, attributes) if attributes else ("", False, False)
                code = name in ("code", "kbd", "samp")  # in code such names are colours
                boiler = kind in ("always", "boiler") and not here.raw and not here.counts[2]
                here.open(name, (unseen or boiler and bool(_READERS & set(_PART.findall(attributes.lower()))), boiler, code))
            continue
        if not closing and name in _RAW:  # runs to its own close tag, or to the end of the page
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        flush()
        in_link = False
        if name in _VOID:
            continue
        if closing:
            if open_[name]:
                leave(max(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name) if stack[-1].name != name else len(stack) - 1)
            continue
        last = stack[-1].name
        if name in _ENDS_P and last == "p" or name in _REPEATS and last == name:  # an open paragraph or item ends where the next one starts
            leave(len(stack) - 1)
        above = stack[-1]
        kind, body, unseen = _said(name, attributes)
        if name == "header" and not above.body:
            kind = "always"  # an article's own header has its headline
        mark = above.mark
        if name in _MAIN and not kind or name == "h1":
            headed = True
            if mark >= 0:
                holds[mark] = True
        if kind:
            parents.append(mark)
            mark = len(kinds)
            kinds.append(kind)
            holds.append(False)
            if kind == "boiler" and above.body and name not in _BOILER and _said(name, _ID.sub(" ", attributes))[0] != "boiler":
                heads[mark] = ""
        if not attributes.endswith("/") or name not in ("svg", "math"):
            stack.append(_Element(name, mark, above.body or body, above.unseen or bool(above.counts[0]) or unseen or name in _UNSEEN, above.raw or name == "pre"))
            open_[name] += 1
    flush()
    plain = [0] * len(kinds)
    for _, words, links, mark, _, _ in found:
        if mark >= 0:
            plain[mark] += max(0, words - links)
    for k in range(len(kinds) - 1, -1, -1):  # an element's number is above its parent's
        if parents[k] >= 0:
            plain[parents[k]] += plain[k]
            holds[parents[k]] |= holds[k]
    most = sum(max(0, words - links) for _, words, links, *_ in found) / 2
    boiler, weak = [], []
    for k, kind in enumerate(kinds):
        if kind != "always" and plain[k] > most and (holds[k] or not headed) or _says_more(heads.get(k, "")):
            kind = ""
        above = parents[k]
        boiler.append(kind in ("always", "boiler") or above >= 0 and boiler[above])
        weak.append(kind == "weak" or above >= 0 and weak[above])
    boiler.append(False)  # of mark -1
    weak.append(False)
    return [(t, w, n, boiler[mark] or inline, weak[mark], body) for t, w, n, mark, body, inline in found]


def _says_more(heading: str) -> bool:
    """Whether a heading has a word that boilerplate's headings don't have."""
    return any(w not in _SURE and w not in _WEAK and w not in _NEUTRAL and w not in _LABELS for w in re.findall(r"[^\W\d_]+", heading.lower()))


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line feeds."""
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, row in zip(found, rows_of([b[1:] for b in found]), strict=True) if keeps(row))


def _extract(batches):
    for batch in batches:
        texts = [main_text(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    return bounded(pages).select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
