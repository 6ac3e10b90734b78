"""Main text of web pages by tag-path ratios.

A page is read into blocks: the text between two block-level boundaries. Blocks
that hang from the same sequence of block-level tags share a *tag path*. For
every path the mean text length without links (text ratio) and the mean number
of punctuation marks (punctuation ratio) of its blocks are taken; a short page
order kernel smooths both over neighbouring blocks, their product is the score
of a block, and the mean score of its blocks that of a path. Paths at or above
the threshold (the deviation of the scores, at most a quarter of the best) are
content. The content region is the smallest part of the tree that holds most of
their text, or the page's own ``article`` or ``main`` with the most of it; every
block of the region stays, so headings, lists and short lines of an article do.

What a page itself declares as something else (navigation, page header, footer,
aside, forms, and elements whose class, id or role says menu, advert, notice,
comments and the like), what is never shown, and lists made of links only are
no blocks at all. A declared element that wraps the article is not taken at
its word, except where it is for comments.

It is one narrow Arrow stage. Defined results: null, empty and text-free pages
give an empty text; every page is one row, so a very long one is held whole in
its task (about ten times its bytes); repeated pages and ids are repeated rows;
other columns are not read, an empty table gives no rows. Of equally good
regions the first counts. Unclosed and stray tags, comments and quotes follow
the usual recovery: the text stays, the markup goes.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenseek.llm.common import ready

#: Share of the content that the region holds, and of its characters in links from which a list is a menu.
REGION, MENU = 0.7, 0.9
#: Weights of a block and of its neighbours on either side.
KERNEL = np.array([0.15, 0.7, 0.15])

#: What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title textarea iframe noframes noembed xmp object svg math canvas "
                   "audio video select datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p "
                   "pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = HEADINGS | frozenset("ul ol dl blockquote pre table figure hr".split())
#: An opening tag ends open elements of these names, up to the nearest of the second ones.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set())}
CELLS = frozenset("td th caption table".split())

#: Elements and words in class, id and role that declare something other than the article.
OTHER_TAGS = frozenset("nav footer aside form button dialog menu search fieldset".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary respond reply replies responses disqus discussion "
                          "feedback guestbook".split())
OTHER_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsors sponsored "
    "promo promos promotion promoted banner banners nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs "
    "header masthead topbar footer colophon copyright sidebar sidebars aside rail widget widgets cookie cookies consent gdpr "
    "notice notices alert alerts popup popups modal overlay toast dialog paywall newsletter subscribe subscription signup "
    "login signin register search searchbox form share sharing sharebar social follow related recommended recommendations "
    "trending popular pagination pager toolbar skiplink teaser teasers outbrain taboola disclaimer contentinfo "
    "complementary".split())
#: A word after one of these says what the page has, not what the element is.
ABOUT = frozenset("has have with without no non is show hide toggle".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MARKS = re.compile(r"[.,;:!?…。、，！？；：»«\"“”]")


def declared(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element says that it is something else, that it is for comments, that it is not shown."""
    other = comments = hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for label in unescape(value).split():
                words = [w.lower() for w in _WORD.findall(label)]
                said = {w for at, w in enumerate(words) if not ABOUT.intersection(words[:at])}
                comments |= not said.isdisjoint(COMMENT_WORDS)
                other |= not said.isdisjoint(OTHER_WORDS)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return other, comments, hidden


class Page:
    """Block-level elements of a page in order of their start, and its blocks.

    ``tag``, ``up`` (parent), ``path``, ``other``, ``comments`` and ``unseen``
    are by element; ``where``, ``text`` and ``linked`` (characters in links) by
    block.
    """

    def __init__(self, html: str):
        self.tag, self.up, self.path, self.other, self.comments, self.unseen = ["html"], [0], [0], [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.where: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._open: list[tuple[str, int]] = [("html", 0)]  # inline elements carry the block they are in
        self._parts: list[str] = []
        self._links, self._in_link, self._dark = 0, 0, 0
        self._read(html)
        self._close_block()

    def _read(self, html: str) -> None:
        at = 0
        while (found := _TOKEN.search(html, at)) is not None:
            if found.start() > at:
                self._say(html[at:found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                self._end(name)
            elif name in HIDDEN and not found[3].endswith("/"):
                at = self._past(html, name, at)
            elif name == "br":
                self._parts.append(" ")
            elif name == "hr":
                self._close_block()
            elif name not in VOID:
                self._start(name, found[3])
        if at < len(html):
            self._say(html[at:])

    def _past(self, html: str, name: str, at: int) -> int:
        """Where an element that is not read ends."""
        end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
        return end.end() if end else len(html)

    def _say(self, raw: str) -> None:
        if self._dark:
            return
        text = unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._in_link:
            self._links += len("".join(text.split()))

    def _close_block(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.where.append(self._open[-1][1])
            self.text.append(text)
            self.linked.append(self._links)
        self._parts, self._links = [], 0

    def _pop(self) -> None:
        name, _ = self._open.pop()
        self._in_link -= name == "a"
        self._dark -= name == "\0"

    def _leave(self, depth: int) -> None:
        """Close all open elements from ``depth`` on."""
        while len(self._open) > depth:
            if self._open[-1][0] in BLOCKS:
                self._close_block()
            self._pop()

    def _start(self, name: str, attributes: str) -> None:
        inside = self._open[-1][1]
        if name not in BLOCKS:
            if name == "a":
                self._end("a")
            self._open.append((name, inside))
            self._in_link += name == "a"
            return
        if name in ("html", "head"):
            return
        self._close_block()
        if name != "body":
            self._end("p", implied=True)
        names, border = ENDS.get(name, (set(), set()))
        if names:
            depth = len(self._open)
            for at in range(len(self._open) - 1, 0, -1):
                if self._open[at][0] in border:
                    break
                if self._open[at][0] in names:
                    depth = at
            self._leave(depth)
        if name in ("article", "main"):
            # An article inside of these means that their end is missing.
            for at, (other, _) in enumerate(self._open):
                if other in ("nav", "header", "footer", "form", "ul", "ol"):
                    self._leave(at)
                    break
        inside = self._open[-1][1]
        other, comments, hidden = declared(name, attributes) if attributes.strip(" /") else (False, False, False)
        self.tag.append(name)
        self.up.append(inside)
        self.path.append(self.paths.setdefault((self.path[inside], name), len(self.paths) + 1))
        self.other.append(other)
        self.comments.append(comments)
        self.unseen.append(hidden)
        self._open.append((name, len(self.tag) - 1))

    def _end(self, name: str, implied: bool = False) -> None:
        block = name in BLOCKS
        for at in range(len(self._open) - 1, 0, -1):
            opened = self._open[at][0]
            if opened == name:
                if block:
                    self._leave(at)
                else:
                    self._in_link -= name == "a"
                    del self._open[at]
                return
            # Inline ends do not reach out of a block, implied ends of p neither; no end reaches out of a cell.
            if (implied or not block) and opened in BLOCKS:
                return
            if opened in CELLS and name not in CELLS and name not in ("tr", "tbody", "thead", "tfoot"):
                return


def left_out(page: Page) -> np.ndarray:
    """Which elements are not part of any article."""
    n = len(page.tag)
    holds, size, linked, items = [False] * n, [0] * n, [0] * n, [0] * n
    for e, text, links in zip(page.where, page.text, page.linked):
        size[e] += len(text)
        linked[e] += links
    for e in range(n - 1, 0, -1):
        up = page.up[e]
        holds[up] |= holds[e] or (page.tag[e] in ("article", "main") and not page.other[e])
        size[up] += size[e]
        linked[up] += linked[e]
        items[up] += page.tag[e] == "li"
    out = np.zeros(n, dtype=bool)
    in_article = [False] * n
    for e in range(1, n):
        up, tag = page.up[e], page.tag[e]
        in_article[e] = in_article[up] or tag in ("article", "main")
        own = page.unseen[e] or page.comments[e] and tag not in ("body", "main") and not holds[e]
        if not own and not holds[e] and tag not in ("body", "main"):
            own = (tag in OTHER_TAGS or page.other[e] and tag not in HEADINGS or tag == "header" and not in_article[e]
                   or tag in ("ul", "ol") and items[e] > 1 and linked[e] >= MENU * size[e] > 0)
        out[e] = out[up] or own
    return out


def _smoothed(values: np.ndarray) -> np.ndarray:
    near = np.convolve(values, KERNEL)[1:-1]
    return near / np.convolve(np.ones(len(values)), KERNEL)[1:-1]


def content_paths(path: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each block, whether its path is content: ratios of the paths, smoothed, fused, against the threshold."""
    _, at = np.unique(path, return_inverse=True)
    blocks = np.bincount(at)
    text_ratio, mark_ratio = np.bincount(at, weights=chars) / blocks, np.bincount(at, weights=marks) / blocks
    fused = _smoothed(text_ratio[at]) * (1.0 + _smoothed(mark_ratio[at]))
    score = np.bincount(at, weights=fused) / blocks
    return (score >= min(fused.std(), score.max() / 4))[at]


def region(page: Page, blocks: list[int], weight: np.ndarray) -> tuple[list[int], bool]:
    """The elements that hold the article, and whether that is a part of the page rather than all of it."""
    n = len(page.tag)
    total = np.zeros(n)
    np.add.at(total, [page.where[b] for b in blocks], weight)
    for e in range(n - 1, 0, -1):
        total[page.up[e]] += total[e]
    for tag in ("article", "main"):
        found = [e for e in range(1, n) if page.tag[e] == tag and total[e] > 0]
        if found:
            best = max(found, key=lambda e: total[e])
            if tag == "main" or total[best] >= REGION * max((total[e] for e in range(1, n) if page.tag[e] == "main"), default=0) \
                    or sum(page.path[e] == page.path[best] for e in found) > 1:
                return [e for e in found if page.path[e] == page.path[best]], True
    best = 0
    for e in range(1, n):
        # Children come after their parents; a later element replaces one that it lies in.
        if page.up[e] == best and total[e] >= REGION * total[0] and page.tag[e] not in HEADINGS | {"p", "li"}:
            best = e
    return [best], page.tag[best] not in ("html", "body")


def main_text(html: str | None) -> str:
    """The article of one page, blocks joined by one space."""
    if not html:
        return ""
    page = Page(html)
    out = left_out(page)
    blocks = [b for b in range(len(page.text)) if not out[page.where[b]]]
    if not blocks:
        return ""
    chars = np.array([max(len(page.text[b]) - page.linked[b], 0) for b in blocks], float)
    marks = np.array([len(_MARKS.findall(page.text[b])) for b in blocks], float)
    path = np.array([page.path[page.where[b]] for b in blocks])
    content = content_paths(path, chars, marks)
    roots, part = region(page, blocks, np.where(content, chars + 1, 0.0))
    inside, top = [False] * len(page.tag), [0] * len(page.tag)
    for e in range(len(page.tag)):
        up = page.up[e]
        inside[e] = e in roots or e > 0 and inside[up]
        top[e] = e if up in roots else top[up]
    kept = [page.text[b] for b, good in zip(blocks, content)
            if inside[page.where[b]] and (part or good or page.tag[top[page.where[b]]] in PARTS)]
    return " ".join(kept)


def extracted(spark, html: Column) -> Column:
    """The main text of a column of pages."""
    ready(spark)

    def cut(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return F.arrow_udf(cut, "string")(html)


def op11_extraction(pages: DataFrame) -> DataFrame:
    """Main text of every page and its length; a page without one gives an empty text."""
    found = pages.select("page_id", "url", extracted(pages.sparkSession, F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
