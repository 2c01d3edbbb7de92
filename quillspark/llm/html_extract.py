"""HTML extraction by tag-path ratios.

A page becomes text nodes with their root-to-leaf tag paths (tags with their
class). For each path the text length per node and the punctuation per node are
summed over its nodes, with link text taken out; both ratios' logarithms are smoothed over
the neighbouring nodes in page order, fused by their product, and paths that
reach the mean of the page's paths are selected. Selected nodes vote for the
smallest element that holds most of their text. The main text is the blocks
with selected nodes in that element. Tags correct this: short paragraphs,
headings and list items there stay beside them, all of an ``article`` or
``main`` does, and the parts that HTML or a class name marks as something else
(menus, notices, adverts, forms, comments and the like) and lists of links go.
A form that holds nearly all of a page is its frame: only its controls go. A
paragraph that is a link stays where most of the paragraphs beside it are none.

Each page is read whole in one pass of a batch function; nothing is shuffled.

Defined results: a null or empty page, or one without text, gives an empty
text; text without any tags is its own main text; repeated rows give repeated
results; null ids and urls stay; further columns don't matter; an empty table
gives an empty result. A line break counts as white space of its block. Tags
that are never closed end with their parent, as in browsers.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas video audio".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow ms msqrt msub msubsup msup mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NOT_MAIN = frozenset("head nav footer aside form button select option dialog menu figcaption".split()) - {"figcaption"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = INLINE | HEADING | frozenset("p pre blockquote li dt dd td th tr figcaption caption".split())
#: Tags that end an open tag of the second kind, up to the third.
_CLOSES = {t: ({"p"}, {"button", "td", "th", "table", "html"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()}
_CLOSES |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Words of a class, id or role that mark a part as not the article, if all its other words are neutral.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall search "
    "comment comments commentlist disqus replies respond discussion share sharing social related recommended recommendations widget pagination pager tags skip complementary contentinfo dialog".split()
)
_HEADERS = frozenset("header siteheader pageheader banner".split())
_NEUTRAL = frozenset(
    "area bar block body bottom box buttons button col column container content copy form global group holder inner item items left level link links list main message number outer page panel "
    "post posts primary region right row secondary section site slot small sticky text thread title top unit wrap wrapper".split()
)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _named(names: str, words: frozenset) -> bool:
    """Whether a name has one of the words, and neutral ones or such only besides: ``side-box``, not ``side-effects``."""
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.findall(name)]
        if not words.isdisjoint(parts) and all(x in words or x in _NEUTRAL or x in _MARKS for x in parts):
            return True
    return False


_START = re.compile(r"<[a-zA-Z/!?]")
#: A tag; quotes count behind an equals sign only. No part gives back what it took, so a scan is linear.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=["'])|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_POINTS = re.compile(r"[.,;:!?…。，、；：！？]")
SMOOTH = (0.1, 0.8, 0.1)
SHARE = 0.8
#: The share of a page's text from which a form is its frame.
FRAME = 0.8
#: Blocks that a link may fill as part of a text.
PARAGRAPHS = frozenset("p blockquote pre dd".split())
#: Blocks that are text by their tag: short ones of them stay between selected ones.
_TEXTS = _LEAVES - INLINE
#: What a character outside such blocks weighs in the vote.
BARE = 0.15


class _Element:
    __slots__ = ("tag", "parent", "depth", "path", "off", "link", "main", "heading", "weight", "shown", "inside", "form", "box")

    def __init__(self, tag: str, parent: _Element | None, attributes: str, paths: dict):
        self.tag, self.parent, self.weight, self.shown, self.inside = tag, parent, 0.0, False, False
        kind = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        self.depth = parent.depth + 1 if parent else 0
        self.path = paths.setdefault((parent.path if parent else -1, tag, kind.get("class", "")), len(paths))  # a number for each tag path
        self.main = bool(parent and parent.main) or tag in ("article", "main") or kind.get("role") == "main"
        self.link = bool(parent and parent.link) or tag == "a"
        self.heading = bool(parent and parent.heading) or tag in HEADING
        self.form = (bool(parent and parent.form) or tag == "form") and tag not in ("button", "select", "option")
        self.box = parent.box if parent and tag in INLINE else self  # the block that it stands in
        self.off = bool(parent and parent.off) or tag in NOT_MAIN or (tag == "header" and not self.main)
        if kind and not self.off and tag not in ("html", "body", "article", "main"):
            names = f"{kind.get('class', '')} {kind.get('id', '')} {kind.get('role', '')}"
            self.off = _named(names, _MARKS) or (not self.main and _named(names, _HEADERS)) or "hidden" in kind or kind.get("aria-hidden") == "true" or "display:none" in kind.get("style", "").replace(" ", "")


def nodes(page: str, framed: bool = False) -> tuple[list[tuple[_Element, str, int]], list[_Element]]:
    """(element, text, block) of the page's text nodes in order, scripts and the like left out; and all elements, parents first.

    framed: forms are the page's frame, not a part of it.
    """
    out: list[tuple[_Element, str, int]] = []
    paths: dict = {}
    now = _Element("", None, "", paths)
    every, open_, block, at = [now], Counter(), 0, 0

    def close(last: _Element) -> _Element:
        """End the open elements up to this one; its parent."""
        up = now
        while up is not last:
            open_[up.tag] -= 1
            up = up.parent
        open_[last.tag] -= 1
        return last.parent

    while at < len(page):
        start = _START.search(page, at)
        end = start.start() if start else len(page)
        if end > at:
            out.append((now, page[at:end], block))
        if not start:
            break
        m = _TAG.match(page, end) if page[end + 1].isalpha() or page[end + 2 : end + 3].isalpha() and page[end + 1] == "/" else None
        if not m:  # a comment or the like; or a tag that never ends, which takes the rest
            mark = "-->" if page.startswith("<!--", end) else ">"
            stop = page.find(mark, end + 2) if not (page[end + 1].isalpha() or page[end + 1] == "/" and page[end + 2 : end + 3].isalpha()) else -1
            at = stop + len(mark) if stop >= 0 else len(page)
            continue
        at = m.end()
        tag = m[2].lower()
        block += tag not in INLINE
        if framed and tag == "form":
            tag = "div"
        if m[1]:
            if open_[tag] > 0:
                find = now
                while find.tag != tag:
                    find = find.parent
                now = close(find)
            continue
        if tag == "br":
            out.append((now, " ", block))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            if any(open_[x] > 0 for x in ends):
                find = now
                while find.parent and find.tag not in ends and find.tag not in stops:
                    find = find.parent
                if find.parent and find.tag in ends:
                    now = close(find)
        if tag not in VOID:
            now = _Element("div" if framed and tag == "form" else tag, now, m[3], paths)
            open_[now.tag] += 1
            every.append(now)
    return out, every


def _smoothed(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(w * padded[i + j] for j, w in enumerate(SMOOTH)) for i in range(len(values))]


def _in_forms(found: list[tuple[_Element, str, int]]) -> float:
    """The share of a page's text that stands in forms, outside their controls."""
    inside = sum(len(t.strip()) for e, t, _ in found if e.form)
    return inside / max(1, sum(len(t.strip()) for _, t, _ in found))


def _beside(e: _Element) -> _Element | None:
    """The element around the paragraph that a text node makes up; none if it stands in another kind of block."""
    return e.box.parent if e.box.tag in PARAGRAPHS else None


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, one to a line."""
    if not page:
        return ""
    found, every = nodes(page)
    if any(e.tag == "form" for e in every) and _in_forms(found) >= FRAME:
        found, every = nodes(page, framed=True)
    found = [(e, html.unescape(t), b) for e, t, b in found]
    shown = [(e, t) for e, t, _ in found if not e.off and t.strip()]
    if not shown:
        return ""
    totals: dict[int, list[float]] = {}
    for e, t in shown:
        own = totals.setdefault(e.path, [0, 0, 0])
        own[0] += 1
        if not e.link:
            own[1] += len(t.strip())
            own[2] += len(_POINTS.findall(t))
    ratio = {p: (math.log1p(chars / n), math.log1p(points / n)) for p, (n, chars, points) in totals.items()}
    long = _smoothed([ratio[e.path][0] for e, _ in shown])
    dots = _smoothed([ratio[e.path][1] for e, _ in shown])
    fused: dict[int, float] = {}
    for (e, _), x, y in zip(shown, long, dots):
        own = ratio[e.path]
        fused[e.path] = max(fused.get(e.path, 0.0), x * (1 + y) * (own[0] > 0))
    mean = sum(fused.values()) / max(1, sum(v > 0 for v in fused.values()))  # of the paths with text of their own
    chosen = {p for p, v in fused.items() if v >= mean * (1 - 1e-9) and v > 0}
    # the elements that hold the chosen nodes' text; the deepest with most of it is the content
    whole = 0.0
    for e, t in shown:
        e.shown = True
        if e.path in chosen and not e.link:
            own = len(t.strip()) * (1.0 if e.box.tag in _TEXTS else BARE)
            whole += own
            e.weight += own
    for e in reversed(every[1:]):  # children before parents
        e.parent.weight += e.weight
        e.parent.shown |= e.shown
    content: _Element | None = None
    for e in every:
        if e.shown and e.tag not in _LEAVES and e.weight >= SHARE * whole and (content is None or e.depth > content.depth):
            content = e
    if content is not None and content.main:  # an article's further parts belong to it
        while content.parent and content.parent.main:
            content = content.parent
    for e in every:
        e.inside = content is None or e is content or bool(e.parent and e.parent.inside)
    linked: dict[int, list[int]] = {}
    for e, t, b in found:
        if not e.off:
            own = linked.setdefault(b, [0, 0])
            own[e.link] += len(t.strip())
    around: dict[_Element, list[int]] = {}
    for e, t, _ in found:
        if not e.off and (near := _beside(e)):
            around.setdefault(near, [0, 0])[e.link] += len(t.strip())
    marked = content is not None and content.main
    selected = {b for e, t, b in found if e.path in chosen and t.strip()}  # a block goes with its selected parts
    lines: dict[int, list[str]] = {}
    for e, t, b in found:
        if e.off or not e.inside or not (b in selected or e.box.tag in _TEXTS or marked):
            continue
        plain, link = linked[b]
        if link > 2 * plain and not e.heading and not marked:
            beside = around.get(_beside(e), (0, 1))
            if beside[0] <= beside[1]:  # a linked paragraph among paragraphs is one of them
                continue  # a block of links outside an article is a menu
        lines.setdefault(b, []).append(t)
    blocks = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (its code points) to the pages, in place of such columns."""
    small_batches(pages.sparkSession, 500)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(main_text, na_action=None)

    out = pages.withColumn("text", F.pandas_udf(texts, "string")(F.coalesce(F.col(html_col), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))
