"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks: runs of text between block
elements, each with the elements around it.  A two-label chain (main text or not)
is trained on labelled pages by gradient ascent on the conditional likelihood and
decoded by Viterbi.  A block's features are

* ancestors: tags, and words of class, id and role attributes.  Elements around
  the page's main container (the one with most prose of its own, of its children
  and theirs) tell little of a block (a form or a ``has-comments`` class may
  enclose a whole page) and are features of another kind than those inside;
* text: length, share in links, punctuation, short texts that begin like a menu,
  notice, comment heading or legal line;
* place: in or next to the main container, the prose and links of the block's
  own container, what heads it, whether a heading stands above prose.

The labelled pages come from a generator of page layouts with invented words
(``labelled_pages``): semantic tags, named classes, and pages without either, in
nested wrappers, tables and forms, each block labelled when written.  Training is
deterministic, takes some seconds on the driver, and its size does not depend on
the input; the weights (some hundred numbers) go to executors.

Text: character references are decoded, white space inside a block becomes one
space, main blocks are joined in page order by two newlines.  What is not shown as
text (scripts, styles, templates, frames, titles, text areas) is no block; nothing
else is dropped and nothing is cut.

Defined cases: null html is empty and gives an empty text; a page without main
blocks gives an empty text; text outside any element is a block like any other;
unclosed and misnested elements are closed by their parents; a tag that never ends
is text; null or repeated ids are carried as they are; an empty table gives an
empty result.  The scanner looks at each character a bounded number of times,
whatever is left open.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import strings
from .storage import read, without

NAME = re.compile(r"/?[a-zA-Z][^\s/><]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "template", "iframe", "textarea", "title", "noembed", "noframes"}
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "map", "mark", "math", "noscript", "object", "picture", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "video", "wbr", "br"}
#: Parts of formulas and drawings: inline as well.
INLINE |= {"mi", "mo", "mn", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace", "mpadded", "semantics", "annotation", "g", "path", "text", "tspan", "circle", "rect", "line", "polyline", "polygon", "use", "defs"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "tr", "td", "th"} | HEADINGS
TAGS = ["article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "th", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "button", "select", "fieldset", "menu", "head", "dialog", "caption", "address", "details", "summary"]
#: Families of words in class, id and role attributes.
NAMES = {
    "advert": ["ad", "ads", "advert", "advertisement", "adsbox", "banner", "sponsor", "sponsored", "promo", "promotion", "adslot", "dfp"],
    "menu": ["nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toc", "pagination", "pager", "topnav", "subnav", "sitemap", "links"],
    "top": ["header", "masthead", "topbar", "branding", "logo", "top", "siteheader"],
    "bottom": ["footer", "foot", "copyright", "legal", "bottom", "contentinfo", "colophon", "disclaimer"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "complementary", "rail", "teaser", "teasers", "more"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "paywall", "toast", "banner"],
    "comment": ["comment", "comments", "reply", "replies", "disqus", "discussion", "responses", "commentlist", "respond"],
    "form": ["form", "login", "search", "searchbox", "signin", "contact", "register"],
    "share": ["share", "social", "sharing", "tags", "meta", "byline", "author", "follow"],
    "main": ["article", "content", "main", "post", "story", "entry", "body", "text", "prose", "output", "document", "page"],
}
_NAME = {w: k for k, ws in NAMES.items() for w in ws}
#: First words of short texts around an article.
CUES = {
    "legal": ["©", "copyright", "(c)", "all rights", "terms", "privacy", "imprint", "impressum", "legal"],
    "notice": ["we use cookies", "this site uses", "this website uses", "cookies", "accept", "subscribe", "sign up", "get our", "join our", "your browser", "please enable", "newsletter"],
    "comment": ["comments", "comment", "leave a", "post a comment", "reply", "responses", "discussion", "show comments", "add a comment"],
    "share": ["share", "tweet", "email this", "print", "follow us", "tags", "filed under", "posted in", "posted by", "save"],
    "related": ["related", "you may also", "more from", "more stories", "popular", "most read", "trending", "recommended", "read also", "read more", "see also:", "recent posts", "latest", "archives", "categories", "editor's picks"],
    "menu": ["home", "about", "contact", "menu", "login", "log in", "sign in", "register", "search", "next", "previous", "skip to", "back to", "sitemap", "faq"],
    "advert": ["advertisement", "sponsored", "ad", "ads by", "advert", "promoted", "buy now", "shop now", "limited offer"],
}
_CUE = sorted(((w, k) for k, ws in CUES.items() for w in ws), key=lambda x: -len(x[0]))
_WRAPPED = ["article", "main", "section", "form", "header", "aside", "table", "li"]
FEATURES = ["bias", *[f"in:{t}" for t in TAGS], *[f"at:{t}" for t in TAGS], *[f"around:{t}" for t in _WRAPPED], *[f"name:{k}" for k in NAMES], *[f"around:{k}" for k in NAMES], "hidden"]
FEATURES += [f"words:{k}" for k in (1, 3, 8, 20, 60)] + [f"links:{k}" for k in range(4)] + ["stop", "no stop", "commas", "first", "last", "upper", "digits", "one link only", "bars", "bars and links"]
FEATURES += [f"cue:{k}" for k in CUES] + [f"headed:{k}" for k in CUES] + ["sign", "best", "before best", "after best", "above best", "leads prose", "prose next", "prose before", "no prose", "linked box", "linked own box"]
FEATURES += [f"box:{k}" for k in range(4)] + ["prose", "prose in best", "heading in best"]
PLACE = {f: i for i, f in enumerate(FEATURES)}
_TAG_IN, _TAG_AT = ({t: PLACE[f"{k}:{t}"] for t in TAGS} for k in ("in", "at"))
_AROUND = {t: PLACE[f"around:{t}"] for t in _WRAPPED}
_SHADE = {"advert", "menu", "bottom", "side", "notice", "comment", "form", "share"}
_SHADE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}


class Element:
    """A block element with the range of blocks that it encloses."""

    __slots__ = ("tag", "names", "hidden", "parent", "start", "end")

    def __init__(self, tag: str, names: frozenset[str], hidden: bool, parent: int, start: int):
        self.tag, self.names, self.hidden, self.parent, self.start, self.end = tag, names, hidden, parent, start, start


class Block:
    __slots__ = ("text", "link", "element", "links")

    def __init__(self, text: str, link: float, element: int, links: int):
        self.text, self.link, self.element, self.links = text, link, element, links


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    out: set[str] = set()
    hidden = False
    if "=" in attributes or "hidden" in attributes.lower():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("hidden", "aria-hidden") and value != "false" or key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif key in ("class", "id", "role"):
                out.update(_NAME[w] for w in re.split(r"[^a-z]+", value) if w in _NAME)
    return frozenset(out), hidden


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes) pieces in order: text before a tag, then the tag ("/p" closes), "" at the end.

    One position moves forward.  What is missing from here on (a closing quote,
    comment end or ">") is missing everywhere behind, and is not sought again.
    """
    n, pos, text_from = len(page), 0, 0
    gone: dict[str, int] = {}  # what is not found from a place on

    def seek(what: str, at: int) -> int:
        if at >= gone.get(what, n + 1):
            return -1
        found = page.find(what, at)
        if found < 0:
            gone[what] = at
        return found

    while True:
        lt = page.find("<", pos)
        if lt < 0 or lt + 1 >= n:
            break
        follow = page[lt + 1]
        if follow == "!" or follow == "?" or (follow == "/" and not page[lt + 2 : lt + 3].isalpha()):
            if page.startswith("<!--", lt):
                end = seek("-->", lt + 4)
                end = n if end < 0 else end + 3
            else:
                end = seek(">", lt)
                if end < 0:
                    break
                end += 1
            yield page[text_from:lt], "", ""
            pos = text_from = end
            continue
        m = NAME.match(page, lt + 1) if follow == "/" or follow.isalpha() and follow < "\x80" else None
        if not m:
            pos = lt + 1
            continue
        at, end = m.end(), -1
        while True:  # to the ">" outside quotes
            gt = seek(">", at)
            if gt < 0:
                break
            q = min((x for x in (_within(page, '"', at, gt), _within(page, "'", at, gt)) if x >= 0), default=-1)
            if q < 0:
                end = gt
                break
            close = seek(page[q], q + 1)
            if close < 0:
                end = gt
                break
            at = close + 1
        if end < 0:
            end = seek(">", m.end())  # a quote that swallows the rest
            if end < 0:
                break
        yield page[text_from:lt], m[0].lower(), page[m.end() : end]
        pos = text_from = end + 1
        raw = m[0].lower()
        if raw in RAW and not page[m.end() : end].endswith("/"):
            close = _closing(page, raw, pos, gone)
            pos = text_from = n if close < 0 and raw in ("script", "style") else pos if close < 0 else close
    yield page[text_from:], "", ""


def _within(page: str, what: str, at: int, to: int) -> int:
    return page.find(what, at, to)


def _closing(page: str, tag: str, at: int, gone: dict[str, int]) -> int:
    """The place behind the closing tag of a raw element, or -1."""
    key = "/" + tag
    if at >= gone.get(key, len(page) + 1):
        return -1
    m = _CLOSING[tag].search(page, at)
    if not m:
        gone[key] = at
        return -1
    return m.end()


_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The leaf blocks of a page in order and its block elements (the first one is the page itself)."""
    blocks: list[Block] = []
    elements = [Element("", frozenset(), False, 0, 0)]
    stack = [0]
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link, links = False, 0

    def flush() -> None:
        nonlocal in_link, links
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(text, min(1.0, len("".join(linked)) / max(len("".join(parts)), 1)), stack[-1], links))
            parts.clear()
            linked.clear()
        in_link, links = False, 0

    def close() -> None:
        e = elements[stack.pop()]
        e.end = len(blocks)
        open_[e.tag] -= 1

    for text, tag, attributes in tokens(page):
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if not tag:
            continue
        closing = tag[0] == "/"
        tag = tag[1:] if closing else tag
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
                links += not closing
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            continue
        flush()
        if closing:
            if open_.get(tag):
                while elements[stack[-1]].tag != tag:
                    close()
                close()
            continue
        if tag in ENDS_P:
            while elements[stack[-1]].tag == "p" or elements[stack[-1]].tag in HEADINGS:
                close()
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and elements[stack[-1]].tag == tag:
            close()
        if tag not in VOID and not attributes.endswith("/"):
            names, hidden = _names(attributes) if attributes else (frozenset(), False)
            elements.append(Element(tag, names, hidden, stack[-1], len(blocks)))
            stack.append(len(elements) - 1)
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    for i in stack:
        elements[i].end = len(blocks)
    return blocks, elements


def blocks_of(page: str) -> list[Block]:
    return parsed(page)[0]


def _cue(text: str) -> str | None:
    low = text[:32].lower()
    for w, k in _CUE:
        if low.startswith(w) and not low[len(w) : len(w) + 1].isalnum():
            return k
    return None


def described(page: tuple[list[Block], list[Element]]) -> list[list[int]]:
    """All features of each block."""
    blocks, elements = page
    n = len(blocks)
    if not n:
        return []
    words = [b.text.count(" ") + 1 for b in blocks]
    stop = [b.text[-1] in ".!?:;\"”»…。" for b in blocks]
    prose = [min(k, 120) if b.link < 0.4 and (k >= 8 and s or k >= 18) else 0 for b, k, s in zip(blocks, words, stop)]
    sums = np.concatenate([[0], np.cumsum(prose)]).tolist()
    chars = np.concatenate([[0], np.cumsum([len(b.text) for b in blocks])]).tolist()
    link_chars = np.concatenate([[0], np.cumsum([len(b.text) * b.link for b in blocks])]).tolist()
    total = sums[-1]
    held = lambda e: sums[e.end] - sums[e.start]

    # the main container; what stands in menus, notes and the like counts little, unless they hold most of the page
    shade = [0] * (n + 1)
    for e in elements:
        if e.end > e.start and (e.tag in _SHADE_TAGS or e.names & _SHADE and not e.names & {"main"}) and held(e) < 0.7 * total:
            shade[e.start] += 1
            shade[e.end] -= 1
    shade = np.cumsum(shade).tolist()
    score: dict[int, float] = {}
    for i, b in enumerate(blocks):
        if prose[i]:
            w, at = prose[i] * (0.2 if shade[i] else 1.0), b.element
            if elements[at].tag in ("p", "li", "pre", "blockquote", "dd", "td") or elements[at].tag in HEADINGS:
                at = elements[at].parent
            for share in (1.0, 0.7, 0.45):
                score[at] = score.get(at, 0.0) + w * share
                if not at:
                    break
                at = elements[at].parent
    best = max(score, key=lambda e: (score[e], -e)) if score else 0
    b0, b1 = (elements[best].start, elements[best].end) if score else (0, 0)

    active: dict[int, int] = {}
    begins: dict[int, list[list[int]]] = {}
    ends: dict[int, list[list[int]]] = {}
    for j, e in enumerate(elements):
        if e.end == e.start or not j:
            continue
        around = bool(score) and e.start <= b0 and e.end >= b1 and (j == best or _encloses(elements, j, best))
        if around:
            f = [PLACE[f"around:{k}"] for k in e.names]
            if e.tag in _AROUND:
                f.append(_AROUND[e.tag])
        else:
            f = [PLACE[f"name:{k}"] for k in e.names]
            if e.tag in _TAG_IN:
                f.append(_TAG_IN[e.tag])
        if e.hidden:
            f.append(PLACE["hidden"])
        if f:
            begins.setdefault(e.start, []).append(f)
            ends.setdefault(e.end, []).append(f)

    cues = [_cue(b.text) if k <= 14 else None for b, k in zip(blocks, words)]
    own_tag = [elements[b.element].tag for b in blocks]
    heading = [t in HEADINGS for t in own_tag]
    next_text = [n] * (n + 1)  # the next block that is no heading
    for i in range(n - 1, -1, -1):
        next_text[i] = next_text[i + 1] if heading[i] else i
    out = []
    for i, b in enumerate(blocks):
        for f in ends.get(i, ()):
            for x in f:
                active[x] -= 1
                if not active[x]:
                    del active[x]
        for f in begins.get(i, ()):
            for x in f:
                active[x] = active.get(x, 0) + 1
        f = set(active)
        add = lambda name: f.add(PLACE[name])
        t, k = b.text, words[i]
        add("bias")
        if own_tag[i] in _TAG_AT:
            f.add(_TAG_AT[own_tag[i]])
        for w in (1, 3, 8, 20, 60):
            if k >= w:
                add(f"words:{w}")
        add(f"links:{min(3, int(b.link * 4))}")
        add("stop" if stop[i] else "no stop")
        if b.links == 1 and b.link > 0.9:
            add("one link only")
        if t.count("|") + t.count("·") + t.count("»") > 1:
            add("bars and links" if b.links > 1 else "bars")
        if "©" in t:
            add("sign")
        if t.count(",") > 1:
            add("commas")
        if 4 * i < n:
            add("first")
        if 4 * i >= 3 * n:
            add("last")
        if t.isupper():
            add("upper")
        if any(c.isdigit() for c in t):
            add("digits")
        if cues[i]:
            add(f"cue:{cues[i]}")
        inside = bool(score) and b0 <= i < b1
        if not score:
            add("no prose")
        elif inside:
            add("best")
            if prose[i]:
                add("prose in best")
            if heading[i]:
                add("heading in best")
        else:
            add("before best" if i < b0 else "after best")
            if i < b0 and heading[i] and next_text[i] >= b0:
                add("above best")
        if prose[i]:
            add("prose")
        if heading[i] and (j := next_text[i]) < n and prose[j]:
            add("leads prose")
        if i + 1 < n and prose[i + 1]:
            add("prose next")
        if i and prose[i - 1]:
            add("prose before")
        box = elements[b.element]
        if box.tag in ("p", "li", "td", "th", "tr", "dt", "dd") or box.tag in HEADINGS:
            box = elements[box.parent]
            if box.tag in ("ul", "ol", "dl", "tr", "tbody", "thead", "table"):
                own = chars[box.end] - chars[box.start]
                if own and (link_chars[box.end] - link_chars[box.start]) > 0.6 * own:
                    add("linked own box")
                box = elements[box.parent]
        size = chars[box.end] - chars[box.start]
        if size and (link_chars[box.end] - link_chars[box.start]) > 0.5 * size:
            add("linked box")
        share = held(box) / total if total else 0.0
        add(f"box:{0 if share == 0 else 1 if share < 0.15 else 2 if share < 0.5 else 3}")
        for e in (box, elements[box.parent]):
            if e.start < i and cues[e.start] and not (e.start <= b0 and e.end >= b1 and score):
                add(f"headed:{cues[e.start]}")
        out.append(sorted(f))
    return out


def _encloses(elements: list[Element], outer: int, inner: int) -> bool:
    """Elements of one range of blocks: the outer one was opened first."""
    return outer <= inner and elements[outer].end >= elements[inner].end


# -- the chain ----------------------------------------------------------------


class Chain:
    """Weights of a two-label chain: ``unary`` (features by labels), ``step`` (labels by labels)."""

    def __init__(self, unary: np.ndarray, step: np.ndarray):
        self.unary, self.step = unary, step

    def decode(self, features: list[list[int]]) -> list[bool]:
        """Viterbi."""
        if not features:
            return []
        w = self.unary
        scores = [w[f].sum(axis=0).tolist() for f in features]
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = scores[0]
        back: list[tuple[int, int]] = []
        for x, y in scores[1:]:
            p, q = int(b + t10 > a + t00), int(b + t11 > a + t01)
            a, b = (b + t10 if p else a + t00) + x, (b + t11 if q else a + t01) + y
            back.append((p, q))
        at = int(b > a)
        out = [at]
        for pq in reversed(back):
            at = pq[at]
            out.append(at)
        return [bool(x) for x in reversed(out)]


def _add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


class Labelled:
    """Labelled pages, padded: features, labels and which blocks are there."""

    def __init__(self, pages: list[tuple[list[list[int]], list[bool]]], k: int):
        longest, n = max(len(y) for _, y in pages), len(pages)
        x = np.zeros((n, longest, k), np.float32)
        y = np.zeros((n, longest), np.int64)
        self.there = np.zeros((n, longest), bool)
        for i, (fs, ys) in enumerate(pages):
            for j, (f, v) in enumerate(zip(fs, ys)):
                x[i, j, f], y[i, j], self.there[i, j] = 1, v, True
        self.n, self.longest, self.k, self.flat = n, longest, k, x.reshape(-1, k)
        self.gold = np.eye(2)[y] * self.there[..., None]
        self.pairs = self.there[:, 1:]
        self.gold_step = np.einsum("nta,ntb,nt->ab", self.gold[:, :-1], self.gold[:, 1:], self.pairs)

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The log likelihood of the labels, summed over pages, and its gradient, by forward and backward sums."""
        n, longest, k, there, pairs = self.n, self.longest, self.k, self.there, self.pairs
        unary, trans = w[: 2 * k].reshape(k, 2), w[2 * k :].reshape(2, 2)
        s = (self.flat @ unary.astype(np.float32)).reshape(n, longest, 2).astype(float) * there[..., None]
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = s[:, 0]
        for t in range(1, longest):
            to = _add(fwd[:, t - 1, :, None] + trans, 1) + s[:, t]
            fwd[:, t] = np.where(there[:, t, None], to, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            to = _add((bwd[:, t + 1] + s[:, t + 1])[:, None, :] + trans, 2)
            bwd[:, t] = np.where(there[:, t + 1, None], to, bwd[:, t + 1])
        z = _add(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + trans + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        g = np.r_[(self.flat.T @ (self.gold - p).reshape(-1, 2).astype(np.float32)).ravel(), (self.gold_step - edge.sum(axis=(0, 1))).ravel()]
        return float((self.gold * s).sum() + (self.gold_step * trans).sum() - z.sum()), g


def fit(pages: list[tuple[list[list[int]], list[bool]]], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam; all pages at once."""
    data = Labelled(pages, len(FEATURES))
    k = data.k
    w = np.zeros(2 * k + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = data.gradient(w)[1] / data.n - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(w[: 2 * k].reshape(k, 2).copy(), w[2 * k :].reshape(2, 2).copy())


# -- labelled pages -------------------------------------------------------------

#: Class names that say nothing.
UTILITY = ["row", "col-md-8", "c2", "xq1", "flex mt-4 px-2", "container", "wrapper", "w-full", "grid", "inner", "css-1a2b3c", "box", "left", "holder", "sc-bdVaJa", "u-pad", "block", "center", "view", "region"]


def labelled_pages(count: int, seed: int = 3, styles: tuple[str, ...] = ("semantic", "named", "mixed", "plain", "plain", "table")) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Invented pages with their blocks in order: (html, [(text, is main)])."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v ch th".split() for b in "a e i o u an er in on".split()]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def phrase(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def cued(kind: str, a: int, b: int, p: float = 0.6) -> str:
        return rng.choice(CUES[kind]).capitalize() + (" " + phrase(a, b).lower() if b and rng.random() < 0.7 else "") if rng.random() < p else phrase(max(a, 1), max(b, 2))

    def sentences(a: int, b: int) -> str:
        junk = rng.random() < 0.12
        marks = rng.choice([[" |"], ["***", "%%%", "!!", "###", "&&&"], [" |", " ·", "$$$"]])
        out = []
        for _ in range(rng.randint(a, b)):
            words = phrase(3, 18).split()
            if rng.random() < 0.4 and len(words) > 6:
                words[3] += ","
            if junk:
                words = [x + rng.choice(marks) for x in words]
            out.append(" ".join(words) + rng.choice(["."] * 4 + ["?", "!", ""]))
        text = " ".join(out)
        return text.upper() if rng.random() < 0.05 else text

    pages = []
    for _ in range(count):
        blocks: list[tuple[str, bool]] = []
        style = rng.choice(styles)
        tagged, classed = style in ("semantic", "mixed"), style in ("named", "mixed")
        bare = not tagged and not classed

        def put(text: str, main: bool) -> str:
            blocks.append((" ".join(text.split()), main))
            return entities.escape(text, quote=False)

        def attribute(kind: str | None) -> str:
            if kind and (classed or tagged and rng.random() < 0.5):
                return f' {rng.choice(["class", "id"])}="{rng.choice(NAMES[kind])}{rng.choice(["", "-" + word(), " " + word(), " " + rng.choice(UTILITY)])}"'
            return f' class="{rng.choice(UTILITY)}"' if rng.random() < 0.5 else ""

        def named(kind: str, *tags: str) -> tuple[str, str]:
            tag = rng.choice(tags)
            return f"<{tag}{attribute(kind)}>", f"</{tag}>"

        def links(low: int, high: int, tag: str = "li") -> str:
            text = lambda: cued("menu", 0, 2, 0.3) if rng.random() < 0.8 else phrase(3, 9)
            return "".join(f'<{tag}><a href="/{word()}">{put(text(), False)}</a></{tag}>' for _ in range(rng.randint(low, high)))

        def link_line() -> str:
            parts = [cued("menu", 0, 1, 0.4) for _ in range(rng.randint(3, 8))]
            bar = rng.choice([" | ", " · ", " » ", " "])
            put(bar.join(parts), False)
            return bar.join(f'<a href="/{word()}">{entities.escape(x, quote=False)}</a>' for x in parts)

        def menu() -> str:
            a, b = ("<nav>", "</nav>") if tagged and rng.random() < 0.7 else named("menu", "div", "ul") if not bare else named("menu", "div", "td" if style == "table" else "div")
            if rng.random() < 0.3 or style == "table":
                return a + link_line() + b
            return a + "<ul>" + links(3, 8) + "</ul>" + b

        def advert() -> str:
            a, b = named("advert", "div", "section", "aside" if tagged else "div")
            if bare:
                return a + rng.choice([lambda: put(cued("advert", 1, 4, 1.0), False), lambda: f'<a href="//{word()}">{put(phrase(3, 9), False)}</a>'])() + b
            return a + put(rng.choice([phrase(2, 5), sentences(1, 2), cued("advert", 0, 4)]), False) + b

        def notice() -> str:
            a, b = named("notice", "div", "section", "dialog" if tagged else "div")
            text = cued("notice", 4, 12, 1.0 if bare else 0.5)
            text = text if bare else rng.choice([text, sentences(1, 2)])
            return a + rng.choice(["<p>{}</p>", "{}"]).format(put(text, False)) + (f"<button>{put(phrase(1, 2), False)}</button>" if rng.random() < 0.6 else "") + b

        def side() -> str:
            a, b = ("<aside>", "</aside>") if tagged and rng.random() < 0.7 else named("side", "div", "section")
            top = f"<h3>{put(cued('related', 0, 3, 0.9 if bare else 0.5), False)}</h3>" if rng.random() < 0.9 or bare else ""
            if bare or rng.random() < 0.6:
                return a + top + f"<ul>{links(2, 6)}</ul>" + b
            return a + top + f"<p>{put(sentences(1, 3), False)}</p>" + b

        def form() -> str:
            if rng.random() < 0.6 or bare:
                return f"<form action='/x'>{put(phrase(1, 4), False)}<input name=q><button>{put(phrase(1, 2), False)}</button></form>"
            a, b = named("form", "div")
            return a + put(phrase(2, 6), False) + b

        def comments() -> str:
            a, b = named("comment", "div", "section")
            inner = f"<h2>{put(cued('comment', 0, 2, 1.0 if bare else 0.5), False)}</h2>" if rng.random() < 0.7 or bare else ""
            for _ in range(rng.randint(1, 5)):
                deep = rng.randint(0, 2)
                inner += "<div>" * deep
                if rng.random() < 0.7:
                    inner += f"<div{attribute('comment')}>{put(phrase(1, 2), False)}<p>{put(sentences(1, 4), False)}</p></div>"
                else:
                    inner += f"<p>{put(sentences(1, 3), False)}</p>"
                inner += "</div>" * deep
            return a + inner + b

        def share() -> str:
            a, b = named("share", "div", "p", "ul")
            return a + put(cued("share", 0, 3, 0.9 if bare else 0.5), False) + b

        def cells(rows: int) -> str:
            width = rng.randint(2, 4)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{put(rng.choice([phrase(1, 3), str(rng.randint(1, 999))]), True)}</td>" for _ in range(width)) + "</tr>" for _ in range(rows)) + "</table>"

        def body(title: bool) -> str:
            broken = rng.random() < 0.3
            out = ""
            if title:
                own = f"<h1>{put(phrase(2, 12), True)}</h1>"
                out = rng.choice([own, own, own, f"<div{attribute(None)}>{own}</div>", f"<header>{own}</header>" if tagged else own])
                if rng.random() < 0.1:
                    out += share()
            n = rng.randint(1, 14)
            for i in range(n):
                kind = rng.random()
                if kind < 0.08 and i + 1 < n:
                    tag = rng.choice(["h2", "h2", "h3"])
                    out += f"<{tag}>{put(phrase(1, 6), True)}</{tag}><p>{put(sentences(1, 4), True)}</p>"
                elif kind < 0.12 and i:
                    tag = rng.choice(["ul", "ol"])
                    out += f"<{tag}>" + "".join(f"<li>{put(rng.choice([phrase(1, 12), sentences(1, 2)]), True)}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
                elif kind < 0.15:
                    out += f"<blockquote>{put(sentences(1, 2), True)}</blockquote>"
                elif kind < 0.17 and i:
                    out += f"<figure><img src=x><figcaption>{put(phrase(2, 9) + rng.choice(['', '.']), True)}</figcaption></figure>"
                elif kind < 0.185 and i:
                    out += cells(rng.randint(1, 4))
                elif kind < 0.2 and i:
                    out += f"<pre>{put(' '.join(word() + rng.choice([' = ', '();', ' {']) for _ in range(4)), True)}</pre>"
                elif kind < 0.23 and i:
                    out += rng.choice([advert, share, notice])()
                elif broken and kind < 0.45:
                    out += f"<p><b>{put(sentences(1, 3), True)}<br>"
                elif kind < 0.5:
                    out += f"<p>{put(phrase(1, 5) + rng.choice(['.', '.', '']), True)}</p>"
                else:
                    text = put(sentences(1, 6), True)
                    out += f"<p>{text}</p>" if kind < 0.9 or "&" in text[:14] else f"<p><a href='/{word()}'>{text[:12]}</a>{text[12:]}</p>"
            return out

        def nested(inner: str, depth: int) -> str:
            for _ in range(depth):
                tag = rng.choice(["div", "div", "section", "center" if bare else "div"])
                inner = f"<{tag}{attribute(None)}>{inner}</{tag}>"
            return inner

        def main() -> str:
            title = rng.random() < 0.85
            outside = title and rng.random() < 0.2  # the title directly above the container
            top = f"<h1>{put(phrase(2, 12), True)}</h1>" if outside else ""
            r = rng.random()
            if tagged and r < 0.6:
                inner = f"<article{attribute('main') if classed else ''}>{body(title and not outside)}{comments() if rng.random() < 0.15 else ''}" + ("</article>" if rng.random() < 0.9 else "")
            elif tagged and r < 0.75:
                inner = f"<main>{body(title and not outside)}</main>"
            elif classed and r < 0.8:
                a, b = named("main", "div", "section")
                inner = a + body(title and not outside) + b
            else:
                inner = f"<div{attribute(None)}>{body(title and not outside)}</div>" if rng.random() < 0.85 else body(title and not outside)
            return top + nested(inner, rng.randint(0, 3))

        def footer() -> str:
            a, b = ("<footer>", "</footer>") if tagged and rng.random() < 0.8 else named("bottom", "div", "p", "center" if bare else "div")
            text = rng.choice(["© ", "" if not bare else "© ", "Copyright " if bare else ""]) + phrase(2, 8) + rng.choice(["", ".", " · " + sentences(1, 1)])
            return a + put(text, False) + (links(1, 3, "p") if rng.random() < 0.3 else "") + b

        def header() -> str:
            a, b = ("<header>", "</header>") if tagged and rng.random() < 0.7 else named("top", "div")
            name = f'<a href="/">{put(phrase(1, 3), False)}</a>' if bare or rng.random() < 0.5 else put(phrase(1, 4), False)
            return a + name + (menu() if rng.random() < 0.5 else "") + b

        def some(f, p: float) -> str:
            return f() if rng.random() < p else ""

        def all_of(*parts: str) -> str:
            return "".join(parts)

        head = "<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>if(a<b){t('</p>')}</script></head>"
        own = f' class="{rng.choice(["has", "with", "no"])}-{rng.choice(NAMES[rng.choice(["side", "comment", "menu", "top", "advert", "notice"])])} {word()}"' if rng.random() < 0.4 else ""
        if style == "table":
            page = f"<body{own}><table><tr><td colspan=2>" + all_of(some(header, 0.6), some(menu, 0.5)) + "</td></tr><tr>"
            left = rng.random() < 0.5
            if left:
                page += "<td>" + all_of(menu(), some(side, 0.4)) + "</td>"
            page += "<td>" + all_of(main(), some(share, 0.15), some(comments, 0.2)) + "</td>"
            if not left:
                page += "<td>" + all_of(some(side, 0.7), some(advert, 0.4)) + "</td>"
            page += "</tr><tr><td>" + some(footer, 0.9) + "</td></tr></table></body>"
        else:
            inner = all_of(some(header, 0.5), some(menu, 0.6), some(notice, 0.25), some(form, 0.2), some(advert, 0.4), some(side, 0.15))
            inner += all_of(main(), some(share, 0.15), some(comments, 0.3), some(side, 0.3), some(advert, 0.2), some(form, 0.2), some(footer, 0.85), some(notice, 0.1))
            if rng.random() < 0.15:
                inner = f"<form action='/page'>{inner.replace('<form ', '<div ').replace('</form>', '</div>')}</form>"
            page = f"<body{own}>{nested(inner, rng.randint(0, 2)) if rng.random() < 0.4 else inner}</body>"
        pages.append((head + page + "</html>", blocks))
    return pages


@lru_cache(maxsize=2)
def trained(count: int = 500, seed: int = 3) -> Chain:
    data = []
    for page, truth in labelled_pages(count, seed):
        found = parsed(page)
        if [b.text for b in found[0]] == [t for t, _ in truth]:
            data.append((described(found), [m for _, m in truth]))
    return fit(data)


def main_text(page: str, chain: Chain) -> str:
    found = parsed(page)
    return "\n\n".join(b.text for b, keep in zip(found[0], chain.decode(described(found))) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """``pages`` without the html, with the main text."""
    chain = chain or trained()
    kept = [c for c in without(pages, text_col).columns if c != html_col]
    out = T.StructType([*pages.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x, chain) if x else "" for x in strings(part.column(len(kept)))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text_col])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").cast("string")).mapInArrow(run, out)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
