"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies a
block alone, by its length, its density of stop words and its density of link
text: good, near good, short or bad. The second pass decides the near good and
short ones by the nearest decided blocks on both sides.

Tags, classes, ids and roles are features of a block. Parts of menus, footers, asides, forms, notices, adverts and
reader comments are bad in the first pass; an article or main element, or a sentence's end, makes a block of few stop words near good
instead of bad, a line of rights (c) a class lower, and an article or main element that holds most of the good text
hands no label to what lies outside. Where the page names no article, its edges are bad neighbours of what ends no sentence. Where a page's language has no stop word list, the ends of sentences stand in for the density.

Scanning takes time linear in the page, whatever its tags look like.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_rows, texts_of

LINKS_HIGH, LENGTH_LOW, LENGTH_HIGH = 0.4, 60, 180
STOPS_LOW, STOPS_HIGH = 0.1, 0.2
#: Blocks to either side in which a heading looks for a good block.
HEADING_REACH = 6
#: Blocks by which a good neighbour may be farther than a bad one for a short block that ends a sentence.
SENTENCE_LEAD = 1
#: Share of a page's good text from which an element is its wrapper, whatever its class says.
WRAPPER = 0.9
#: Density of stop words in a page's longer blocks below which its language is taken to have no list.
FOREIGN = 0.05

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all we when there can more if no so what".split()
    + "le la les de des du un une et est en que qui dans pour pas sur au avec il elle ce se ne par plus aux son sa ses ou mais".split()
    + "der die das und ist den dem des ein eine einen zu im auf mit sich nicht von als auch es an er sie so dass wir aus bei nach wie".split()
    + "el los las del y que una por con no para su es al lo como mas pero sus este ya o fue ha si porque esta son entre cuando muy sin sobre".split()
)
# Element names by what they mean here.
DROPPED = frozenset("script style noscript template svg canvas math object iframe head select textarea button audio video map datalist".split())
NOT_ARTICLE = frozenset("nav footer aside menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
# Words in class, id or role that mark a part as no article.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
HINTS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs pager pagination footer masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription signup login search searchbox widget complementary contentinfo dialog".split()
)
# Words that may follow such a word in one name, and words that turn it into a trait of something else.
PARTS = frozenset("list lists box boxes bar bars block blocks section area wrap wrapper container inner outer left right top bottom post posts item items link links button buttons form panel unit slot text message body content group row col column holder".split())
TRAITS = frozenset("has have no not with without is".split())
HEADER_HINTS = frozenset("header head site-header page-header".split())
_NAME_OF_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9][0-9x]*")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HUGE = re.compile(r"&#[0-9]{8,};?")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_SENTENCE = re.compile(r"[.!?;:\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4]")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    heading: bool
    inside: bool  # in an article or main element
    barred: bool  # in a part that is marked as no article
    hint: int = -1  # the innermost element around it, up to an article or main element, whose class, id or role says no article


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all code points become U+FFFD."""
    return html.unescape(_HUGE.sub("\ufffd", text)) if "&" in text else text


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """(a name says no article, a name says reader comments, a name says header) for the attributes of a tag.

    A name counts as a whole: it ends in such a word, or in one followed by words for a part or a number, and says nothing of having or lacking it.
    """
    hint = comments = header = False
    for m in _ATTR.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = _WORDS.findall(_CAMEL.sub(" ", token).lower())
            while words and words[-1] not in HINTS and (words[-1] in PARTS or words[-1][0].isdigit()):
                words.pop()
            if words and words[-1] in HINTS and not TRAITS & set(words):
                hint, comments = True, comments or bool(COMMENTS & set(words))
            header |= token.lower() in HEADER_HINTS or (m[1].lower() == "role" and token.lower() == "banner")
    return hint, comments, header


class _Tags:
    """The tags of a page from left to right."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes, self.ends = page, True, True

    def after(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name, attributes) of the next tag: name '/x' closes, '' is a comment or declaration, '[' is marked text. None: no further tag."""
        page = self.page
        while self.ends and (lt := page.find("<", at)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                return lt, len(page) if end < 0 else end + 3, "", ""
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                return (lt, len(page), "[", page[lt + 9 :]) if end < 0 else (lt, end + 3, "[", page[lt + 9 : end])
            m = _NAME_OF_TAG.match(page, lt + 1)
            if m is None and page[lt + 1 : lt + 2] not in ("!", "?"):
                at = lt + 1
                continue
            end = self._end(m.end() if m else lt + 1)
            if end < 0:
                self.ends = False  # nothing closes a tag any more: the rest is text
                break
            return (lt, end + 1, "/" * (page[lt + 1] == "/") + m[1].lower(), page[m.end() : end]) if m else (lt, end + 1, "", "")
        return None

    def _end(self, at: int) -> int:
        """The place of the tag's closing mark; marks in quotes do not close it, as long as quotes are sound on this page."""
        page, spot = self.page, at
        while self.quotes:
            m = _QUOTE_OR_END.search(page, spot)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                spot = page.find(m[0], m.end()) + 1
                self.quotes = spot > 0
        return page.find(">", at)


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """(blocks of a page in order, parent of each hinted element or -1). Unclosed and stray tags are tolerated; comments and raw elements give no text."""
    out: list[Block] = []
    parents: list[int] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, barred, inside, hint
    open_ = Counter()  # how often each name is on the stack
    parts: list[str] = []
    links = depth_a = breaks = 0
    heading = False

    def flush() -> None:
        nonlocal parts, links, breaks
        text = " ".join(unescaped("".join(parts)).split()) if parts else ""
        if text:
            barred, inside, hint = stack[-1][1:] if stack else (False, False, -1)
            out.append(Block(text, links, heading, inside, barred, hint))
        parts, links, breaks = [], 0, 0

    def add(text: str) -> None:
        nonlocal links, breaks
        if text:
            parts.append(text)
            if depth_a:
                links += len(" ".join(text.split()))
            if not text.isspace():
                breaks = 0

    def close(name: str, until: frozenset[str] = frozenset()) -> None:
        """Take the innermost element of this name off the stack, unless one of ``until`` lies inside it."""
        if open_[name]:
            i = len(stack) - 1
            while stack[i][0] != name:
                if stack[i][0] in until:
                    return
                i -= 1
            open_.subtract(e[0] for e in stack[i:])
            del stack[i:]

    tags, at, n = _Tags(page), 0, len(page)
    while at < n:
        found = tags.after(at)
        if found is None:
            add(page[at:])
            break
        start, end, name, attributes = found
        add(page[at:start])
        at = end
        if name == "[":
            add(html.escape(attributes, quote=False))
        if name in ("", "[", "/"):
            continue
        closing, name = name[0] == "/", name.lstrip("/")
        if name == "br" and not closing:
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name == "a":
            depth_a = max(0, depth_a + (-1 if closing else 1))
            continue
        if name in BLOCK or name in DROPPED:
            flush()
            depth_a = 0
        if closing:
            close(name)
            if name in HEADINGS:
                heading = False
            continue
        if name in RAW or name in DROPPED and name not in ("head", "select", "object", "map", "datalist", "audio", "video", "svg", "canvas", "math", "button"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in ("p", "li"):  # an open one ends here
            close(name, CONTAINERS)
        if name in BLOCK or name in DROPPED or name in ("span", "ins"):
            if name == "body":
                close("head")
            barred, inside, hint = stack[-1][1:] if stack else (False, False, -1)
            says, comments, header = _named(attributes) if attributes else (False, False, False)
            if name in ("article", "main"):
                inside, hint = True, -1
            if name in NOT_ARTICLE or name in DROPPED or name == "header" and not inside or attributes and _HIDDEN.search(attributes):
                barred = True
            elif comments and name not in ("html", "body", "main"):
                barred = True
            elif name not in ("html", "body", "article", "main") and (says or name == "form" or header and not inside):
                parents.append(hint)
                hint = len(parents) - 1
            stack.append((name, barred, inside, hint))
            open_[name] += 1
            if name in HEADINGS:
                heading = True
            elif name in BLOCK:
                heading = False
    flush()
    return out, parents


CONTAINERS = frozenset("ul ol div article section main td body blockquote".split())


def density(text: str) -> float:
    """Share of stop words among the words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()%&*$#|") in STOP_WORDS for w in words) / max(1, len(words))


def alone(b: Block, stops: float) -> str:
    """First pass: the class of a block by itself; ``stops`` is its density of stop words, or what stands in for it. A rights line outside of an article is a class lower."""
    if b.barred or b.links > LINKS_HIGH * max(1, len(b.text)):
        return "bad"
    rights = not b.inside and _RIGHTS.match(b.text) is not None
    if len(b.text) < LENGTH_LOW:
        return "bad" if b.links and not b.inside or rights else "short"
    if rights:
        return "near" if stops >= STOPS_HIGH and len(b.text) > LENGTH_HIGH else "bad"
    if stops >= STOPS_HIGH:
        return "good" if len(b.text) > LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW or b.inside or _SENTENCE.search(b.text) else "bad"


def _densities(found: list[Block]) -> list[float]:
    """Densities of stop words; where the page's language has no list, what ends sentences counts as high."""
    of = [density(b.text) if len(b.text) >= LENGTH_LOW and not b.barred else 0.0 for b in found]
    plain = [i for i, b in enumerate(found) if len(b.text) >= LENGTH_LOW and not b.barred and b.links <= LINKS_HIGH * len(b.text)]
    size = sum(len(found[i].text) for i in plain)
    if size and sum(of[i] * len(found[i].text) for i in plain) < FOREIGN * size:
        return [STOPS_HIGH if _SENTENCE.search(b.text) else STOPS_LOW / 2 for b in found]
    return of


def inherited(found: list[Block], first: list[str], edge: list[bool], marked: bool = False) -> list[str]:
    """Second pass: near good and short blocks take the label of their nearest decided neighbours. Blocks with ``edge`` are nobody's neighbour; for short ones that end no sentence the page's edges are bad neighbours, unless the article is ``marked``."""
    decided = [i for i, c in enumerate(first) if c in ("good", "bad") and not edge[i]]
    hopeful = any(c in ("good", "near") for c in first)
    label = list(first)
    for i, c in enumerate(first):
        if c not in ("short", "near"):
            continue
        at = bisect.bisect_left(decided, i)
        sides = [j for j in (decided[at - 1 : at] + decided[at : at + 1])]
        good, bad = [j for j in sides if first[j] == "good"], [j for j in sides if first[j] == "bad"]
        if found[i].heading and any(x in ("good", "near") for x in first[i + 1 : i + 1 + HEADING_REACH]):
            label[i] = "good"
        elif not sides:
            label[i] = "good" if hopeful or found[i].inside or _SENTENCE.search(found[i].text) else "bad"
        elif c == "near":
            label[i] = "good" if good or found[i].inside else "bad"
        else:
            ends = _SENTENCE.search(found[i].text[-1:]) is not None
            edges = [] if marked or ends else [i + 1, len(first) - i]
            nowhere = 2 * len(first)
            near = min([abs(j - i) for j in good], default=nowhere)
            far = min([*edges, *[abs(j - i) for j in bad]], default=nowhere)
            label[i] = "good" if near < far + (SENTENCE_LEAD if ends else 0) + found[i].inside else "bad"
    return label


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty for null pages and pages without any."""
    if not page:
        return ""
    found, parents = blocks(page)
    stops = _densities(found)
    first = [alone(b, d) for b, d in zip(found, stops, strict=True)]
    if parents:  # a hinted element is bad unless it holds nearly all of what may be text
        held, names = [0] * len(parents), list(range(len(parents)))
        for b, c in zip(found, first, strict=True):
            if b.hint >= 0 and c in ("good", "near"):
                held[b.hint] += len(b.text)
        for i in reversed(names):
            if parents[i] >= 0:
                held[parents[i]] += held[i]
        most = max(1, WRAPPER * sum(len(b.text) for b, c in zip(found, first, strict=True) if c in ("good", "near")))
        bad = [False] * len(parents)
        for i in names:
            bad[i] = held[i] < most or parents[i] >= 0 and bad[parents[i]]
        for b in found:
            b.barred |= b.hint >= 0 and bad[b.hint]
        stops = _densities(found)
        first = [alone(b, d) for b, d in zip(found, stops, strict=True)]
    within = sum(len(b.text) for b, c in zip(found, first, strict=True) if b.inside and c != "bad")
    outside = sum(len(b.text) for b, c in zip(found, first, strict=True) if c == "good" and not b.inside)
    marked = within > 0 and within >= outside
    if marked:  # the page shows where its article is: outside of it nothing is inherited
        first = [c if b.inside or c == "good" else "bad" for b, c in zip(found, first, strict=True)]
    label = inherited(found, first, [b.barred or marked and not b.inside for b in found], marked)
    return "\n".join(b.text for b, c in zip(found, label, strict=True) if c == "good")


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Append ``text``, the main text of each whole page (empty where there is none).

    Null and empty pages give an empty text, a page of any length is read whole, repeated rows stay; a column named like
    ``text`` is replaced, the others stay. No shuffle.
    """
    at = pages.columns.index(page)

    def make():
        def fn(batch: pa.RecordBatch):
            return [pa.array([main_text(x) for x in texts_of(batch, at)], pa.string())]

        return fn

    return map_rows(pages, make, [field(text, T.StringType())], page)
