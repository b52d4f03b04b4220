"""Cut HTML into lines: the text of block elements in page order, each with what surrounds it.

One pass over tags with an explicit stack, so that depth, unclosed tags and junk
do no harm.  Nothing here recurses.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

#: Elements whose content is no markup, or no text to read.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements, roles and name parts that hold no main text.
ASIDE = frozenset("nav header footer aside form menu dialog button select option fieldset head audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notification alert signup login form search share sharing social "
    "related recommended recommendations teaser pagination pager copyright disclaimer toolbar skip review reviews".split()
)
#: Those of adverts and consent, which seldom name anything else, and those of what readers wrote.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription".split())
READERS = frozenset("comment comments reply replies disqus discussion respond".split())
MAIN = frozenset(("article", "main"))
#: Elements that make up running text; all others are boxes that hold it.
TEXT = INLINE | frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th figure figcaption hr address details summary center".split())
#: Box of the page itself.
PAGE = 0


@dataclass
class Line:
    text: str
    linked: int  # characters inside of links
    mark: int  # number of the outermost article or main element around it, 0 if there is none
    aside: bool  # of what holds no main text
    box: int  # number of the nearest element around it that is no part of running text


#: What an element says of itself: that it holds main text; by its names perhaps none, or hardly any; that it holds none.
HOLDS, MAYBE, HARDLY, NONE = range(4)
#: An element holds main text for all its names if it has this share of the page's text outside of links.
SHARES = {MAYBE: 1 / 3, HARDLY: 0.9}


def _aside(tag: str, attrs: str, inside: bool) -> int:
    if tag in ASIDE and not (tag == "header" and inside):
        return NONE
    if not attrs or tag in ("body", "html", "main"):
        return HOLDS
    found = HOLDS
    readers = others = False
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return NONE
        if name == "role" and value in ROLES:
            return NONE
        if name in ("class", "id"):
            for word in (w.rstrip("/") for w in value.split()):
                if word in READERS:  # an article may be a reader's comment
                    return NONE
                parts = {word, *re.split(r"[-_]+", word)}
                if word not in ADVERTS | NAMES and (tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (inside and "header" in word)):
                    others = True  # of a paragraph or a heading only a whole name counts
                elif word in ADVERTS:
                    found = max(found, HARDLY)
                elif parts & (NAMES | ADVERTS):
                    found = max(found, MAYBE)
                elif parts & READERS:
                    readers = True
                else:
                    others = True
    return (MAYBE if others else NONE) if readers else found


def lines(page: str | None) -> list[Line]:
    """The lines of a page.

    No class or id alone takes text away but those of readers' comments: an element
    that its names speak against holds main text all the same if it has its share
    (``SHARES``) of the page's text.
    """
    out: list[Line] = []
    if not page:
        return out
    spans: list[tuple[int, int, int]] = []  # of each element that perhaps holds none: what it says, its first line, the line after its last
    stack: list[tuple[str, int, int, int]] = []  # tag, what it holds, its number, lines before it
    open_tags: Counter = Counter()
    asides = links = linked = made = 0
    mains: list[int] = []
    boxes = [PAGE]
    buffer: list[str] = []

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append(Line(text, min(linked, len(text)), mains[0] if mains else 0, asides > 0, boxes[-1]))
            buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal asides, links
        tag, holds, number, before = stack.pop()
        open_tags[tag] -= 1
        asides -= holds == NONE
        links -= tag == "a"
        if holds in SHARES:
            spans.append((holds, before, len(out)))
        for kept in (mains, boxes):
            if kept and kept[-1] == number:
                kept.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = max(m.end(), at + 1)
        if (text := m["text"]) is not None:
            buffer.append(text)
            if links:
                linked += len(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if m["end"]:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:  # a slash ends no other element
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag == "body":  # ends a head that was left open
            while stack and stack[-1][0] != "html":
                pop()
        holds = _aside(tag, m["attrs"], bool(mains))
        made += 1
        stack.append((tag, holds, made, len(out)))
        open_tags[tag] += 1
        asides += holds == NONE
        links += tag == "a"
        if tag in MAIN:
            mains.append(made)
        if tag not in TEXT and tag not in ("html", "body"):
            boxes.append(made)
    flush()
    while stack:
        pop()
    upto = [0]
    for x in out:
        upto.append(upto[-1] + (0 if x.aside else max(0, len(x.text) - 2 * x.linked)))
    covered = [0] * (len(out) + 1)  # elements that hold no main text: how many more begin at a line than end there
    for holds, a, b in spans:
        if b > a and upto[b] - upto[a] < max(1, SHARES[holds] * upto[-1]):
            covered[a] += 1
            covered[b] -= 1
    around = 0
    for x, c in zip(out, covered, strict=False):
        around += c
        x.aside |= around > 0
    return out


def plain_text(page: str | None) -> str:
    """All text that a reader sees, a line for each block."""
    return "\n".join(x.text for x in lines(page))
