"""Web pages as sequences of text blocks with their structural context.

Blocks are the stretches of text between block-level tags or line breaks; inline tags do not split.
The parser is lenient: unclosed ``li``, ``p``, ``td``, ``tr`` and stray end tags are repaired.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg math iframe object textarea select option head title".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "p": ({"p"}, {"div", "td", "th", "li", "article", "section", "main", "blockquote", "body", "aside", "form", "figure"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[^\s>=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?|\s|/)*)>", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WS = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node(NamedTuple):
    tag: str
    key: str  # id, class or role, with generated hashes removed
    serial: int
    hidden: bool


class Block(NamedTuple):
    text: str
    path: tuple[Node, ...]
    linked: int  # characters within links
    order: int
    bold: bool  # whole text within b, strong or a font tag


_HEXED = re.compile(r"(?<![a-zA-Z])(?:[a-zA-Z]+-)?[0-9a-f]{5,}$")


def _key(attrs: dict[str, str]) -> str:
    return " ".join(x for k in ("id", "class", "role") for x in attrs.get(k, "").lower().split())


_ROOT = (Node("html", "", -2, False), Node("body", "", -1, False))


def blocks(source: str) -> list[Block]:
    out: list[Block] = []
    stack: list[Node] = []
    buf: list[str] = []
    linked = 0
    links = 0
    strong = strong_chars = 0
    at = 0
    serial = 0
    n = len(source)

    def flush() -> None:
        nonlocal buf, linked, strong_chars
        if buf:
            t = _WS.sub(" ", "".join(buf).replace("\xa0", " ")).strip()
            if t:
                # Every path starts at one html and one body, written or not.
                inner = tuple(n for n in stack if n.tag not in ("html", "body"))
                out.append(Block(t, _ROOT + inner, linked, len(out), strong_chars >= len(t) * 0.9))
            buf, linked, strong_chars = [], 0, 0

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return

    while at < n:
        m = _TAG.search(source, at)
        stop = m.start() if m else n
        if stop > at:
            t = html.unescape(source[at:stop]) if "&" in source[at:stop] else source[at:stop]
            buf.append(t)
            if links:
                linked += len(t)
            if strong:
                strong_chars += len(t)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in ("b", "strong"):
                    strong = max(0, strong - 1)
                continue
            flush()
            links = 0
            pop(tag)
            continue
        if tag in SKIP:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            flush()
            if tag in ("head",) and not end:
                continue
            at = end.end() if end else (at if tag == "head" else n)
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links += 1
            if tag in ("b", "strong"):
                strong += 1
            continue
        flush()
        links = strong = 0
        if tag in VOID:
            continue
        if tag in _CLOSES:
            same, bound = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in bound:
                    break
        if tag in _P_ENDERS and stack and stack[-1].tag == "p":
            stack.pop()
        attrs = {}
        if m.group(3) and m.group(3).strip():
            attrs = {a.group(1).lower(): html.unescape(a.group(2) or a.group(3) or a.group(4) or "") for a in _ATTR.finditer(m.group(3))}
        serial += 1
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
        stack.append(Node(tag, _key(attrs), serial, hidden))
    flush()
    return out
