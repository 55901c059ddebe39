"""Plain text of HTML pages: blocks apart by blank lines, white space collapsed, list items bulleted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

_SKIP = {"head", "script", "style", "noscript", "template", "svg", "iframe"}
_BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SPACE = re.compile(r"\s+")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.lines: list[tuple[str, str]] = []
        self.prefix = ""
        self.skip = 0
        self.depth = 0

    def end_block(self, kind: str = "block") -> None:
        t = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if t:
            self.lines.append((kind, self.prefix + t))
            self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag == "br":
            self.end_block("line")
        elif tag in _BLOCK:
            self.end_block()
            if tag in ("ul", "ol"):
                self.depth += 1
            if tag == "li":
                self.prefix = "  " * max(1, self.depth) + "• "

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK:
            self.end_block("item" if tag == "li" else "block")
            if tag in ("ul", "ol"):
                self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def extract(source: str) -> str:
    p = _Text()
    p.feed(source)
    p.close()
    p.end_block()
    out = ""
    for i, (kind, t) in enumerate(p.lines):
        if i:
            out += "\n" if p.lines[i - 1][0] in ("item", "line") and kind in ("item", "line") else "\n\n"
        out += t
    return out


def decode(raw: bytes) -> str:
    """Strict UTF-8, else the declared encoding, else the likelier of two one-byte tables, with
    replacement characters."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    m = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", raw, re.I)
    for c in ([m.group(1).decode("ascii", "replace")] if m else []) + ["gb18030", "cp1252"]:
        try:
            if c.lower() not in ("utf-8", "utf8"):
                t = raw.decode(c)
                if c != "gb18030" or len(re.findall("[一-鿿]", t)) * 4 > len(t):
                    return t
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp1252", errors="replace")


def extract_text(x: Column | str) -> Column:
    """Plain text of HTML bytes, in Arrow batches; null gives null."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda b: None if b is None else extract(decode(bytes(b))))

    return run(F.col(x) if isinstance(x, str) else x)
