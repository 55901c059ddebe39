"""Text normalisation and word n-grams under Python's Unicode classes."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, functions as F

_NOT_WORD = re.compile(r"[^\w\s]")
# No plane beyond the second has combining marks.
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x20000)) if unicodedata.combining(c)) + "]+")


def normalize_one(text: str | None) -> str | None:
    """NFD, combining marks dropped, lower case, other than word characters and white space to a
    space, white space collapsed and stripped.  Null gives null."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = _MARKS.sub("", text)
    return " ".join(_NOT_WORD.sub(" ", text.lower()).split())


@lru_cache(maxsize=500_000)
def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``n``-word sequences of a normalised text; empty if
    it has fewer than ``n`` words."""
    ws = text.split()
    if len(ws) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(word_hash, ws)), dtype=np.uint64)
    acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        acc = mix64(acc * _MIX[i % 5] + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


class TokenWords(dict):
    """Tokens between white space, numbered; a number stands for the hashes of the token's normalised words.

    Normalisation looks at nothing beyond white space, so a token is normalised once, wherever it stands."""

    #: Characters and words kept.
    MOST = 16_000_000

    def __init__(self) -> None:
        self.first, self.hashes, self.held = array("q", [0]), array("Q"), 0

    def __missing__(self, token: str) -> int:
        words = normalize_one(token).split()
        self.hashes.extend(map(xxhash.xxh3_64_intdigest, [w.encode("utf-8", "surrogatepass") for w in words]))
        self.first.append(len(self.hashes))
        self.held += len(token) + 8 * len(words) + 100
        self[token] = len(self)
        return len(self) - 1

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of all texts, end to end, and how many each text has."""
        if self.held > self.MOST:
            self.clear()
            self.__init__()
        tokens = [t.split() for t in texts]
        each = np.array([len(t) for t in tokens], dtype=np.int64)
        code = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), np.int64, int(each.sum()))
        first, hashes = np.array(self.first, dtype=np.int64), np.array(self.hashes, dtype=np.uint64)
        n = first[code + 1] - first[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        stops = np.cumsum(each)
        return hashes[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])], ends[stops] - ends[stops - each]


def shingle_sets(texts: list[str | None], known: TokenWords, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_hashes` of the normalised texts, end to end, and the size of each; null has none."""
    h, words = known.of([t or "" for t in texts])
    size = np.maximum(words - n + 1, 0)
    if not size.sum():
        return np.zeros(0, dtype=np.uint64), size
    acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        acc = mix64(acc * _MIX[i % 5] + h[i : len(h) - n + 1 + i])
    stops = np.cumsum(size)
    flat = acc[np.repeat(np.cumsum(words) - words - (stops - size), size) + np.arange(stops[-1])]
    for a, e in zip((stops - size).tolist(), stops.tolist()):
        flat[a:e].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(stops - size)[size > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return flat[new], total[stops] - total[stops - size]


def normalize_text(col: Column | str) -> Column:
    """Arrow-batched :func:`normalize_one`; Spark has no built-in canonical decomposition."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(normalize_one)

    return run(F.col(col) if isinstance(col, str) else col)
