"""Garbled text: candidate encode-decode chains, a smoothed character n-gram model, and repair.

A garbled string is ``original.encode(A).decode(B)`` with the wrong ``B``.  ``CHAINS`` lists the
``(B, A)`` pairs tried in reverse; chains may be repeated (text garbled twice) and may follow a
numeric character reference (``&#195;&#169;``).
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

# Wrong decoder B, true encoding A.
CHAINS: list[tuple[str, str]] = [
    ("cp1252", "utf-8"),
    ("latin-1", "utf-8"),
    ("cp437", "utf-8"),
    ("cp850", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp1251", "utf-8"),
    ("koi8-r", "utf-8"),
    ("cp1250", "utf-8"),
    ("gb18030", "utf-8"),
]
BYTE_CHAINS: list[tuple[str, str]] = [
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8-r"),
    ("cp1252", "gb18030"),
    ("cp437", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("mac_roman", "cp1251"),
    ("cp1251", "cp1252"),
    ("mac_roman", "cp1252"),
    ("cp1252", "mac_roman"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
]


def _decode_map(enc: str) -> dict[int, int]:
    """Characters that ``enc`` yields, mapped to the code point equal to their byte; undefined bytes
    map to themselves, as lenient decoders do."""
    out: dict[int, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    if enc == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


_MAPS = {b: _decode_map(b) for b in {x for x, _ in CHAINS + BYTE_CHAINS} if b != "gb18030"}

RUN = re.compile(r"[^\x00-\x7f]+(?:[ \t\xa0][^\x00-\x7f]+)*")
NONASCII = re.compile(r"[^\x00-\x7f]+")
NUMREF = re.compile(r"(?:&#(?:1[2-9]\d|2[0-5]\d|\d{3,5}|x[0-9a-fA-F]{2,4});){2,}")
# U+FFFD, C1 controls, or bytes of a broken decoding written as question-mark boxes.
BROKEN = re.compile(r"[�\x80-\x84\x86-\x9f]")


def undo(s: str, b: str, a: str) -> str | None:
    """The text that, encoded as ``a`` and decoded as ``b``, gives ``s``; None if there is none."""
    try:
        if b == "gb18030":
            return s.encode("gb18030").decode(a)
        return codecs.charmap_encode(s, "strict", _MAPS[b])[0].decode(a)
    except UnicodeError:
        return None


_PLAUSIBLE = re.compile(
    "[ -ɏЀ-џḀ-ỿ‐-‧‰-›€№™　-〟一-鿿＀-～"
    "←-⇿─-◿•]"
)


@lru_cache(maxsize=30_000)
def undo_utf8_run(run: str) -> str | None:
    """Reverse a UTF-8 text read as one-byte characters, for one run of non-ASCII characters."""
    for b, a in CHAINS[:8]:
        r = undo(run, b, a)
        if r is not None and len(r) < len(run):
            if all(_PLAUSIBLE.match(c) for c in r if c > "\x7f"):
                return r
            # Garbled twice: the first step back may leave controls that the second resolves.
            again = undo_utf8_run(r) if not r.isascii() else None
            if again is not None:
                return again
    return None


# Letters by descending frequency in Russian prose; fixed values.
_RU = {c: i for i, c in enumerate("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")}
_INVERTED = re.compile(r"(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}")


_CASE_BREAK = re.compile(r"[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]")


@lru_cache(maxsize=4096)
def _letter_value(c: str) -> float:
    if c.isalpha():
        k = _RU.get(c.lower())
        return -6.0 if k is None else 3 - 0.2 * k
    return -6.0 if c > "\x7f" else 0.0


def _ru_score(s: str) -> float:
    """Mean value of the letters as Russian prose, with a loss for capitals within words."""
    n, sc = _tally(Counter(s), _letter_value)
    return (sc - 4 * len(_CASE_BREAK.findall(s))) / max(n, 1)


def _tally(counts: Counter, value: Callable[[str], float | None]) -> tuple[int, float]:
    """How many characters have a value, and the sum of their values."""
    n, sc = 0, 0.0
    for c, k in counts.items():
        v = value(c)
        if v:
            n += k
            sc += k * v
    return n, sc


def _chain_values(b: str, a: str) -> dict[str, float | None]:
    """The letter value that each character gets by undoing ``b`` over ``a``, both one-byte tables."""
    out: dict[str, float | None] = {}
    for c, x in _MAPS[b].items():
        r = undo(chr(c), b, a)
        out[chr(c)] = None if r is None else _letter_value(r)
    return out


#: Chains that end in Cyrillic, with the values of their characters.
_CYRILLIC_CHAINS = [(b, a, _chain_values(b, a)) for b, a in BYTE_CHAINS if a in ("cp1251", "koi8-r", "cp866")]


def undo_single_byte(text: str) -> str | None:
    """Reverse Cyrillic or Chinese text read through a wrong one-byte table, for one paragraph."""
    s = " ".join(NONASCII.findall(text))
    if len(s) < 8 or re.search(r"[一-鿿]", s):
        return None
    r = undo_lines(text, "cp1252", "gb18030")
    if r is not None and len(re.findall("[一-鿿]", r)) > 0.3 * len(r.replace("\n", "")):
        return r
    counts = Counter(s)
    n, sc = _tally(counts, _letter_value)
    best, best_score = None, (sc - 4 * len(_CASE_BREAK.findall(s))) / max(n, 1) + (0.1 if _INVERTED.search(s) else 0.7)
    for b, a, values in _CYRILLIC_CHAINS:
        # Without the loss for capitals, which needs the text itself, a chain's score can only be higher.
        if any(values.get(c) is None for c in counts):
            continue
        n, sc = _tally(counts, values.__getitem__)
        if sc / max(n, 1) > best_score and (r := undo(s, b, a)) is not None and (sc := _ru_score(r)) > best_score:
            best, best_score = (b, a), sc
    if best is None or best_score < 0.4:
        return None
    return NONASCII.sub(lambda m: undo(m.group(), *best) or m.group(), text)


def undo_lines(text: str, b: str, a: str) -> str | None:
    """Multi-byte encodings may use ASCII trail bytes, so whole lines are reversed together."""
    out = []
    for line in text.split("\n"):
        if line.isascii():
            out.append(line)
            continue
        try:
            raw = codecs.charmap_encode(line, "strict", _MAPS[b])[0]
        except UnicodeError:
            return None
        out.append(raw.decode(a, errors="replace"))
    r = "\n".join(out)
    return r if r.count("�") <= 0.02 * len(r) else None


# Runs of letters that a wrong one-byte table gives; classes in a row are searched faster than repeats.
_TABLE_RUNS = [re.compile(x * n).search for x, n in (("[À-ÿ]", 3), ("[Ѐ-џ]", 4), ("[─-╿]", 2))]


def needs_table(text: str) -> bool:
    return any(f(text) for f in _TABLE_RUNS)


def _suspect() -> re.Pattern:
    """Pairs of characters that some one-byte table gives for the first two bytes of a UTF-8 character."""
    lead, cont = set(), set()
    for b in {b for b, a in CHAINS if a == "utf-8" and b in _MAPS}:
        lead |= {chr(c) for c, x in _MAPS[b].items() if 0xC2 <= x <= 0xF4 and c > 127}
        cont |= {chr(c) for c, x in _MAPS[b].items() if 0x80 <= x <= 0xBF and c > 127}
    # A superset of the pairs, as one class after another: quicker than an alternation.
    return re.compile("[" + "".join(map(re.escape, sorted(lead))) + "][" + "".join(map(re.escape, sorted(cont))) + "]")


_SUSPECT = _suspect()


def light_repair(text: str, rounds: int = 3) -> str:
    """Deterministic repair without a corpus model; returns ``text`` itself when nothing applies."""
    if text.isascii() and "&#" not in text:
        return text
    for _ in range(rounds):
        new = text
        if "&#" in new:
            new = NUMREF.sub(lambda m: html.unescape(m.group()), new)
        if _SUSPECT.search(new):
            new = NONASCII.sub(lambda m: undo_utf8_run(m.group()) or m.group(), new)
        if new == text:
            break
        text = new
    if needs_table(text):
        return "\n".join((undo_single_byte(p) or p) if needs_table(p) else p for p in text.split("\n"))
    return text


def repair_map(text: str) -> tuple[str, list[int] | None]:
    """The text with its encoding repaired, and the original position of each of its characters."""
    if text.isascii() and "&#" not in text:
        return text, None
    fixed = light_repair(text)
    if fixed == text:
        return text, None
    src, pos = text, list(range(len(text)))
    if "&#" in text:
        out, where, at = [], [], 0
        for m in NUMREF.finditer(text):
            out.append(text[at : m.start()])
            where += range(at, m.start())
            s = html.unescape(m.group())
            out.append(s)
            where += [m.start()] * len(s)
            at = m.end()
        out.append(text[at:])
        where += range(at, len(text))
        src, pos = "".join(out), where
    # Repair changes only stretches of other than ASCII characters, so ASCII characters correspond.
    a = [i for i, c in enumerate(src) if c < "\x80"]
    b = [i for i, c in enumerate(fixed) if c < "\x80"]
    if len(a) != len(b):
        return text, None
    back, k, prev = [], 0, -1
    for i, c in enumerate(fixed):
        if c < "\x80":
            prev = a[k]
            k += 1
            back.append(pos[prev])
        else:
            n = prev + 1 if not back or fixed[i - 1] < "\x80" or i == 0 else min(prev + 1, len(pos) - 1)
            back.append(pos[min(n, len(pos) - 1)])
    back.append(len(text))
    return fixed, back


def looks_broken(text: str) -> bool:
    """Quick test for records unfit for training the clean-text model."""
    if text.isascii() and "&#" not in text:
        return False
    return bool(BROKEN.search(text)) or light_repair(text) != text


# --- smoothed character n-gram model ------------------------------------------------------------

TRI_BITS, BI_BITS = 22, 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hash(c: np.ndarray, bits: int) -> np.ndarray:
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams, one of each per character after the first two."""
    return _grams(_codes(text))


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bi = c[:-1] * np.uint64(1 << 21) + c[1:]
    tri = c[:-2] * np.uint64(1 << 42) + c[1:-1] * np.uint64(1 << 21) + c[2:] + np.uint64(7)
    return _hash(bi, BI_BITS), _hash(tri, TRI_BITS)


class CharModel:
    """Interpolated trigram and bigram model over hashed counts, add-``alpha`` smoothed."""

    def __init__(self, bi: np.ndarray, tri: np.ndarray, uni: dict[int, int], alpha: float = 0.05):
        self.bi, self.tri, self.alpha = bi.astype(np.float32, copy=False), tri.astype(np.float32, copy=False), alpha
        self.uni = uni
        self.total = max(1.0, float(sum(uni.values())))
        self.cache: dict[str, float] = {}
        self.memo: dict[tuple[str, str, str], str] = {}
        self.tables: dict[tuple[str, str, str], list[float | None]] = {}
        self.often: np.ndarray | None = None

    def logp(self, s: str) -> float:
        """Log-likelihood of ``s``; spans repeat a lot, so values are kept (bounded)."""
        v = self.cache.get(s)
        if v is None:
            if self.often is None:
                self.often = np.zeros(0x110000)
                self.often[list(self.uni)] = list(self.uni.values())
            c = _codes(s)
            b, t = _grams(c)
            u = self.often[c]
            nb = self.bi[b]
            pu = (u + self.alpha) / (self.total + self.alpha * 65536)
            pb = (np.minimum(nb, u[:-1]) + 5.0 * pu[1:]) / (u[:-1] + 5.0)
            pt = (np.minimum(self.tri[t], nb[:-1]) + 5.0 * pb[1:]) / (nb[:-1] + 5.0)
            v = float(np.log(np.minimum(pb[:1], 1.0)).sum() + np.log(np.minimum(pt, 1.0)).sum())
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[s] = v
        return v


def best_span(span: str, left: str, right: str, model: CharModel) -> tuple[str, float]:
    """The likeliest original of one span in its context, and its gain in log-likelihood."""
    best, gain = span, 0.0
    originals = _originals(span)
    if not originals:
        return best, gain
    base = model.logp(left + span + right)
    for r in originals:
        g = model.logp(left + r + right) - base
        if g > gain:
            best, gain = r, g
    return best, gain


@lru_cache(maxsize=30_000)
def _originals(span: str) -> list[str]:
    """What a span may have been before up to three wrong decodings, whatever its context."""
    out = []
    cur = {span}
    seen = {span}
    for _ in range(3):
        nxt: dict[str, None] = {}
        for s in cur:
            for b, a in CHAINS:
                r = undo(s, b, a)
                if r is not None and r not in seen:
                    nxt[r] = None
        for r in nxt:
            seen.add(r)
            if not r or any(unicodedata.category(c) in ("Cc", "Cn", "Co") or (c > "\x7f" and not _PLAUSIBLE.match(c)) for c in r if c not in "\t\n\r"):
                continue
            out.append(r)
        cur = nxt
        if not cur:
            break
    return out


def restore(text: str, model: CharModel, margin: float) -> tuple[str, bool]:
    """Repair every span whose likeliest chain beats the text as it stands by ``margin``.

    Returns the text and whether any garbling (repaired or beyond repair) was seen.
    """
    if text.isascii() and "&#" not in text:
        return text, False
    found = bool(BROKEN.search(text))
    src = NUMREF.sub(lambda m: html.unescape(m.group()), text) if "&#" in text else text
    was_ref = src != text

    memo = model.memo
    pieces, at = [], 0
    for m in NONASCII.finditer(src):
        s, (st, en) = m.group(), m.span()
        k = (s, src[max(0, st - 2) : st], src[en : en + 2])
        r = memo.get(k)
        if r is None:
            if len(memo) > 50_000:
                memo.clear()
            r, g = best_span(*k, model)
            r = memo[k] = r if g >= margin else s
        if r != s:
            pieces += (src[at:st], r)
            at = en
    found = found or bool(pieces)
    out = "".join(pieces) + src[at:] if pieces else src
    if was_ref and not found:
        return text, False
    parts = out.split("\n")
    for i, p in enumerate(parts):
        if not p.isascii():
            parts[i] = table_repair(p, model, margin)
    fixed = "\n".join(parts)
    found = found or fixed != out
    return (fixed if found else text), found


_TABLE_CHAINS = [(b, a) for b, a in BYTE_CHAINS if a != "gb18030"]


@lru_cache(maxsize=30_000)
def _undone(s: str) -> tuple[int, list[str | None]]:
    """The span reversed by each of ``_TABLE_CHAINS``, and a bit for each that can be."""
    r = [undo(s, b, a) for b, a in _TABLE_CHAINS]
    return sum(1 << i for i, x in enumerate(r) if x is not None), r


def _table_gains(p: str, ahead: Iterator[re.Match], seen: list, model: CharModel) -> Iterator[tuple]:
    """The next spans in their contexts, each with what it gains by each of ``_TABLE_CHAINS``."""
    for m in ahead:
        st, en = m.span()
        k = (m.group(), p[max(0, st - 2) : st], p[en : en + 2])
        g = model.tables.get(k)
        if g is None:
            g = model.tables[k] = [None] * len(_TABLE_CHAINS)
        seen.append((k, g))
        yield k, g


def table_repair(p: str, model: CharModel, margin: float) -> str:
    """Reverse a wrong one-byte table over a whole paragraph, if its spans together gain three
    times the margin and every span can be reversed."""
    whole = undo_single_byte(p) if needs_table(p) else None
    if whole is not None and model.logp(whole) / len(whole) > model.logp(p) / len(p) + 0.5:
        return whole
    # Chains that reverse every span.
    chains = -1
    for s in set(NONASCII.findall(p)):
        chains &= _undone(s)[0]
        if not chains:
            return p
    if len(model.tables) > 50_000:
        model.tables.clear()
    keep = None
    best = 3 * margin
    # Most chains are given up after a few spans, so that the others need not be looked at.
    gains, ahead = [], NONASCII.finditer(p)
    for i in range(len(_TABLE_CHAINS)):
        if not chains >> i & 1:
            continue
        gain = 0.0
        for k, g in chain(gains, _table_gains(p, ahead, gains, model)):
            if g[i] is None:
                s, left, right = k
                r = _undone(s)[1][i]
                g[i] = 0.0 if r == s else model.logp(left + r + right) - model.logp(left + s + right)
            gain += g[i]
            if gain < -30:
                break
        else:
            if gain > best:
                keep, best = i, gain
    if keep is None:
        return p
    return NONASCII.sub(lambda m: _undone(m.group())[1][keep] or m.group(), p)
