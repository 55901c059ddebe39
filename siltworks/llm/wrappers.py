"""Problem 7: the main body of web pages, by inferred wrappers.

For every host a union-free regular expression over block tokens is inferred from all its distinct
pages, in groups whose wrappers are merged: the wrapper so far is aligned with the next page, and mismatches become text
slots (same place, other text), repeated groups (the place just before occurs again) or optional
tokens.  Tokens whose text stays fixed are the host's template; texts fixed on several hosts are
template wherever they occur.  On every page the template and the side regions (links, comments,
forms, hidden text) are taken out and the region holding most running text is kept.

Defined results: pages without bytes, or not of type response, give no rows; repeated rows of a page
give its blocks once; a page without running text gives the blocks of its largest region.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from siltworks.llm import encoding as E, pageparse as W
from siltworks.llm.batches import map_columns
from siltworks.session import durable

#: Groups of a host's pages whose wrappers are inferred apart and then merged.
GROUPS = 64
#: Hosts on which a text must be fixed to be template everywhere, whatever the number of hosts.
SHARED_HOSTS = 3

_DIGITS = re.compile(r"\d+")
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w-]+)", re.I)


# --- decoding -----------------------------------------------------------------------------------


def decode(raw: bytes, charset: str | None) -> str:
    """The page in its correct characters: valid UTF-8 wins, else the likeliest of the stated, the
    declared and the usual encodings; garbled characters are repaired."""
    try:
        return E.light_repair(raw.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    high = sum(b > 127 for b in raw)
    letters = sum(map(len, re.findall(rb"[A-Za-z\x80-\xff]+", re.sub(rb"<[^>]*>|<(?:script|style).*?</(?:script|style)>", b" ", raw, flags=re.S))))
    said = [c for c in ((charset or "").strip().lower(), *(m.decode("ascii", "replace").lower() for m in _META.findall(raw))) if c and c not in ("utf-8", "utf8")]
    if high > 0.25 * max(1, letters):
        best = None
        for c in ("cp1251", "koi8-r"):
            s = " ".join(E.NONASCII.findall(raw.decode(c, "replace")))
            v = E._ru_score(s)
            if best is None or v > best[0]:
                best = (v, c)
        try:
            g = raw.decode("gb18030")
            cjk = len(re.findall("[一-鿿，。！？、：；“”]", g))
            common = sum(g.count(c) for c in "的了在是我有和不这年来到就")
            if cjk > 0.4 * high / 2 and common * 40 > cjk and best[0] < 1.5:
                return g
        except UnicodeDecodeError:
            pass
        if best[0] > 0.5:
            return raw.decode(best[1], "replace")
    # Mostly valid UTF-8 with a few broken bytes.
    u = raw.decode("utf-8", "replace")
    if u.count("�") * 10 < high:
        return E.light_repair(u)
    for c in [x for x in said if x not in ("gb18030", "gbk", "windows-1251", "cp1251", "koi8-r", "iso-8859-1", "latin-1", "latin1")] + ["cp1252"]:
        try:
            s = raw.decode(c)
        except (UnicodeDecodeError, LookupError):
            continue
        return E.light_repair(s)
    inv = {b: c for c, b in E._MAPS["cp1252"].items() if b >= 0x80}
    return E.light_repair("".join(chr(b) if b < 0x80 else chr(inv.get(b, b)) for b in raw))


# --- wrapper inference --------------------------------------------------------------------------


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", text).encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=50_000)
def _label(tag: str, key: str) -> str:
    return tag + ("." + W._HEXED.sub("#", key) if key else "")


def place(b: W.Block) -> str:
    return "/".join([_label(n.tag, n.key) for n in b.path[1:]])


def tokens(bs: list[W.Block]) -> list[tuple[str, int]]:
    return [(place(b), text_key(b.text)) for b in bs]


class Token:
    """One position of a wrapper: a place with a fixed text or a slot, perhaps optional or repeated."""

    __slots__ = ("place", "text", "seen", "slot", "optional", "repeated", "last")

    def __init__(self, place_: str, text: int, optional: bool, source: object = None) -> None:
        self.place, self.text, self.seen, self.slot, self.optional, self.repeated, self.last = place_, text, 1, False, optional, False, source

    def see(self, source: object) -> None:
        """Count a page; crawls of one address, one after the other, count once."""
        self.seen += source is None or source != self.last
        self.last = source


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both members; ``pairs`` rise in the first."""
    tails: list[int] = []
    at: list[int] = []
    prev = [-1] * len(pairs)
    for i, (_, w) in enumerate(pairs):
        k = bisect.bisect_left(tails, w)
        if k == len(tails):
            tails.append(w)
            at.append(i)
        else:
            tails[k], at[k] = w, i
        prev[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = prev[i]
    return out[::-1]


def align(wrapper: list[Token], page: list[tuple[str, int]], source: object = None) -> list[Token]:
    """The wrapper generalised so that it also generates ``page`` (a crawl of the address ``source``)."""
    where: dict[tuple[str, int], list[int]] = {}
    for i, t in enumerate(wrapper):
        if not t.slot:
            where.setdefault((t.place, t.text), []).append(i)
    used: set[int] = set()
    pairs = []
    for j, k in enumerate(page):
        for i in where.get(k, ()):
            if i not in used:
                used.add(i)
                pairs.append((j, i))
                break
    anchors = _increasing(pairs)
    out: list[Token] = []
    i = j = 0
    for aj, ai in [*anchors, (len(page), len(wrapper))]:
        out += _gap(wrapper[i:ai], page[j:aj], out, source)
        if ai < len(wrapper):
            wrapper[ai].see(source)
            out.append(wrapper[ai])
        i, j = ai + 1, aj + 1
    return out


def _gap(ws: list[Token], ps: list[tuple[str, int]], before: list[Token], source: object) -> list[Token]:
    """Resolve a mismatch between two anchors into slots, repeated groups and optional tokens."""
    out: list[Token] = []
    last = {w.place: k for k, w in enumerate(ws)}
    i = j = 0
    while i < len(ws) and j < len(ps):
        w, p = ws[i], ps[j]
        if w.place == p[0]:
            w.slot = w.slot or w.text != p[1]
            w.see(source)
            out.append(w)
            i, j = i + 1, j + 1
        elif last.get(p[0], -1) > i:
            w.optional = True
            out.append(w)
            i += 1
        else:
            _extra(p, out, before, source)
            j += 1
    for w in ws[i:]:
        w.optional = True
        out.append(w)
    for p in ps[j:]:
        _extra(p, out, before, source)
    return out


def _extra(p: tuple[str, int], out: list[Token], before: list[Token], source: object) -> None:
    last = out[-1] if out else (before[-1] if before else None)
    if last is not None and last.place == p[0] and last.slot:
        last.repeated = True
    else:
        out.append(Token(p[0], p[1], True, source))


def infer(pages: list[list[tuple[str, int]]], sources: list | None = None) -> list[Token]:
    if not pages:
        return []
    sources = sources or [None] * len(pages)
    w = [Token(p, t, False, sources[0]) for p, t in pages[0]]
    for p, source in zip(pages[1:], sources[1:]):
        w = align(w, p, source)
    return w


def merge(a: list[Token], b: list[Token]) -> list[Token]:
    """One wrapper that generates the pages of both; counts of pages add up."""
    where: dict[tuple[str, int], list[int]] = {}
    for i, t in enumerate(a):
        if not t.slot:
            where.setdefault((t.place, t.text), []).append(i)
    used: set[int] = set()
    pairs = []
    for j, t in enumerate(b):
        for i in () if t.slot else where.get((t.place, t.text), ()):
            if i not in used:
                used.add(i)
                pairs.append((j, i))
                break
    out: list[Token] = []
    i = j = 0
    for bj, ai in [*_increasing(pairs), (len(b), len(a))]:
        ws, ps = a[i:ai], b[j:bj]
        last = {w.place: k for k, w in enumerate(ws)}
        m = n = 0
        while m < len(ws) and n < len(ps):
            w, p = ws[m], ps[n]
            if w.place == p.place:
                out.append(_joined(w, p))
                m, n = m + 1, n + 1
            elif last.get(p.place, -1) > m:
                w.optional = True
                out.append(w)
                m += 1
            else:
                p.optional = True
                out.append(p)
                n += 1
        for t in ws[m:] + ps[n:]:
            t.optional = True
            out.append(t)
        if ai < len(a):
            out.append(_joined(a[ai], b[bj]))
        i, j = ai + 1, bj + 1
    return out


def _joined(w: Token, p: Token) -> Token:
    w.slot = w.slot or p.slot or w.text != p.text
    w.optional, w.repeated, w.seen = w.optional or p.optional, w.repeated or p.repeated, w.seen + p.seen
    return w


def host_templates(pages: DataFrame) -> DataFrame:
    """``host, keys``: hashes of the texts that are template on a host's pages: fixed in the wrapper over
    all its distinct pages, or fixed on several hosts."""
    d = pages.withColumn("url", F.coalesce("url", F.col("page_id").cast("string"))).withColumn("g", F.pmod(F.xxhash64("url"), F.lit(GROUPS)))
    parts = "host string, g long, held array<long>, place array<string>, text array<long>, seen array<long>, flags array<int>"

    def row(host: str, g: int, held: list[int], w: list[Token]) -> pd.DataFrame:
        return pd.DataFrame({"host": [host], "g": [g], "held": [held], "place": [[t.place for t in w]], "text": [[t.text for t in w]], "seen": [[t.seen for t in w]], "flags": [[t.slot + 2 * t.optional + 4 * t.repeated for t in w]]})

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates().sort_values(["url", "page_id"], kind="stable")
        streams = [tokens(W.blocks(decode(bytes(b), c))) for b, c in zip(pdf.html_bytes, pdf.charset)]
        return row(key[0], int(key[1]), sorted({t for s in streams for _, t in s}), infer(streams, list(pdf.url)))

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper: list[Token] | None = None
        for r in pdf.sort_values("g").itertuples():
            w = []
            for p, t, n, f in zip(r.place, r.text, r.seen, r.flags):
                x = Token(p, int(t), bool(f & 2))
                x.seen, x.slot, x.repeated = int(n), bool(f & 1), bool(f & 4)
                w.append(x)
            wrapper = w if wrapper is None else merge(wrapper, w)
        seen: dict[int, int] = {}
        for t in wrapper or ():
            if not t.slot:
                seen[t.text] = max(seen.get(t.text, 0), t.seen)
        return pd.DataFrame({"host": pdf.host.iloc[0], "k": list(seen), "seen": list(seen.values())})

    folded = durable(d.groupBy("host", "g").applyInPandas(fold, parts))
    fixed = durable(folded.drop("held").groupBy("host").applyInPandas(unite, "host string, k long, seen long"))
    shared = fixed.groupBy("k").agg(F.count("*").alias("hosts"), F.max("seen").alias("most")).where((F.col("hosts") >= SHARED_HOSTS) & (F.col("most") >= 2)).select("k")
    here = folded.select("host", F.explode("held").alias("k")).distinct().join(shared, "k")
    return fixed.where("seen >= 2").select("host", "k").unionByName(here.select("host", "k")).groupBy("host").agg(F.sort_array(F.collect_set("k")).alias("keys"))


# --- main region --------------------------------------------------------------------------------

_SIDE_TAGS = frozenset("nav footer aside form button figure figcaption dialog label header".split())
# Whole ids, classes and roles of side regions; fixed values.
_SIDE_KEYS = frozenset(
    "footer foot sidebar side right comments comment replies reply discussion tags tag cloud menu top hd nav navigation navbar breadcrumb breadcrumbs meta byline author date promo note box ad ads advert advertisement banner cookie-banner cookies cookie consent dialog related share social newsletter subscribe signup login search pager caption hidden teaser widget disclaimer".split()
)
# Furniture phrases inside articles; fixed values.
_FURNITURE = re.compile(
    r"^(?:read also|see also|also read|more on this|related|advertisement|sponsored|subscribe|sign up|support independent|the article continues|continue reading|share this|reading time|last updated|updated on|published on|posted on|written by|by [A-Z]"
    r"|lesen sie auch|mehr zum thema|anzeige|werbung|abonnieren|seite teilen|lesezeit|zuletzt aktualisiert|aktualisiert|veröffentlicht|der artikel geht|unterstützen sie|von [A-Z]\w+ [A-Z]"
    r"|à lire|lire aussi|publicité|abonnez|partager|temps de lecture|mis à jour|publié|la suite de|l['’]article continue|soutenez|par [A-Z]\w+ [A-Z]"
    r"|lea también|lee también|le puede|publicidad|suscríb|compartir|tiempo de lectura|actualizado|publicado|el artículo continúa|apoye|por [A-Z]\w+ [A-Z]"
    r"|leia também|leia mais|publicidade|assine|subscreva|partilhar|compartilhar|tempo de leitura|atualizado|o artigo continua|apoie"
    r"|читайте также|реклама|подпи|поделиться|время чтения|обновлено|опубликовано|продолжение|поддержите"
    r"|另请阅读|延伸阅读|相关|阅读更多|广告|订阅|分享|阅读时间|更新于|发布于|最后更新|文章继续|下文继续|支持)",
    re.I,
)
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_NOTICE = re.compile(r"cookie|©|\(c\) \d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|todos os direitos|все права|版权所有|缓存文件", re.I)
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]」』]*$")
_USER = re.compile(r"^[\w.-]*\d+$|^@\w+$|^\w+[-_]\w+$")


def _side(b: W.Block) -> bool:
    for n in b.path:
        if n.hidden or n.tag in _SIDE_TAGS:
            return True
        if n.key and any(k in _SIDE_KEYS for k in n.key.split()):
            return True
    return False


def main_blocks(bs: list[W.Block], fixed: frozenset[int] | set[int]) -> list[str]:
    """Distinct texts of the main body's blocks, in order."""
    side = {b.order for b in bs if _side(b)}
    # Link lists and comment threads without telling names.
    total: dict[int, list[int]] = {}
    for b in bs:
        for n in b.path[2:]:
            t = total.setdefault(n.serial, [0, 0, 0, 0])
            t[0] += len(b.text)
            t[1] += min(b.linked, len(b.text))
            t[2] += b.linked > 0.7 * len(b.text)
            if b.linked < 0.3 * len(b.text) and len(b.text) > 60 and _CLOSED.search(b.text):
                t[3] += 1
    # A table that holds running text beside links lays out the page; its lists of links still go.
    lists = {s for s, (n, linked, k, prose) in total.items() if (k >= 3 and linked > 0.5 * n and prose <= 1) or (k >= 2 and linked > 0.9 * n)}
    threads = {n.serial for b in bs if b.bold and _USER.match(b.text) and b.path for n in b.path[-1:] if n.tag not in ("body", "html")}
    # A short element with a button is a banner.
    banners = {b.path[-2].serial for b in bs if len(b.path) > 2 and b.path[-1].tag == "button" and total.get(b.path[-2].serial, [999])[0] < 400 and total[b.path[-2].serial][3] <= 2}
    for b in bs:
        if any(n.serial in lists or n.serial in threads or n.serial in banners for n in b.path[2:]):
            side.add(b.order)
    noise = set()
    holds: dict[int, int] = {}
    for b in bs:
        for n in b.path[2:]:
            holds[n.serial] = holds.get(n.serial, 0) + 1
    for b in bs:
        t = b.text
        tag = b.path[-1].tag if b.path else ""
        if tag in ("li", "td") and holds.get(b.path[-1].serial, 1) > 1:
            tag = "div"
        if _NOTICE.search(t) and (len(t) < 160):
            noise.add(b.order)
        elif _FURNITURE.match(t) and tag not in ("li", "td") and (len(t) < 120 and (not _CLOSED.search(t) or len(t) < 70) or _DATE.search(t)):
            noise.add(b.order)
        elif len(t) < 60 and _DATE.search(t) and tag not in ("li", "td", "h1", "h2", "h3") and re.sub(r"[\W\d]+", "", t) and len(t.split()) <= 7 and not _CLOSED.search(t):
            noise.add(b.order)
        elif b.linked >= 0.5 * len(t) and tag not in ("h1", "h2", "h3"):
            noise.add(b.order)
        elif text_key(t) in fixed and _CLOSED.search(t) and tag not in ("li", "td", "th", "h1", "h2", "h3"):
            noise.add(b.order)
    # The region with most running text: its own blocks count whole, those a level deeper by half.
    score: dict[int, float] = {}
    depth: dict[int, int] = {}
    for b in bs:
        if b.order in side or b.order in noise or not b.path:
            continue
        v = len(b.text) - min(b.linked, len(b.text))
        if not (_CLOSED.search(b.text) and len(b.text) > 25):
            v *= 0.15
        own = b.path[-1]
        chain = list(b.path)
        if own.tag in ("p", "div", "blockquote", "h1", "h2", "h3", "h4", "pre", "li", "td", "th") and len(chain) > 1 and holds.get(own.serial, 1) == 1:
            chain = chain[:-1]
        f = 1.0
        for n in reversed(chain):
            score[n.serial] = score.get(n.serial, 0.0) + v * f
            depth[n.serial] = b.path.index(n)
            f *= 0.55
    if not score:
        return []
    best = max(score, key=lambda s: (score[s], depth[s]))
    inside = [b for b in bs if b.order not in side and b.order not in noise and any(n.serial == best for n in b.path)]
    # Text set directly in the region, between line breaks: elements beside it are other regions.
    direct = sum(len(b.text) for b in inside if b.path[-1].serial == best and len(b.text) > 40)
    if direct > 0.5 * sum(len(b.text) for b in inside if len(b.text) > 40) and direct:
        inside = [b for b in inside if b.path[-1].serial == best]
    out, seen = [], set()
    for b in inside:
        if b.text not in seen:
            seen.add(b.text)
            out.append(b.text)
    return out


def _pages(pages: DataFrame) -> DataFrame:
    return pages.where("warc_type = 'response' AND html_bytes IS NOT NULL").select("page_id", F.coalesce("host", F.lit("")).alias("host"), "url", "html_bytes", "charset")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, blocks``: the main body of every response page, one row per distinct page row."""
    src = _pages(pages)
    own = durable(host_templates(src))

    def fn(ids: list, raws: list, charsets: list, keys: list) -> list[list]:
        return [ids, [main_blocks(W.blocks(decode(r, c)), frozenset(k or ())) for r, c, k in zip(raws, charsets, keys)]]

    return map_columns(src.join(own, "host", "left"), ["page_id", "html_bytes", "charset", "keys"], "page_id long, blocks array<string>", fn)


def found(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", F.explode("blocks").alias("b")).select("page_id", F.md5(F.encode("b", "UTF-8")).alias("block_md5")).distinct()
