"""Problem 6: text garbled by a wrong character decoding.

A character n-gram model is counted over every clean record, a margin is validated on held-out
clean records and on records garbled on purpose, and each span's candidate encode-decode chains
are scored; the likeliest is accepted beyond the margin.

Defined results: null or empty text is never garbled; pages without bytes or of another type than
response are not judged; repeated page rows give one row; an empty corpus gives a model that
accepts only chains with a large gain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siltworks.llm import encoding as E
from siltworks.llm.batches import map_columns, map_partition

#: Width of a step in the histogram of gains, and most spans whose gains a task remembers.
STEP = 0.01
KEPT_SPANS = 50_000
#: Characters whose n-grams are counted at once.
PIECE = 1 << 20
LEAST_MARGIN = 4.0


def _count_partition(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    bi = np.zeros(1 << E.BI_BITS, dtype=np.uint32)
    tri = np.zeros(1 << E.TRI_BITS, dtype=np.uint32)
    uni = np.zeros(0x110000, dtype=np.uint32)
    for (texts,) in batches:
        clean = [t for t in texts if t and t.strip() and not E.looks_broken(t)]
        for joined in _pieces(clean):
            for table, g in zip((bi, tri, uni), (*E.grams(joined), E._codes(joined).astype(np.int64))):
                np.add.at(table, g, np.uint32(1))
    held = [np.flatnonzero(x) for x in (bi, tri, uni)]
    yield [
        np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(i) for i in held]),
        np.concatenate(held),
        np.concatenate([x[i] for x, i in zip((bi, tri, uni), held)]).astype(np.int64),
    ]


def _pieces(texts: list[str]) -> Iterator[str]:
    """The texts end to end, in pieces of about ``PIECE`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= PIECE:
            yield "\n ".join(group)
            group, size = [], 0
    if group:
        yield "\n ".join(group)


def _page_texts(pages: DataFrame) -> DataFrame:
    """Pages that are valid UTF-8, as text; their furniture holds characters that prose lacks."""

    def fn(raws: list) -> list[list]:
        return [[utf8_or_none(r) for r in raws]]

    return map_columns(pages.where("warc_type = 'response'"), ["html_bytes"], "_t string", fn)


def utf8_or_none(raw: bytes | None) -> str | None:
    return lenient(raw, "utf-8", strict=True) if raw is not None and not raw.isascii() else None


def train_model(docs: DataFrame, pages: DataFrame | None = None, text_col: str = "text") -> tuple[E.CharModel, float]:
    """The n-gram model over all clean records of ``docs`` (and clean ``pages``), and the validated
    margin.

    The counts come back as at most 2**22 + 2**20 hashed buckets plus the distinct characters.
    """
    texts = docs.select(F.col(text_col).alias("_t"))
    if pages is not None:
        texts = texts.unionByName(_page_texts(pages))
    counts = (
        map_partition(texts, ["_t"], "kind int, k long, n long", _count_partition)
        .groupBy("kind", "k")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    kind, key, n = (counts.column(c).to_numpy() for c in ("kind", "k", "n"))
    bi, tri = np.zeros(1 << E.BI_BITS, dtype=np.float32), np.zeros(1 << E.TRI_BITS, dtype=np.float32)
    for i, arr in ((0, bi), (1, tri)):
        arr[key[kind == i]] = n[kind == i]
    model = E.CharModel(bi, tri, dict(zip(key[kind == 2].tolist(), n[kind == 2].tolist())))
    return model, validate_margin(texts, model)


def _span_gains(texts: list, model: E.CharModel, kept: dict) -> tuple[float, dict[int, int]]:
    """The greatest gain of a clean span, and a histogram of the gains of the same spans garbled on
    purpose; a span in its context is scored once."""
    spans: Counter = Counter()
    for t in texts:
        if t and not t.isascii() and not E.looks_broken(t):
            spans.update([(m.group(), t[max(0, m.start() - 2) : m.start()], t[m.end() : m.end() + 2]) for m in E.NONASCII.finditer(t)])
    top, hist = 0.0, {}
    for k, n in spans.items():
        if k not in kept:
            if len(kept) >= KEPT_SPANS:
                kept.clear()
            s = k[0].encode("utf-8").decode("latin-1")
            kept[k] = (E.best_span(*k, model)[1], round(E.best_span(s, *k[1:], model)[1] / STEP))
        gain, step = kept[k]
        top = max(top, gain)
        hist[step] = hist.get(step, 0) + n
    return top, hist


def validate_margin(texts: DataFrame, model: E.CharModel) -> float:
    """The least margin that no clean span of any record reaches, kept below the gains of the same
    spans garbled on purpose: a distributed maximum and a distributed histogram."""
    bm = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        top, hist, kept = 0.0, Counter(), {}
        for (ts,) in batches:
            g, h = _span_gains(ts, bm.value, kept)
            top = max(top, g)
            hist.update(h)
        yield [[None, *hist], [top, *[0.0] * len(hist)], [0, *hist.values()]]

    # One row a step of the gain, whatever the number of records.
    rows = map_partition(texts, ["_t"], "step long, top double, n long", run).groupBy("step").agg(F.max("top").alias("top"), F.sum("n").alias("n")).collect()
    clean_gain = max((r.top for r in rows if r.step is None), default=0.0)
    steps = sorted((r.step, r.n) for r in rows if r.step is not None)
    low, left = LEAST_MARGIN * 3, 0.005 * sum(n for _, n in steps)
    for step, n in steps:
        low, left = step * STEP, left - n
        if left <= 0:
            break
    return max(LEAST_MARGIN, min(clean_gain + 1.0, 0.7 * low))


def repair_documents(docs: DataFrame, model: E.CharModel, margin: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, garbled, restored``: one row per input row; null text stays null and ungarbled."""
    bm = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    def fn(ids: list, texts: list) -> list[list]:
        m = kept.setdefault("m", bm.value)
        out, bad = [], []
        for t in texts:
            r, g = E.restore(t, m, margin) if t and t.strip() else (t, False)
            out.append(r)
            bad.append(g)
        return [ids, bad, out]

    id_type = dict(docs.dtypes)[id_col]
    return map_columns(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), ["_i", "_t"], f"{id_col} {id_type}, garbled boolean, restored string", fn)


PAGE_CODECS = ["utf-8", "cp1252", "cp1251", "gb18030", "koi8-r", "cp1250", "big5", "shift_jis", "cp866"]


def lenient(raw: bytes, codec: str, strict: bool = False) -> str | None:
    """Decode; a one-byte table's undefined bytes become C1 controls, other faults U+FFFD."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        if strict:
            return None
        if codec.lower().replace("_", "-") in ("cp1252", "windows-1252"):
            inv = {b: c for c, b in E._MAPS["cp1252"].items() if b >= 0x80}
            return "".join(chr(b) if b < 0x80 else chr(inv.get(b, b)) for b in raw)
        return raw.decode(codec, errors="replace")
    except LookupError:
        return raw.decode("utf-8", errors="replace")


def span_score(s: str, model: E.CharModel) -> float:
    return sum(model.logp(s[max(0, m.start() - 2) : m.end() + 2]) for m in E.NONASCII.finditer(s))


def author_text(raw: bytes, model: E.CharModel) -> str:
    """The likeliest reading of a page's bytes under the candidate encodings."""
    u = lenient(raw, "utf-8", strict=True)
    if u is not None:
        return u
    best, score = None, -np.inf
    for c in PAGE_CODECS[1:]:
        s = lenient(raw, c, strict=c not in ("cp1252",))
        if s is not None and (v := span_score(s, model)) > score:
            best, score = s, v
    # Mostly valid UTF-8 with a few damaged bytes is still UTF-8.
    s = raw.decode("utf-8", errors="replace")
    bad = s.count("�")
    if bad and bad * 20 < sum(map(len, E.NONASCII.findall(s))) and span_score(s, model) > score:
        return s
    return best if best is not None else s


def repair_page(raw: bytes | None, charset: str | None, model: E.CharModel, margin: float) -> tuple[str | None, bool]:
    """A page's correct text and whether reading it as ``charset`` says gives something else."""
    if raw is None:
        return None, False
    stated = lenient(raw, (charset or "").strip() or "utf-8")
    if raw.isascii():
        return E.restore(stated, model, margin)
    true = author_text(raw, model)
    fixed, garbled = E.restore(true, model, margin)
    return fixed, garbled or stated != true


def repair_pages(pages: DataFrame, model: E.CharModel, margin: float) -> DataFrame:
    """``page_id, garbled`` for distinct response pages with bytes."""
    bm = pages.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    def fn(ids: list, raws: list, charsets: list) -> list[list]:
        m = kept.setdefault("m", bm.value)
        return [ids, [repair_page(r, c, m, margin)[1] for r, c in zip(raws, charsets)]]

    src = pages.where("warc_type = 'response' AND html_bytes IS NOT NULL")
    return map_columns(src, ["page_id", "html_bytes", "charset"], "page_id long, garbled boolean", fn)


def found(docs: DataFrame, pages: DataFrame) -> DataFrame:
    model, margin = train_model(docs, pages)
    d = repair_documents(docs, model, margin).where("garbled").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("record_id"))
    p = repair_pages(pages, model, margin).where("garbled").select(F.lit("pages").alias("table_name"), F.col("page_id").alias("record_id"))
    return d.unionByName(p).distinct()
