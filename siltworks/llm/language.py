"""Problem 2: languages of documents and of the stretches of mixed-language documents.

A linear-chain conditional random field labels every word: affix, character n-gram, script and
lexicon features with learned transitions, trained on code-switched sequences cut from labelled
documents.  Word marginals add up to a language and a confidence per sentence; sentences of one
language in a row form a stretch, and the stretches give the document's languages.

The field is fitted on at most ``TRAIN_ROWS`` documents per language (the first by a hash of the
id), whose label agrees with the lexicon, plus the lexicon itself, so that tiny or unlabelled
tables still give a usable model.

Defined results: null or blank text has language ``und`` with confidence 0; a text without any
sentence gets the language of its words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.llm import prose as P
from siltworks.llm.batches import map_columns
from siltworks.llm.crf import Crf

LANGUAGES = ["de", "en", "es", "fr", "pt", "ru", "zh"]
#: Most labelled documents per language used for fitting.
TRAIN_ROWS = 60
#: Least confidence of a sentence that adds its language to the document's; of a short one, which gives
#: the field less to go by.
SURE, SURE_SHORT, SHORT = 0.75, 0.95, {"zh": 6}

_NATIVE = {"ru": re.compile("[а-яё]", re.I), "zh": P._CJK}


_ADDRESS = re.compile(r"\S*@\S+|\b(?:https?://|www\.)\S+")


def tokens(text: str) -> list[str]:
    """Words in lower case, without those of addresses."""
    if "@" in text or "://" in text or "www." in text:
        text = _ADDRESS.sub(" ", text)
    return P.WORD.findall(text.lower())


def features(w: str) -> tuple[str, ...]:
    c = w[0]
    if c.isdigit():
        return ("num",)
    if not c.isalnum():
        return ("mark:" + c,)
    if P._CJK.match(c):
        return ("cjk",)
    out = [f"w:{w}"]
    if "а" <= c <= "я" or c == "ё":
        out.append("cyr")
    for n in (1, 2, 3):
        out.append(f"p{n}:{w[:n]}")
    for n in (1, 2, 3, 4):
        out.append(f"s{n}:{w[-n:]}")
    x = f"^{w}$"
    out += [f"2:{x[i:i+2]}" for i in range(len(x) - 1)]
    out += [f"3:{x[i:i+3]}" for i in range(len(x) - 2)]
    out += [f"lex:{k}" for k in LANGUAGES if k in P.COMMON and w in P.COMMON[k]]
    if not w.isascii():
        out += [f"c:{ch}" for ch in w if ch > "\x7f"]
    return tuple(out)


def lexicon_language(text: str) -> str | None:
    """The language whose common words prevail clearly; used to clean the training labels."""
    cjk = len(P._CJK.findall(text))
    if cjk > 0.3 * len(text):
        return "zh"
    ws = P.WORD.findall(text.lower())
    if not ws:
        return None
    votes = sorted(((sum(w in P.COMMON[k] for w in ws), k) for k in LANGUAGES if k in P.COMMON), reverse=True)
    (a, k), (b, _) = votes[0], votes[1]
    return k if a >= 0.12 * len(ws) and a >= 1.25 * b else None


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Crf:
    code = F.lower(F.substring(F.trim(F.col(lang_col)), 1, 2))
    src = docs.select(code.alias("k"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h")).where(F.col("k").isin(LANGUAGES) & (F.octet_length("t") > 200))
    # The window is a bounded top-k per language: Spark prunes each partition before the shuffle.
    top = src.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h"))).where(F.col("r") <= 2 * TRAIN_ROWS)
    rows = top.select("k", "t", "h").collect()
    return fit([(r.k, r.t) for r in sorted(rows, key=lambda r: (r.k, r.h))])


def fit(rows: list[tuple[str, str]]) -> Crf:
    by: dict[str, list[list[str]]] = {k: [] for k in LANGUAGES}
    used: dict[str, int] = {}
    for k, t in rows:
        t = P.normalise(t)
        if used.get(k, 0) >= TRAIN_ROWS or lexicon_language(t) != k:
            continue
        used[k] = used.get(k, 0) + 1
        for u in P.units(t):
            if u.prose and lexicon_language(u.text) in (k, None):
                by[k].append(tokens(u.text))
    rng = np.random.default_rng(11)
    for k in LANGUAGES:
        lex = sorted(P.COMMON.get(k, ())) or [[c] for c in ()]
        if k == "zh":
            by[k] += [["这", "是", "一", "个", "。"], ["我们", "在", "这里", "，", "他们", "也", "来", "了", "。"]]
        for _ in range(12):
            if lex:
                by[k].append([str(w) for w in rng.choice(lex, size=min(12, len(lex)), replace=False)])
    seqs, tags = [], []
    for n in range(120 * len(LANGUAGES)):
        s, g = [], []
        k = LANGUAGES[n % len(LANGUAGES)]
        for _ in range(int(rng.integers(1, 5))):
            if rng.random() < 0.35:
                k = LANGUAGES[int(rng.integers(len(LANGUAGES)))]
            pool = by[k]
            x = pool[int(rng.integers(len(pool)))]
            s += x
            g += [LANGUAGES.index(k)] * len(x)
        seqs.append(s)
        tags.append(g)
    return Crf(LANGUAGES, features, bits=15).fit(seqs, tags, epochs=4)


class Sentence(NamedTuple):
    start: int
    end: int
    prose: bool
    lang: str
    confidence: float
    number: int  # the sentence's number in the batch's segments, -1 for a text without sentences


def analyse(texts: list[str], model: Crf, prose_only: bool = False) -> tuple[list[list[Sentence]], P.Segments]:
    """Per text its sentences with their languages; with ``prose_only`` texts that are not mostly
    running sentences are not labelled.  The segments of the batch come along."""
    seg = P.segment_all(texts)
    out: list[list[Sentence]] = [[] for _ in texts]
    wanted = seg.is_prose if prose_only else np.ones(len(texts), dtype=bool)
    pick = np.flatnonzero(wanted[seg.doc]) if len(seg.doc) else np.zeros(0, dtype=np.int64)
    doc, size = seg.doc[pick], np.diff(seg.at)[pick]
    flat = seg.ids[np.repeat(wanted[seg.doc], np.diff(seg.at))] if len(pick) else seg.ids[:0]
    start, end, prose = seg.start[pick], seg.end[pick], seg.prose[pick]
    # Words of addresses carry no language.
    marked = {i for i, t in enumerate(texts) if wanted[i] and ("@" in t or "://" in t)}
    if marked:
        parts, at, done = [], np.concatenate([[0], np.cumsum(size)]), 0
        for j in np.flatnonzero(np.isin(doc, list(marked))).tolist():
            s = texts[doc[j]][start[j] : end[j]]
            if "@" in s or "://" in s:
                x = seg.vocabulary.ids(tokens(s))
                parts += [flat[done : at[j]], x]
                size[j], done = len(x), at[j + 1]
        flat = np.concatenate([*parts, flat[done:]])
    # A text without sentences is labelled as a whole.
    bare = [i for i in np.flatnonzero(wanted & ~np.isin(np.arange(len(texts)), doc)).tolist() if texts[i].strip()]
    for i in bare:
        x = seg.vocabulary.ids(tokens(texts[i]))
        flat, size, doc, pick = np.concatenate([flat, x]), np.append(size, len(x)), np.append(doc, i), np.append(pick, -1)
        start, end, prose = np.append(start, 0), np.append(end, len(texts[i])), np.append(prose, False)
    if not len(flat):
        return out, seg
    full = size > 0
    doc, size, pick, start, end, prose = doc[full], size[full], pick[full], start[full], end[full], prose[full]
    cut = np.concatenate([[0], np.cumsum(size)[:-1]])
    # Words vote by their letters; numbers carry no language.
    marginals, weight = model.marginals(flat, _runs(doc, size), seg.vocabulary)
    votes = np.add.reduceat(marginals * weight[:, None], cut, axis=0)
    total = votes.sum(axis=1)
    best = [LANGUAGES[k] for k in votes.argmax(axis=1).tolist()]
    sure = votes.max(axis=1) / np.maximum(total, 1e-9)
    for i, z, x in zip(doc.tolist(), total.tolist(), map(Sentence, start.tolist(), end.tolist(), prose.tolist(), best, sure.tolist(), pick.tolist())):
        if z > 0:
            out[i].append(x)
    return out, seg


def _runs(doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of each text, in the order in which the texts' sentences stand."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return np.add.reduceat(size, first)


def languages_of(row: list[Sentence]) -> list[tuple[str, float]]:
    """Languages with a whole sentence, by share of the text, with mean confidence."""
    size: dict[str, float] = {}
    conf: dict[str, float] = {}
    running = [x for x in row if x.prose]
    whole = [x for x in running if x.confidence >= (SURE if x.end - x.start >= SHORT.get(x.lang, 24) else SURE_SHORT)] or running or row
    for x in whole:
        n = x.end - x.start
        size[x.lang] = size.get(x.lang, 0) + n
        conf[x.lang] = conf.get(x.lang, 0) + x.confidence * n
    return [(k, conf[k] / size[k]) for k in sorted(size, key=lambda k: (-size[k], k))]


def detect(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, is_prose, lang, confidence, langs, segments`` for every row.

    ``segments`` are maximal stretches of one language with positions in code points of the text as given.
    """
    bm = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    def fn(ids: list, texts: list) -> list[list]:
        m = kept.setdefault("m", bm.value)
        pairs = [P.normalise_map(t) if t and t.strip() else ("", None) for t in texts]
        clean = [t for t, _ in pairs]
        prose_, lang, conf, langs, segs = [], [], [], [], []
        rows, seg = analyse(clean, m)
        for (t, back), row, verdict in zip(pairs, rows, seg.is_prose.tolist()):
            ls = languages_of(row)
            prose_.append(verdict if t else None)
            lang.append(ls[0][0] if ls else "und")
            conf.append(ls[0][1] if ls else 0.0)
            langs.append([k for k, _ in ls])
            merged: list[dict] = []
            for a, b, _, k, c, _ in row:
                if back is not None:
                    a, b = back[a], back[b]
                if merged and merged[-1]["lang"] == k:
                    x = merged[-1]
                    w, v = x["end_pos"] - x["start_pos"], b - a
                    x["confidence"] = (x["confidence"] * w + c * v) / max(1, w + v)
                    x["end_pos"] = b
                else:
                    merged.append({"start_pos": a, "end_pos": b, "lang": k, "confidence": c})
            segs.append(merged)
        return [ids, prose_, lang, conf, langs, segs]

    id_type = dict(docs.dtypes)[id_col]
    return map_columns(
        docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")),
        ["_i", "_t"],
        f"{id_col} {id_type}, is_prose boolean, lang string, confidence double, langs array<string>, segments array<struct<start_pos:long,end_pos:long,lang:string,confidence:double>>",
        fn,
    )


def found(docs: DataFrame) -> DataFrame:
    """Running-prose documents whose languages differ from the one the label names."""
    bm = docs.sparkSession.sparkContext.broadcast(train(docs))
    kept: dict = {}

    def fn(ids: list, texts: list, stated: list) -> list[list]:
        m = kept.setdefault("m", bm.value)
        clean = [P.normalise(t) for t in texts]
        oi, ol = [], []
        for i, s, row in zip(ids, stated, analyse(clean, m, prose_only=True)[0]):
            ks = {k for k, _ in languages_of(row)}
            s = re.split(r"[-_]", (s or "").strip().lower())[0]
            if ks and ks != ({s} if s and s != "und" else set()):
                oi += [i] * len(ks)
                ol += sorted(ks)
        return [oi, ol]

    src = docs.where("length(trim(text)) > 0")
    return map_columns(src, ["doc_id", "text", "lang"], "doc_id long, lang string", fn).distinct()
