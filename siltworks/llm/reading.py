"""Problem 10: reading level of documents.

A linear pairwise ranker is learned from pairs of documents graded differently, on syntax and
vocabulary features of their sentences; its scores are calibrated into levels by isotonic
regression.  A document's features are word-weighted medians over its sentences, so that the level
is that of most of the text.

At most ``TRAIN_ROWS`` graded documents are used for fitting, with a few graded sample texts so that
tiny tables still give a usable model.

Defined results: text that is not running prose wholly in English (null and blank text too) has a
null level, for the ranker knows English only; ratings
of one document are averaged; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from siltworks.llm import language as L, prose as P
from siltworks.llm.batches import map_columns
from siltworks.llm.crf import Crf

TRAIN_ROWS = 1500
_VOWELS = re.compile(r"[aeiouyäöüéèêëáíóúàâîïôûõãœæ]+", re.I)
_ABSTRACT = re.compile(r"(?:tion|sion|ity|ism|ness|ment|ance|ence|logy|isation|ization|ical|ological|ative|ive|ous|ise|ize|ises|izes|ially|ally|ically|hood|ship|ations|ities|ences|ances|isms|ments)$")
_SUBORDINATE = frozenset("which that whereas although though because while since unless whether whom whose whereby insofar inasmuch notwithstanding if when until".split())

SAMPLES = {
    1: [
        "The cat sat on the mat. It was a sunny day and we ran to the park. I saw a big red ball. My dog likes to play.",
        "We went to the farm and we saw a cow and a pig and then we had lunch. The sun was hot. Can you see the bird?",
    ],
    2: [
        "The council announced on Monday that the old library will reopen in spring after repairs that cost about two million pounds. Residents said they were pleased with the decision.",
        "Visitors who take the coastal road should allow plenty of time, because traffic is heavy during the summer and parking near the harbour is limited.",
    ],
    3: [
        "The epistemological implications of this methodological heterogeneity necessitate a fundamental reconsideration of the theoretical presuppositions underlying contemporary interpretations of institutional differentiation.",
        "Notwithstanding the considerable statistical uncertainty, the observed correlation constitutes substantial evidence against the proposed deterministic characterisation of macroeconomic equilibria.",
    ],
}


class _Words:
    """Feature rows of the numbered words of a vocabulary, each computed once."""

    def __init__(self) -> None:
        self.of: tuple[int, int] | None = None

    def rows(self, ids: np.ndarray, voc: P.Vocabulary) -> np.ndarray:
        if self.of != (id(voc), voc.generation):
            self.of = (id(voc), voc.generation)
            self.table = np.zeros((4096, 9), dtype=np.float32)
            self.known = np.zeros(4096, dtype=bool)
        n = len(voc.words)
        if n > len(self.known):
            more = max(n, 2 * len(self.known)) - len(self.known)
            self.table = np.concatenate([self.table, np.zeros((more, 9), dtype=np.float32)])
            self.known = np.concatenate([self.known, np.zeros(more, dtype=bool)])
        for j in np.unique(ids[~self.known[ids]]).tolist():
            w = voc.words[j]
            n = len(w)
            syl = max(1, len(_VOWELS.findall(w)))
            self.table[j] = (n, syl, n > 6, syl >= 3, syl >= 5, n <= 4, n > 6 and bool(_ABSTRACT.search(w)), w in P._ALL_COMMON, w in _SUBORDINATE)
            self.known[j] = True
        return self.table[ids]


_WORDS = _Words()


def doc_features(texts: list[str], seg: P.Segments, doc: np.ndarray, sentence: np.ndarray) -> list[list[float] | None]:
    """Per text the word-weighted medians over its chosen sentences, given by their numbers in the order
    of the texts, of: mean letters and syllables, shares of long, of polysyllabic, of very polysyllabic, of
    short, of abstract, of common and of subordinating words, commas per word, log of length, and the
    longest word.  Texts without a chosen sentence of three words have none."""
    out: list[list[float] | None] = [None] * len(texts)
    size = seg.at[sentence + 1] - seg.at[sentence]
    long = size >= 3
    doc, sentence, size = doc[long], sentence[long], size[long]
    if not len(doc):
        return out
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) + np.repeat(seg.at[sentence] - starts, size)
    r = _WORDS.rows(seg.ids[place], seg.vocabulary)
    commas = [texts[d].count(",", a, b) + texts[d].count(";", a, b) for d, a, b in zip(doc.tolist(), seg.start[sentence].tolist(), seg.end[sentence].tolist())]
    n = size.astype(np.float64)
    x = np.empty((len(size), 12))
    x[:, :9] = np.add.reduceat(r, starts, axis=0) / n[:, None]
    x[:, 9] = np.array(commas) / n
    x[:, 10] = np.log1p(n)
    x[:, 11] = np.maximum.reduceat(r[:, 0], starts) / 10.0
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    half = np.add.reduceat(n, first) / 2
    f = np.empty((len(first), 12))
    for k in range(12):
        o = np.lexsort((x[:, k], group))
        cum = np.cumsum(n[o])
        base = np.concatenate([[0], cum])[first]
        f[:, k] = x[o[first + np.add.reduceat(cum - base[group] < half[group], first)], k]
    for d, v in zip(doc[first].tolist(), f.tolist()):
        out[d] = v
    return out


def features_of(texts: list[str], running: bool = True) -> list[list[float] | None]:
    """Features of a batch of texts over their running sentences, or over all."""
    seg = P.segment_all(texts)
    own = np.flatnonzero(seg.prose) if running else np.arange(len(seg.doc))
    return doc_features(texts, seg, seg.doc[own], own)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step fit of ``y`` on ``x``, as knots."""
    o = np.argsort(x, kind="stable")
    val: list[float] = []
    wt: list[float] = []
    left: list[float] = []
    right: list[float] = []
    for a, b in zip(x[o], y[o]):
        val.append(float(b))
        wt.append(1.0)
        left.append(float(a))
        right.append(float(a))
        while len(val) > 1 and val[-2] >= val[-1]:
            v, w = val.pop(), wt.pop()
            val[-1] = (val[-1] * wt[-1] + v * w) / (wt[-1] + w)
            wt[-1] += w
            right[-2] = right[-1]
            left.pop()
            right.pop()
    xs = [v for pair in zip(left, right) for v in pair]
    ys = [v for v in val for _ in (0, 1)]
    return np.array(xs), np.array(ys)


class Ranker:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.mean, self.scale, self.w, self.xs, self.ys = mean, scale, w, xs, ys

    def score(self, f: list[float]) -> float:
        return float(((np.array(f) - self.mean) / self.scale) @ self.w)

    def level(self, f: list[float]) -> tuple[int, float]:
        """Level 1 to 3 and the calibrated value."""
        v = float(np.interp(self.score(f), self.xs, self.ys))
        return int(min(3, max(1, np.floor(v + 0.5)))), v


def fit(feats: list[list[float]], levels: list[float], pairs: int = 20_000, epochs: int = 200, seed: int = 5) -> Ranker:
    x, y = np.array(feats, dtype=float), np.array(levels, dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    i, j = rng.integers(len(y), size=pairs), rng.integers(len(y), size=pairs)
    ok = y[i] > y[j]
    d = z[i[ok]] - z[j[ok]]
    w = np.zeros(x.shape[1])
    for _ in range(epochs):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))
        w += 0.5 * ((p @ d) / max(1, len(d)) - 0.01 * w)
    s = z @ w
    return Ranker(mean, scale, w, *isotonic(s, y))


def _sample_rows() -> tuple[list[list[float]], list[float]]:
    f, y = [], []
    for k, ts in SAMPLES.items():
        f += features_of(ts, running=False)
        y += [float(k)] * len(ts)
    return f, y


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    g = labels.where("reading_level BETWEEN 1 AND 3").groupBy("doc_id").agg(F.avg("reading_level").alias("y"))
    src = docs.select("doc_id", "text").join(g, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def fn(ys: list, texts: list) -> list[list]:
        return [ys, features_of([P.normalise(t or "") for t in texts])]

    rows = map_columns(src, ["y", "text"], "y double, f array<double>", fn).where("f IS NOT NULL").collect()
    f, y = _sample_rows()
    return fit(f + [r.f for r in rows], y + [r.y for r in rows])


def levels(docs: DataFrame, ranker: Ranker, model: Crf, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, english_prose, reading_level, reading_score`` (and ``keep``) per row."""
    bm = docs.sparkSession.sparkContext.broadcast((ranker, model))
    kept: dict = {}

    def fn(ids: list, texts: list, *rest: list) -> list[list]:
        r, m = kept.setdefault("m", bm.value)
        clean = [P.normalise(t) if t and t.strip() else "" for t in texts]
        rows, seg = L.analyse(clean, m, prose_only=True)
        eng = [p and [k for k, _ in L.languages_of(row)] == ["en"] for row, p in zip(rows, seg.is_prose.tolist())]
        own = [(d, x.number) for d, row in enumerate(rows) if eng[d] for x in row if x.prose]
        doc, sentence = (np.array(v, dtype=np.int64) for v in zip(*own)) if own else (np.zeros(0, dtype=np.int64),) * 2
        lev, sc = [], []
        for f in doc_features(clean, seg, doc, sentence):
            k, v = r.level(f) if f else (None, None)
            lev.append(k)
            sc.append(v)
        return [ids, eng, lev, sc, *rest]

    types = dict(docs.dtypes)
    ddl = "doc_id long, english_prose boolean, reading_level long, reading_score double" + "".join(f", {k} {types[k]}" for k in keep)
    return map_columns(docs, ["doc_id", "text", *keep], ddl, fn)


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    src = docs.where("text IS NOT NULL")
    return levels(src, train(docs, labels), L.train(docs)).where("english_prose AND reading_level IS NOT NULL").select("doc_id", "reading_level").distinct()


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per source and level."""
    x = levels(docs.where("length(trim(text)) > 0"), train(docs, labels), L.train(docs), keep=("source",)).where("english_prose")
    return x.groupBy("source", "reading_level").agg(F.count("*").alias("docs"), F.avg("reading_score").alias("mean_score"))
