"""Problem 9: mixing sources to target weights.

A classifier of words, shard family and language, fitted on rows with a stated source, predicts how
likely each source is.  A stated source is further evidence: it is taken to be right with probability
``LABEL_TRUST``, because the shares asked for are those of stated sources; rows without one, or with one
that the classifier does not know, are placed by the classifier alone.  Document rates between 0 and the
most copies allowed then minimise the squared relative error of the expected totals of the sources, by
projected gradient steps until the worst error is under ``TOLERANCE``: each step is one distributed sum
of tokens by source, and every document folds the short list of residuals into its own rate.  Rates become
whole copies by systematic rounding along the sizes within each source, so that the token totals stay.

The total is the largest that every named source with documents can fill within its cap.  Sources
without documents get nothing and their missing share is reported, not given to others.

The classifier is fitted on at most ``TRAIN_ROWS`` documents per source.

Defined results: blank texts have no tokens and no copies; a document without a stated source counts to
its likeliest one; target rows with a null name, source or share are left out; ``max_repeats`` under 1
counts as 0 copies; a fit that stops short of the tolerance is told by the residuals of :func:`shares`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltworks.llm.batches import map_columns
from siltworks.llm.tokenizing import DEFAULT_VOCABULARY, count_tokens
from siltworks.operators import ordered
from siltworks.session import durable

TRAIN_ROWS = 200
BITS = 14
#: Probability that a stated source is right, worst relative error of the fit, and most steps to it.
LABEL_TRUST, TOLERANCE, MOST_STEPS = 0.999, 1e-4, 100
#: Parts of a copy that rates are rounded to before copies are counted.
_UNIT = 1 << 20
_WORD = re.compile(r"\w+")


def features(text: str | None, shard: str | None, lang: str | None) -> np.ndarray:
    """Hashed words, the shard's family and the language; the source itself is no feature."""
    ws = [w.lower() for w in _WORD.findall(text or "")]
    names = [*ws, f"\x01h:{(shard or '').split('-')[0]}", f"\x01l:{lang}"]
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in names])


class Domains:
    """Multinomial logistic regression on presence of hashed features, meta features counted strongly."""

    META = 8.0

    def __init__(self, names: list[str]):
        self.names = names
        self.at = {n: i for i, n in enumerate(names)}
        self.w = np.zeros((1 << BITS, len(names)), dtype=np.float32)
        self.b = np.zeros(len(names), dtype=np.float32)

    @staticmethod
    def vector(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, meta = np.unique(f[:-2]), f[-2:]
        return np.concatenate([words, meta]), np.concatenate([np.full(len(words), 1.0 / np.sqrt(len(words) + 1.0)), np.full(2, Domains.META / 3)])

    def logits(self, f: np.ndarray) -> np.ndarray:
        i, v = self.vector(f)
        return v @ self.w[i] + self.b

    def posterior(self, f: np.ndarray) -> np.ndarray:
        z = self.logits(f)
        e = np.exp(z - z.max())
        return e / e.sum()

    def membership(self, f: np.ndarray, stated: str | None) -> np.ndarray:
        """The posterior given the features and what source is stated."""
        q = self.posterior(f)
        if stated in self.at and len(self.names) > 1:
            c = np.full(len(q), (1 - LABEL_TRUST) / (len(q) - 1))
            c[self.at[stated]] = LABEL_TRUST
            q = (q + 1e-6) * c
        return q / q.sum()

    def fit(self, fs: list[np.ndarray], ys: list[int], epochs: int = 8, rate: float = 0.5, seed: int = 3) -> "Domains":
        rng = np.random.default_rng(seed)
        rows = [self.vector(f) for f in fs]
        for ep in range(epochs):
            for j in rng.permutation(len(rows)):
                i, v = rows[j]
                z = v @ self.w[i] + self.b
                e = np.exp(z - z.max())
                g = -e / e.sum()
                g[ys[j]] += 1
                step = rate / (1 + ep)
                self.w[i] += (step * v[:, None] * g[None, :]).astype(np.float32) / (v @ v)
                self.b += (0.1 * step * g).astype(np.float32)
        return self


def train(docs: DataFrame) -> Domains:
    w = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"))
    rows = (
        docs.where("source IS NOT NULL AND length(trim(text)) > 0")
        .select("source", "text", "shard", "lang", "doc_id")
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= TRAIN_ROWS)
        .drop("r")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r.source, r.doc_id))
    names = sorted({r.source for r in rows}) or ["none"]
    return Domains(names).fit([features(r.text, r.shard, r.lang) for r in rows], [names.index(r.source) for r in rows])


def posteriors(docs: DataFrame, model: Domains, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, domain, n_tokens, p`` for documents with tokens; ``domain`` is the stated source
    or, without one that is known, the likeliest."""
    bm = docs.sparkSession.sparkContext.broadcast(model)

    def fn(ids: list, texts: list, sources: list, shards: list, langs: list) -> list[list]:
        m = bm.value
        n = count_tokens(texts, path)
        p = [m.membership(features(t, h, k), s) if x else np.zeros(len(m.names)) for t, s, h, k, x in zip(texts, sources, shards, langs, n)]
        own = [s if s in m.at else m.names[int(v.argmax())] for s, v in zip(sources, p)]
        return [ids, sources, own, n, [v.tolist() for v in p]]

    return map_columns(docs, ["doc_id", "text", "source", "shard", "lang"], "doc_id long, source string, domain string, n_tokens long, p array<double>", fn).where("n_tokens > 0")


def _fold(p: np.ndarray, cap: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Document rates after the given projected steps."""
    r = np.clip(p @ start, 0, cap)
    for s in steps:
        r = np.clip(r - p @ s, 0, cap)
    return r


def rates(docs: DataFrame, targets: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``mix_name, doc_id, source, domain, n_tokens, rate, repeats`` for documents of a mix's sources."""
    t = targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share IS NOT NULL").distinct().collect()
    model = train(docs)
    base = durable(posteriors(docs, model, path))
    k = len(model.names)
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in t:
        mixes.setdefault(r.mix_name, {})[r.source] = (float(r.target_share), max(0, int(r.max_repeats or 0)))
    names = sorted(mixes)

    def table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
        n = batch.column(2).to_numpy().astype(float)
        p = batch.column(3).flatten().to_numpy().reshape(-1, k)
        return n, p, batch.column(1).to_pylist()

    def total(rate: Callable[[np.ndarray, list, int], np.ndarray], rows: int) -> np.ndarray:
        """Tokens by source, for each of ``rows`` ways to rate documents: one distributed sum."""

        def summed(batches):
            acc = np.zeros((rows, k))
            for b in batches:
                if b.num_rows:
                    n, p, own = table(b)
                    for i in range(rows):
                        acc[i] += (n * rate(p, own, i)) @ p
            yield pa.RecordBatch.from_pydict({"m": list(range(rows)), "v": acc.tolist()}, schema=pa.schema([("m", pa.int32()), ("v", pa.list_(pa.float64()))]))

        out = np.zeros((rows, k))
        parts = base.select("doc_id", "domain", "n_tokens", "p").mapInArrow(summed, "m int, v array<double>")
        for r in parts.select("m", F.posexplode("v").alias("d", "v")).groupBy("m", "d").agg(F.sum("v").alias("v")).collect():
            out[r.m, r.d] = r.v
        return out

    have = dict(zip(model.names, total(lambda p, own, i: np.ones(len(p)), 1)[0]))
    want, start, cap_of = {}, {}, {}
    for m, by in mixes.items():
        # A source that only the doubt about other labels fills has no documents.
        live = [s for s, (share, reps) in by.items() if share > 0 and reps > 0 and have.get(s, 0) >= 1]
        whole = min((by[s][1] * have[s] / by[s][0] for s in live), default=0.0)
        want[m] = np.array([by[s][0] * whole if s in live else 0.0 for s in model.names])
        start[m] = np.array([want[m][j] / max(have[s], 1.0) for j, s in enumerate(model.names)])
        cap_of[m] = {s: float(by[s][1]) for s in live}
    steps: dict[str, list[np.ndarray]] = {m: [] for m in names}

    def caps(own: list, m: str) -> np.ndarray:
        return np.array([cap_of[m].get(s, 0.0) for s in own])

    worst, before = np.inf, np.inf
    for _ in range(MOST_STEPS if names else 0):
        now = total(lambda p, own, i: _fold(p, caps(own, names[i]), start[names[i]], steps[names[i]]), len(names))
        rel = {m: np.where(want[m] > 0, now[i] / np.maximum(want[m], 1e-9) - 1.0, 0.0) for i, m in enumerate(names)}
        before, worst = worst, max(float(np.abs(v).max(initial=0.0)) for v in rel.values())
        # Caps may leave an error that no step mends.
        if worst < TOLERANCE or worst > 0.999 * before:
            break
        steps = {m: [*steps[m], rel[m] * start[m]] for m in names}
    out = pa.schema([("mix_name", pa.string()), ("doc_id", pa.int64()), ("domain", pa.string()), ("n_tokens", pa.int64()), ("rate", pa.float64()), ("source", pa.string())])

    def final(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, p, own = table(b)
            for m in names:
                cap = caps(own, m)
                r = _fold(p, cap, start[m], steps[m])
                keep = pa.array(cap > 0)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(n)).filter(keep), *(c.filter(keep) for c in (b.column(0), b.column(1), b.column(2), pa.array(r), b.column(4)))], schema=out)

    f = base.select("doc_id", "domain", "n_tokens", "p", "source").mapInArrow(final, "mix_name string, doc_id long, domain string, n_tokens long, rate double, source string")
    unit = F.round(F.col("rate") * _UNIT).cast("long")
    d = ordered.running_total(f, ["mix_name", "domain", "n_tokens", "doc_id"], unit, "_at")
    copies = F.floor((F.col("_at") + unit + _UNIT // 2) / _UNIT) - F.floor((F.col("_at") + _UNIT // 2) / _UNIT)
    return d.select("mix_name", "doc_id", "source", "domain", "n_tokens", "rate", copies.cast("long").alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, tokens and documents used per mix and source, and by how much the actual
    share misses what can be reached."""
    by = mixed.groupBy("mix_name", F.col("domain").alias("source")).agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count_if(F.col("repeats") > 0).alias("docs_used"), F.max("repeats").alias("most_repeats")
    )
    t = targets.where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share IS NOT NULL").select("mix_name", "source", "target_share", "max_repeats").distinct()
    j = t.join(by, ["mix_name", "source"], "left").na.fill({"tokens": 0, "docs_used": 0, "most_repeats": 0})
    w = Window.partitionBy("mix_name")
    # Rows of a mix are its sources, a handful.
    total = F.sum("tokens").over(w)
    reach = F.sum(F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)).over(w)
    d = j.withColumn("actual_share", F.try_divide(F.col("tokens") * F.lit(1.0), total)).withColumn("reachable_share", F.when(F.col("tokens") > 0, F.col("target_share") / reach).otherwise(0.0))
    return d.withColumn("residual", F.col("actual_share") - F.col("reachable_share"))
