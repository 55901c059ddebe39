import random

import numpy as np
import pytest

from siltworks.llm import encoding as E, garbled as G
from tests.llm.test_encoding import CLEAN


@pytest.fixture
def model():
    bi, tri = E.grams("\n".join(CLEAN))
    codes, n = np.unique(E._codes("\n".join(CLEAN)), return_counts=True)
    count = lambda g, bits: np.bincount(g, minlength=1 << bits)
    return E.CharModel(count(bi, E.BI_BITS), count(tri, E.TRI_BITS), dict(zip(codes.tolist(), n.tolist())))


def _span_by_all_chains(span, left, right, model):
    base, best, gain, cur, seen = model.logp(left + span + right), span, 0.0, {span}, {span}
    for _ in range(3):
        cur = {r for s in cur for b, a in E.CHAINS if (r := E.undo(s, b, a)) is not None and r not in seen}
        for r in cur:
            seen.add(r)
            bad = any(E.unicodedata.category(c) in ("Cc", "Cn", "Co") or (c > "\x7f" and not E._PLAUSIBLE.match(c)) for c in r if c not in "\t\n\r")
            if r and not bad and (g := model.logp(left + r + right) - base) > gain:
                best, gain = r, g
    return best, gain


def _table_by_all_chains(p, model, margin):
    whole = E.undo_single_byte(p) if E.needs_table(p) else None
    if whole is not None and model.logp(whole) / len(whole) > model.logp(p) / len(p) + 0.5:
        return whole
    best, out = 3 * margin, p
    for b, a in E.BYTE_CHAINS:
        gain = 0.0
        for m in E.NONASCII.finditer(p) if a != "gb18030" else ():
            left, right, r = p[max(0, m.start() - 2) : m.start()], p[m.end() : m.end() + 2], E.undo(m.group(), b, a)
            if r is None:
                break
            gain += model.logp(left + r + right) - model.logp(left + m.group() + right) if r != m.group() else 0.0
            if gain < -30:
                break
        else:
            if gain > best:
                best, out = gain, E.NONASCII.sub(lambda m: E.undo(m.group(), b, a), p)
    return out


def _texts():
    rng = random.Random(2)
    for t in CLEAN:
        yield t
        for b, a in E.CHAINS + E.BYTE_CHAINS:
            yield t.encode(a, "ignore").decode(b, "ignore")
        yield "".join(rng.sample(t, len(t)))


def test_repairs_are_those_of_every_chain_tried(model):
    changed = 0
    for t in _texts():
        for m in E.NONASCII.finditer(t):
            k = (m.group(), t[max(0, m.start() - 2) : m.start()], t[m.end() : m.end() + 2])
            assert E.best_span(*k, model) == _span_by_all_chains(*k, model)
        fixed = E.table_repair(t, model, 0.5)
        assert fixed == _table_by_all_chains(t, model, 0.5)
        changed += fixed != t
    assert changed > 5


def test_chains_are_tried_once_a_span_and_clean_spans_are_not_scored(model, monkeypatch):
    undone, scored = [], []
    undo, logp = E.undo, E.CharModel.logp
    monkeypatch.setattr(E, "undo", lambda *k: undone.append(k) or undo(*k))
    monkeypatch.setattr(E.CharModel, "logp", lambda self, s: scored.append(s) or logp(self, s))
    span = "ęķļ"
    for i in range(50):
        assert E.best_span(span, f"{i:02d}", "ab", model) == (span, 0.0)
    assert len(undone) <= 2 * len(E.CHAINS) and not scored


def test_spans_of_a_batch_are_counted_before_they_are_scored(model, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "best_span", lambda s, a, b, m: seen.append(s) or (s, 1.0 if s == "é" else 2.0))
    top, hist = G._span_gains(["café noir " * 100, "café noir", "x" * 9, None], model, {})
    assert (top, hist) == (1.0, {200: 101}) and len(seen) == 2


def test_characters_are_counted_as_they_are():
    (kind, key, n), = G._count_partition(iter([(["aab", None, "é aa"],), (["a"],)]))
    assert {chr(k): c for t, k, c in zip(kind, key, n) if t == 2} == {"a": 5, "b": 1, "é": 1, " ": 6, "\n": 1}
    assert [n[kind == t].sum() for t in (0, 1)] == [12, 10]
