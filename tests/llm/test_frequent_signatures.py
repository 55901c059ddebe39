import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from siltworks.functions.normalize import TokenWords, normalize_one, shingle_hashes, shingle_sets
from siltworks.llm import partenum as Q


def _held(ids, sets, sigs):
    """What meets at signatures: the ids' sketches, once a signature."""
    cells, n = Q.sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
    rows = [(i, s, int(n[j]), cells[j].tobytes()) for s in sigs for j, i in enumerate(ids)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "sig", "n", "sk"])


def _block(sig, count):
    return pa.table([pa.array(c, type=f.type) for c, f in zip(([5], [np.arange(count).tobytes()], [np.full(count, len(sig), np.uint32).tobytes()], [np.tile(np.array(sig, np.uint32), count).tobytes()], [b""], [b""]), Q._BLOCK)], schema=Q._BLOCK)


@pytest.mark.parametrize("count", [20, 40, 80])
def test_texts_of_a_frequent_signature_do_not_become_pairs(count):
    """80 texts that share three signatures were 3,160 rows; one row a text will do."""
    out = Q._candidates(_block([7, 8, 9], count))
    assert out.num_rows == count and out.column("b").null_count == count
    assert {s >> 32 for s in out.column("sig").to_pylist()} == {5}
    assert sorted(out.column("a").to_pylist()) == list(range(count))
    assert Q._candidates(_block([7], 3)).column("sig").null_count == 3


def test_frequent_signatures_lose_no_similar_pair(monkeypatch):
    rng = random.Random(3)
    sets = []
    for _ in range(150):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.5 else np.array([rng.getrandbits(63) for _ in range(rng.choice([6, 30, 200, 30_000]))], np.uint64)
        keep = base[rng.randrange(1 + len(base) // 6) :]
        sets.append(np.unique(np.concatenate([keep, np.array([rng.getrandbits(63) for _ in range(rng.randrange(1 + len(base) // 8))], np.uint64)])))
    ids = rng.sample(range(10**6), len(sets))
    want = set()
    for (i, s), (j, t) in itertools.combinations(zip(ids, sets), 2):
        both = len(np.intersect1d(s, t, assume_unique=True))
        if both >= 0.8 * (len(s) + len(t) - both):
            want.add((min(i, j), max(i, j)))
    monkeypatch.setattr(Q, "AT_ONCE", 100)
    p = Q._hot_pairs(0.8)(_held(ids, sets, [4, 9]))
    got = list(zip(*(c.to_pylist() for c in p.columns)))
    assert want and want <= set(got) and len(set(got)) == len(got)
    # Sketches of sets of 30,000 are void and tell nothing.
    small = {i for i, s in zip(ids, sets) if len(s) < 5000}
    assert sum({a, b} <= small for a, b in got) < 2 * sum({a, b} <= small for a, b in want)


def test_common_phrases(spark):
    """Texts of common sentences share signatures by the hundred; the pairs are those of brute force."""
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(40)) for _ in range(12)) for _ in range(12)]
    rows = [(i, ". ".join(rng.sample(lines, 5) + [f"only {i} here {i * 7} and {i * 11} there"])) for i in range(160)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(25)]
    s = {i: set(shingle_hashes(normalize_one(t)).tolist()) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-12}
    got = {(r.doc_id_a, r.doc_id_b) for r in Q.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) >= 25 and got == want


def test_shingles_of_many_texts_at_once():
    texts = [None, "", "a b c d", "One, two THREE four five.", "ΑΣ Ά̈Σ' x—y 'Σ' İI q w e", "don't stop — it's we're they'd", "我们 在月港，住了 一个 星期 非常 喜欢 社区", "same same same same same same same"]
    known = TokenWords()
    for _ in range(2):
        flat, sizes = shingle_sets(texts, known)
        want = [shingle_hashes(normalize_one(t or "")) for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and (flat == np.concatenate(want)).all()
        known.held = known.MOST + 1
    assert shingle_sets([], known)[1].tolist() == []
