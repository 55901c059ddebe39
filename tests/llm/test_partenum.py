import itertools
import random

import numpy as np
import pytest

from siltworks.functions.normalize import normalize_one, shingle_hashes
from siltworks.llm import partenum as Q


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            ws = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(ws) // 40))):
                j = rng.randrange(len(ws))
                op = rng.random()
                if op < 0.4:
                    ws[j] = rng.choice(vocab)
                elif op < 0.7:
                    ws.insert(j, rng.choice(vocab))
                elif len(ws) > 6:
                    del ws[j]
        else:
            ws = [rng.choice(vocab) for _ in range(rng.choice([4, 6, 8, 12, 20, 40, 90, 300]))]
        rows.append((i, " ".join(ws)))
    return rows


def brute(rows, t=0.8):
    s = {i: set(shingle_hashes(normalize_one(x)).tolist()) for i, x in rows if x}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_found(spark, seed):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id_a, r.doc_id_b) for r in Q.found(d).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("size", [4, 5, 7, 9, 12, 14, 20, 33, 60, 150, 400])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        base = rng.integers(1, 1 << 62, size=size, dtype=np.uint64)
        out = int(rng.integers(0, size + 1))
        grow = int(rng.integers(0, size // 3 + 1))
        a = np.unique(base)
        b = np.unique(np.concatenate([base[min(out, size // 9) :], rng.integers(1, 1 << 62, size=grow, dtype=np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig, who = Q.signatures([a, b])
        if j >= 0.8:
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, 9), (2, "", 9), (3, "a b c d", 9), (4, "a b c d", 9), (5, "One two three four five.", 9), (6, "one, two THREE four five", 9), (6, "one, two THREE four five", 9), (7, long, 9), (8, long + " end", 9), (9, long, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id long").toDF("doc_id", "text", "rep")
    got = sorted((r.doc_id_a, r.doc_id_b) for r in Q.found(d).collect())
    assert got == [(5, 6), (7, 8), (7, 9), (8, 9)]
    assert Q.found(d.limit(0)).count() == 0


def test_hot_group_of_copies(spark):
    t = " ".join(f"x{i}" for i in range(40))
    d = spark.createDataFrame([(i, t if i < 60 else f"{i} " + t[i % 7 :][::-1]) for i in range(90)], "doc_id long, text string")
    pairs, member = Q.similar_pairs(d)
    assert {(r.id, r.rep) for r in member.collect()} >= {(i, 0) for i in range(60)}
    assert sum(r.doc_id_a < 60 and r.doc_id_b < 60 for r in Q.found(d).collect()) == 60 * 59 // 2


def test_counts_of_huge_sets_do_not_wrap():
    import pyarrow as pa

    own = np.repeat(np.array([5, 9]), 70_000).astype(np.int64)
    sig = np.concatenate([np.arange(70_000), np.arange(70_000)]).astype(np.uint32)
    block = lambda i: [1, np.array([i]).tobytes(), np.array([70_000], np.uint32).tobytes(), sig[own == i].tobytes(), b"", b""]
    t = pa.table([pa.array(c, type=f.type) for c, f in zip(zip(block(5), block(9)), Q._BLOCK)], schema=Q._BLOCK)
    assert Q._candidates(t).select(["a", "b"]).to_pylist() == [{"a": 5, "b": 9}]
    text = " ".join(f"w{i}" for i in range(70_010))
    rows = pa.RecordBatch.from_pydict({"id": [1], "t": [text]}, schema=pa.schema([("id", pa.int64()), ("t", pa.string())]))
    (out,) = Q._blocks(0, 0.8)(iter([rows]))
    n = np.frombuffer(out.column(2)[0].as_py(), np.uint32)
    assert n.sum() * 4 == len(out.column(3)[0].as_py()) and n.sum() > 65_535


def test_sorted_slices_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    own, sig = rng.integers(0, 300, 4000).astype(np.int64), rng.integers(0, 1 << 32, 700, dtype=np.uint64)[rng.integers(0, 700, 4000)].astype(np.uint32)
    want = {tuple(sorted(p)) for p in Q._agreeing(own, sig).tolist()}
    monkeypatch.setattr(Q, "AT_ONCE", 500)
    assert {tuple(sorted(p)) for p in Q._agreeing(own, sig).tolist()} == want


def test_groups(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["x"])
    rows = [(1, " ".join(base)), (2, near), (3, " ".join(base)), (4, "too short"), (5, "too short"), (6, None), (7, " ".join(base[::-1]))]
    got = Q.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_id, r.links) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert Q.groups(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0
