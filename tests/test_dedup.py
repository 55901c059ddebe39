import itertools
import random

import pytest

from siltworks.functions.normalize import normalize_one, shingle_hashes
from siltworks.operators import dedup


def test_line_dedup_drops_every_copy(docs):
    rows = [(1, "menu\nabout\n"), (2, "menu\nabout\n"), (3, "- back\nown line\n"), (4, "own words\n"), (5, "menu"), (6, None), (7, ""), (8, "x\r\ny\r\n"), (9, "y\n")]
    got = {r.doc_id: r.text for r in dedup.line_dedup(docs(rows)).collect()}
    assert got == {1: "", 2: "", 3: "- back\nown line\n", 4: "own words\n", 5: "menu", 6: None, 7: "", 8: "x\n", 9: ""}


def test_exact_dedup_keeps_first(docs):
    rows = [(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None)]
    assert sorted(r.doc_id for r in dedup.exact_dedup(docs(rows)).collect()) == [1, 2, 4]


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            ws = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        rows.append((i, " ".join(ws)))
    return rows


def brute(rows, t=0.8):
    s = {i: set(shingle_hashes(normalize_one(x)).tolist()) for i, x in rows if x is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= t * len(s[a] | s[b])}


def test_pairs_and_components_equal_brute_force(docs):
    rows = corpus()
    want = brute(rows)
    d = docs(rows)
    classes = {r.id: r.rep for r in dedup.set_classes(d).collect()}
    got = {(r.lo, r.hi) for r in dedup.similarity_pairs(d).collect()}
    reps = set(classes.values())
    assert got == {(a, b) for a, b in want if a in reps and b in reps}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    empty = [i for i, t in rows if len(t.split()) < 5]
    for a, b in [*want, *zip(empty, empty[1:])]:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    comp = {r.doc_id: r.component for r in dedup.fuzzy_components(d).collect()}
    assert comp == {i: find(i) for i, _ in rows}
    kept = sorted(r.doc_id for r in dedup.fuzzy_dedup(d).collect())
    assert kept == sorted({find(i) for i, _ in rows})


def test_long_chain_is_one_component(spark):
    n = 200
    v = spark.createDataFrame([(i,) for i in range(n + 2)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "lo long, hi long")
    got = {r.id: r.component for r in dedup.components(v, e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, n + 1: n + 1}
    none = dedup.components(v, e.where("lo < 0"))
    assert all(r.id == r.component for r in none.collect())


def test_minhash_and_bands(docs):
    import hashlib

    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f h"), (4, "few words")]
    sig = {(r.id, r.seed): r.value for r in dedup.minhash(docs(rows), 4).collect()}
    grams = ["a b c d e", "b c d e f", "c d e f g"]
    assert sig[1, 2] == min(hashlib.md5(f"2:{g}".encode()).hexdigest() for g in grams)
    assert {i for i, _ in sig} == {1, 2, 3}
    with pytest.raises(ValueError):
        dedup.lsh_candidates(dedup.minhash(docs(rows), 4), 4, 3)


def test_greedy_is_not_transitive(docs):
    base = [f"t{i}" for i in range(400)]
    near = lambda ws, k: ws[k:] + [f"n{k}{i}" for i in range(k)]
    rows = [(1, " ".join(base)), (2, " ".join(base[::-1])), (3, "quite other words here"), (4, " ".join(base)), (5, " ".join(near(base, 300)))]
    got = sorted(r.doc_id for r in dedup.greedy_dedup(docs(rows)).collect())
    assert got == [1, 3, 5]
    buckets = {}
    for r in dedup.sketch_buckets(docs(rows)).collect():
        buckets.setdefault(r.id, set()).add(r.bucket)
    assert buckets[1] & buckets[2] and not buckets[1] & buckets[3]


def test_greedy_equals_a_walk_in_order(docs):
    import random

    rng = random.Random(9)
    base = [[f"b{k}w{i}" for i in range(60)] for k in range(4)]
    rows = []
    for i in range(1, 90):
        ws = list(base[rng.randrange(4)])
        for _ in range(rng.choice((0, 1, 2, 6, 15))):
            ws[rng.randrange(60)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(ws)))
    buckets = {}
    for r in dedup.sketch_buckets(docs(rows)).collect():
        buckets.setdefault(r.id, set()).add(r.bucket)
    kept, taken, texts = [], set(), set()
    for i, t in rows:
        if t not in texts and not buckets[i] & taken:
            kept.append(i)
            taken |= buckets[i]
        texts.add(t)
    assert sorted(r.doc_id for r in dedup.greedy_dedup(docs(rows)).collect()) == kept


def test_two_levels_and_empty(docs, spark):
    rows = [(1, "a b c", "f1"), (2, "a b c", "f2"), (3, "x y z", "f2")]
    d = spark.createDataFrame(rows, "doc_id long, text string, f string")
    assert sorted(r.doc_id for r in dedup.two_level_dedup(d, "f").collect()) == [1, 3]
    assert dedup.two_level_dedup(d.where("doc_id < 0"), "f").count() == 0
    assert dedup.fuzzy_components(d.where("doc_id < 0")).count() == 0
