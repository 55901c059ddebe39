"""What similarity joins move: neither sets nor pairs that only share a common phrase."""

import random
import re

import numpy as np
import pytest

from siltworks.functions.normalize import normalize_one, shingle_hashes
from siltworks.operators import dedup, partenum
from tests.test_dedup import brute


def folders(spark):
    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    from pathlib import Path

    return set(Path(re.sub("^file:", "", base.get())).glob("table-*")) if base.isDefined() else set()


def written(spark, run):
    """The result of ``run`` and the bytes it left in the checkpoint folder."""
    before = folders(spark)
    got = run()
    return got, sum(f.stat().st_size for d in folders(spark) - before for f in d.glob("*.parquet"))


def random_texts(n=300, words=400):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))) for i in range(n)]
    return rows + [(1000 + i, t + " end") for i, t in rows[:5]]


def phrased_texts(n=400):
    """Texts of few sentences: nearly all of them share some, few are similar."""
    rng = random.Random(5)
    lines = [" ".join(f"{chr(97 + k)}{rng.randrange(400)}" for _ in range(12)) for k in range(20)]
    rows = [(i, ". ".join(rng.sample(lines, 4) + [" ".join(f"o{i}x{j}" for j in range(20))])) for i in range(n)]
    return rows + [(1000 + i, rows[i][1] + " end") for i in range(25)]


def test_jaccard_pairs_does_not_store_the_sets(spark, docs):
    rows = random_texts()
    sets = sum(8 * (len(t.split()) - 4) for _, t in rows)
    got, size = written(spark, lambda: {(r.lo, r.hi) for r in dedup.similarity_pairs(docs(rows)).collect()})
    assert got == brute(rows) == {(i, 1000 + i) for i in range(5)}
    assert size < sets / 2


def test_pairs_of_common_phrases_are_those_of_brute_force(spark, docs):
    rows = phrased_texts()
    got = {(r.lo, r.hi): r.jaccard for r in dedup.similarity_pairs(docs(rows)).collect()}
    want = brute(rows)
    s = {i: set(shingle_hashes(normalize_one(t)).tolist()) for i, t in rows}
    assert len(want) >= 25 and got == {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in want}


@pytest.mark.parametrize("n, threshold", [(5, 0.8), (3, 0.6), (2, 0.9), (7, 0.5)])
def test_pairs_of_other_sizes_and_thresholds(docs, n, threshold):
    rng = random.Random(n)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 6, 9, 15, 40])))) for i in range(60)]
    rows += [(100 + i, " ".join(t.split()[: -1 - i % 5] + ["z"] * (i % 3))) for i, t in rows]
    s = {i: set(shingle_hashes(normalize_one(t), n).tolist()) for i, t in rows}
    d = docs(rows)
    reps = {r.rep for r in dedup.set_classes(d, n).collect() if s[r.rep]}
    want = {(a, b) for a in reps for b in reps if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}
    assert want and {(r.lo, r.hi) for r in dedup.similarity_pairs(d, n, threshold).collect()} == want


def test_null_ids_texts_and_classes(docs):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(4, None), (3, "few words"), (None, t), (7, t.upper()), (6, t + "!"), (8, t + " more"), (9, "")]
    got = {(r.id, r.rep) for r in dedup.set_classes(docs(rows)).collect()}
    assert got == {(4, 3), (3, 3), (9, 3), (None, 6), (7, 6), (6, 6), (8, 8)}
    assert {(r.lo, r.hi) for r in dedup.similarity_pairs(docs(rows)).collect()} == {(6, 8)}


@pytest.mark.parametrize("places", [1 << 15, 1 << 24])
def test_bitmaps_tell_ids_apart(spark, monkeypatch, places):
    monkeypatch.setattr(partenum, "PLACES", places)
    rng = random.Random(1)
    every = rng.sample(range(-(10**12), 10**12), 20_000)
    some = set(every[:6000])
    d = spark.createDataFrame([(i, str(i)) for i in every], "id long, t string")
    ids = spark.createDataFrame([(i,) for i in some], "id long")
    assert sorted(r.id for r in partenum.among(d, ids).collect()) == sorted(some)
    assert sorted(r.id for r in partenum.not_among(d, ids).collect()) == sorted(set(every) - some)
    assert partenum.among(d, ids.limit(0)).count() == 0 and partenum.not_among(d, ids.limit(0)).count() == len(every)
    # A table's fixed share of ids beyond those sought is let through, no more.
    assert partenum._marked(d, ids).where("_may").count() <= (8000 if places > 1 << 20 else 20_000)


def test_sorted_slices_give_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    own, sig = rng.integers(0, 300, 4000).astype(np.int64), rng.integers(0, 1 << 32, 700, dtype=np.uint64)[rng.integers(0, 700, 4000)].astype(np.uint32)
    want = {tuple(sorted(p)) for p in partenum._agreeing(own, sig).tolist()}
    monkeypatch.setattr(partenum, "AT_ONCE", 500)
    assert {tuple(sorted(p)) for p in partenum._agreeing(own, sig).tolist()} == want


def test_fuzzy_components_does_not_store_the_sets(spark, docs):
    rows = random_texts() + [(2000, "few words"), (2001, None)]
    got, size = written(spark, lambda: {r.doc_id: r.component for r in dedup.fuzzy_components(docs(rows)).collect()})
    assert got == {i: i - 1000 if 1000 <= i < 2000 else min(i, 2000) for i, _ in rows}
    assert size < sum(8 * len(t.split()) for _, t in rows if t) / 2


def test_fuzzy_dedup_of_common_phrases_does_not_store_the_sets(spark, docs):
    rows = phrased_texts()
    got, size = written(spark, lambda: {r.doc_id: r.text for r in dedup.fuzzy_dedup(docs(rows)).collect()})
    assert got == {i: t for i, t in rows if i < 1000}
    assert size < sum(8 * len(t.split()) for _, t in rows)


def test_freed_shuffles_leave_the_table_and_the_setting(spark):
    from siltworks.session import FREE_SHUFFLES, durable

    was = spark.conf.get(FREE_SHUFFLES, None)
    d = spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()
    t = durable(d, free=True)
    assert spark.conf.get(FREE_SHUFFLES, None) == was
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, d.collect())) == [(k, 100) for k in range(10)]
