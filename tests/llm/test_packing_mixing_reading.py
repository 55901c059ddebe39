import numpy as np
import pytest

from siltworks.llm import language as L, mixing as M, packing as K, reading as R, tokenizing as Z

from tests.llm.test_prose_language import PROSE


def test_assign_keeps_capacity():
    rng = np.random.default_rng(1)
    for cap in (64, 500):
        s = np.sort(rng.integers(1, cap + 1, size=400))[::-1]
        seq = K.assign(s, cap)
        used = np.bincount(seq, weights=s)
        assert used.max() <= cap and used.sum() == s.sum()
        big = int((s * 2 > cap).sum())
        assert len(np.unique(seq)) <= 1.15 * max(big, s.sum() / cap) + 2


def test_pack(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 7), (2, "x y", 7), (3, None, 7), (4, " ", 7), (5, "x y", 7)], "doc_id long, text string, piece long")
    specs = spark.createDataFrame([("s", 4), ("s", 4), ("bad", 0), (None, 3)], "pack_name string, capacity_tokens int")
    rows = K.pack(docs, specs).collect()
    n = dict(zip([1, 2, 5], Z.count_tokens(["a b c d e f g h i j", "x y", "x y"], Z.DEFAULT_VOCABULARY)))
    for i, want in n.items():
        own = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == i)
        assert sum(x for _, x in own) == want and [a for a, _ in own] == list(range(0, want, 4))
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 4
    f = K.fill_rates(K.pack(docs, specs)).collect()
    assert len(f) == 1 and f[0].containers == len(used) and f[0].fill_rate == pytest.approx(sum(n.values()) / (4 * len(used)))
    assert K.pack(docs.limit(0), specs).count() == 0


def test_mix(spark):
    rows = [(i, f"{'alpha beta' if i % 3 else 'gamma delta'} word{i % 11} and more text here", "big" if i % 3 else "small", None, "en") for i in range(300)]
    rows += [(1000, None, "big", None, None), (1001, "loose text without source", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, lang string")
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "gone", 0.1, 2), ("m", None, 0.3, 1), (None, "big", 0.3, 1)], "mix_name string, source string, target_share double, max_repeats int")
    r = M.rates(docs, t)
    got = r.collect()
    assert {x.domain for x in got} == {"big", "small"} and all(0 <= x.repeats <= (1 if x.domain == "big" else 3) for x in got)
    # A document without a source is placed by the classifier, blank texts are nowhere.
    assert [x.doc_id for x in got if x.source is None] == [1001] and all(x.domain == (x.source or x.domain) for x in got)
    s = {x.source: x for x in M.shares(r, t).collect()}
    assert s["gone"].tokens == 0 and s["gone"].actual_share == 0
    assert s["big"].actual_share == pytest.approx(5 / 9, abs=0.005) and s["small"].actual_share == pytest.approx(4 / 9, abs=0.005)
    assert all(abs(x.residual) < 0.005 for x in s.values())
    assert M.rates(docs.limit(0), t).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = np.clip(np.round(x + rng.normal(scale=0.4, size=200)) + 2, 1, 3)
    xs, ys = R.isotonic(x, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= -1e-12).all()
    assert np.isclose(np.mean([np.interp(v, xs, ys) for v in x]), y.mean(), atol=0.05)


def test_levels(spark):
    kid = "The cat sat on the mat. We ran to the park and we saw a dog. It was fun. I like the red ball. My mum made a cake."
    hard = "Notwithstanding considerable methodological heterogeneity, the epistemological presuppositions of contemporary interpretations necessitate fundamental reconsideration. Such institutional differentiation presupposes considerable conceptual generalisation."
    rows = [(1, kid * 3, "a"), (2, PROSE["en"] * 3, "a"), (3, hard * 3, "b"), (4, PROSE["de"], "b"), (5, None, None), (6, "* a\n* b", "a"), (2, PROSE["en"] * 3, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, reading_level string")
    labels = spark.createDataFrame([], "doc_id long, reading_level int")
    ranker = R.train(d, labels)
    model = L.fit([(k, " ".join([t] * 3)) for k, t in PROSE.items()] * 3 + [("en", hard + " The results of the study were not what they had been said to be.")] * 3)
    got = {r.doc_id: (r.english_prose, r.reading_level) for r in R.levels(d, ranker, model).collect()}
    assert got[1] == (True, 1) and got[2] == (True, 2) and got[3] == (True, 3)
    assert got[4] == (False, None) and got[5] == (False, None) and got[6] == (False, None)
    assert R.levels(d.limit(0), ranker, model).count() == 0


def test_held_out_accuracy(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ranker = R.train(docs, labels.where("doc_id % 2 = 0"))
    test = docs.join(labels.where("doc_id % 2 = 1 AND reading_level IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    p = R.levels(test, ranker, L.train(docs)).where("english_prose").select("doc_id", "reading_level").toPandas()
    t = pd.read_parquet(f"{sf}/labels.parquet").drop_duplicates().dropna(subset=["reading_level"])
    x = t.merge(p, on="doc_id", suffixes=("_t", "_p"))
    assert (x.reading_level_t == x.reading_level_p).mean() > 0.9


def test_sequences_that_can_be_emptied_are_closed():
    sizes = np.array([6, 6, 3, 3, 2])
    seq = K._close(np.array([0, 1, 2, 3, 3]), sizes, np.array([4, 4, 7, 5]), 10)
    used = np.bincount(seq, weights=sizes)
    assert used.max() <= 10 and (used > 0).sum() == 3
