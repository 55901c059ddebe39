import random

import pytest

from siltworks.operators import ordered, sampling, tokens


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, rng.choice("abc"), rng.randint(0, 40)) for i in rng.sample(range(1000), 200)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, g string, n long").repartition(7)


def test_running_total_and_numbers(spark, rows):
    d = frame(spark, rows)
    got = {r.doc_id: r.total_before for r in ordered.running_total(d, ["doc_id"], d.n).collect()}
    s, want = 0, {}
    for i, _, n in sorted(rows):
        want[i] = s
        s += n
    assert got == want
    num = {r.doc_id: r.rn for r in ordered.row_number(d, ["doc_id"]).collect()}
    assert num == {i: k + 1 for k, (i, _, _) in enumerate(sorted(rows))}


@pytest.mark.parametrize("limit", [1, 37, 100, 10**6])
def test_greedy_shards(spark, rows, limit):
    got = {r.doc_id: r.shard for r in ordered.greedy_shards(frame(spark, rows), ["doc_id"], "n", limit).collect()}
    want, shard, filled = {}, 0, 0
    for i, _, n in sorted(rows):
        want[i] = shard
        filled += n
        if filled >= limit:
            shard, filled = shard + 1, 0
    assert got == want


def test_budgets(spark, rows):
    d = frame(spark, rows)
    got = sorted(r.doc_id for r in sampling.token_budget(d, ["doc_id"], "n", 300).collect())
    want, s = [], 0
    for i, _, n in sorted(rows):
        if s < 300:
            want.append(i)
        s += n
    assert got == want
    assert sampling.token_budget(d.where("doc_id < 0"), ["doc_id"], "n", 300).count() == 0
    g = sampling.group_budget(d, "g", ["doc_id"], "n", 300, 3).collect()
    for k in "abc":
        own = sorted((i, n) for i, x, n in rows if x == k)
        s, w = 0, []
        for i, n in own:
            if s < 100:
                w.append(i)
            s += n
        assert sorted(r.doc_id for r in g if r.g == k) == w


def test_split_quota_turns(spark, rows):
    d = frame(spark, rows)
    s = sampling.exact_split(d, "doc_id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 180, "valid": 20}
    q = sampling.file_quota(d, "g", ["doc_id"], 10, 3).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in q} == {"a": 4, "b": 3, "c": 3}
    t = sampling.round_robin(d, "g", ["doc_id"]).collect()
    for k in "abc":
        assert [r.turn for r in sorted((r for r in t if r.g == k), key=lambda r: r.doc_id)] == list(range(sum(x == k for _, x, _ in rows)))
    assert sampling.random_k(d, "doc_id", 5).count() == 5


def test_windows(spark):
    d = spark.createDataFrame([(1, list(range(10))), (2, [1, 2, 3]), (3, []), (4, list(range(7)))], "doc_id long, tokens array<int>")
    w = {(r.doc_id, r.start): (r.x, r.y) for r in tokens.eval_windows(d, 3).collect()}
    assert w == {
        (1, 0): ([0, 1, 2], [1, 2, 3]), (1, 3): ([3, 4, 5], [4, 5, 6]), (1, 6): ([6, 7, 8], [7, 8, 9]),
        (4, 0): ([0, 1, 2], [1, 2, 3]), (4, 3): ([3, 4, 5], [4, 5, 6]),
    }
    assert {r.doc_id for r in tokens.rank_stripe(d, ["doc_id"], 1, 2).collect()} == {2, 4}
    assert {r.doc_id: r.batch for r in tokens.batches(d, ["doc_id"], 3, 1).collect()} == {1: 0, 2: 0, 3: 0}
    e = tokens.encode(d.selectExpr("doc_id", "if(doc_id = 3, '', 'a b c') AS text"), lambda ts: [[len(w) for w in t.split()] for t in ts], max_length=2)
    assert {r.id: r.tokens for r in e.collect()} == {1: [1, 1], 2: [1, 1], 4: [1, 1]}


def test_draws_keep_each_files_order(spark):
    d = spark.createDataFrame([(f, i * 4) for f in range(5) for i in range(20)], "doc_id long, start int")
    r = tokens.train_draws(d, 1).orderBy("arrival").collect()
    for f in range(5):
        assert [x.start for x in r if x.doc_id == f] == [i * 4 for i in range(20)]
    assert len({x.doc_id for x in r[:20]}) > 2
    assert [x.arrival for x in tokens.train_draws(d, 1).orderBy("arrival").collect()] == [x.arrival for x in r]


def test_interleaving(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2] if i < 6 else "a", 10) for i in range(10)], "doc_id long, g string, n long")
    got = [(r.g, r.turn) for r in sampling.interleaved_budget(d, "g", ["doc_id"], "n", 55).orderBy("turn", "g").collect()]
    assert got == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2), ("b", 2)]
