import math

import pytest
from pyspark.sql import functions as F

from siltworks.operators import models, planning, runs


def test_parse_and_last_match(spark):
    lines = ["Training step 3, Loss: 2.5, Smoothed Loss: 2.75, lr: 1e-4] x", "Training step 4, Loss: bad, Smoothed Loss: 1, lr: 1", "other", "Training step 5"]
    got = runs.parse_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in got] == [(3, 2.5, 2.75, 1e-4)]
    d = spark.createDataFrame([("Training step 1, Loss: 5\rTraining step 2, Loss: 4.5",), ("",), (None,)], "o string")
    assert [r[0] for r in d.select(runs.last_match("o", runs.TRAIN_LOSS)).collect()] == [4.5, None, None]


def test_schedules(spark):
    d = spark.range(0, 130).select(F.col("id").alias("it"), planning.cosine_rate(F.col("id"), 1.0, 0.1, 10, 100).alias("c"), planning.stable_decay_rate(F.col("id"), 1.0, 0.1, 10, 50, 40).alias("w"))
    for r in d.collect():
        it = r.it
        c = it / 10 if it < 10 else 0.1 if it > 100 else 0.1 + 0.5 * (1 + math.cos(math.pi * (it - 10) / 90)) * 0.9
        w = it / 10 if it < 10 else 1.0 if it < 60 else 0.1 + 0.9 * (1 - (it - 60) / 40) if it < 100 else 0.1
        assert r.c == pytest.approx(c) and r.w == pytest.approx(w)


def test_plan(spark):
    p = planning.isoflop_plan(spark).collect()
    assert len(p) == 21
    for r in p:
        n = int((r.flops_budget / (6 * r.ratio)) ** 0.5)
        d = int(r.flops_budget / (6 * n))
        assert (r.model_size_params, r.training_tokens, r.tokens_per_param) == (n, d, d // n)
        assert r.train_hours == round(6 * float(n) * float(d) / (989e12 * 0.2) / 3600, 1)


def test_trailing_and_summary(spark):
    rows = [("r", i, float(i) if i % 3 else None, None, 0.1 * i, 9.0 - i if i % 4 == 0 else None, None) for i in range(12)]
    h = spark.createDataFrame(rows, "run_id string, step int, train_loss double, smoothed_loss double, lr double, eval_loss double, logged_at timestamp")
    h = runs.distinct_steps(h.union(h))
    t = {r.step: r.trailing for r in runs.trailing_mean(h, width=3).collect()}
    assert t[5] == pytest.approx(4.5) and t[0] is None
    s = runs.summary(h).first()
    assert (s.steps, s.min_train_loss, s.final_train_loss, s.min_eval_loss, s.final_eval_loss, s.initial_lr) == (12, 1.0, 11.0, 1.0, 1.0, 0.0)


def test_classifier_and_evaluation(spark):
    rows = [(i, ("good fine prose " if i % 2 else "cheap buy click ") + f"w{i % 7}", "pos" if i % 2 else "neg") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    m = models.train_text_classifier(d)
    p = models.predict(m, d)
    e = models.evaluate(p.withColumn("g", F.col("pred.label")), "label", "g").first()
    assert (e.n, e.precision_at_1) == (60, 1.0)
    lang = spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate([("the cat and the dog ran home", "en"), ("der hund und die katze gehen", "de")] * 10)], "doc_id long, text string, lang string")
    q = models.predict(models.train_language_id(lang), lang).collect()
    assert all(r.pred.label == r.lang and 0 < r.pred.score <= 1 for r in q)


def test_linear_score(spark):
    d = spark.createDataFrame([(1, "Good good"), (2, "none"), (3, None)], "doc_id long, text string")
    w = spark.createDataFrame([("good", 1.0)], "token string, w double")
    got = {r.doc_id: r.score for r in models.linear_score(d, w, 0.0).collect()}
    assert got == pytest.approx({1: 1 / (1 + math.exp(-2)), 2: 0.5, 3: 0.5})
