"""Logistic regressions of all agents, ranks under masks, preference tests and null summaries, each against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ablation, logistic, resampling
from tidemark.plans import model_queries, stats_queries


def plain_logistic(x, y, rounds=200):
    """The optimum by plain Newton steps with halving, one model at a time."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    free = np.r_[np.ones(x.shape[1] - 1), 0.0]
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (w * w * free).sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (weight * (q - y)) + w * free
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(free), slope)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return 1 / (1 + np.exp(-(x @ w)))


def test_all_agents_at_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2]
    own = {"a": [i for i in range(120) if x[i, 0] + 0.2 * rng.normal() > 0.8], "b": [5], "c": [i for i in range(120) if i % 3]}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    labels = spark.createDataFrame([(a, i) for a, ids in own.items() for i in ids] + [("a", 9999), ("gone", 9999), ("c", 1)], "agent string, id long")
    rows = logistic.linear_scores(vectors, labels, batch=2).collect()
    assert len(rows) == 360
    for a, ids in own.items():
        want = plain_logistic(x, np.isin(np.arange(120), ids).astype(float))
        got = np.array([r.score for r in sorted((r for r in rows if r.agent == a), key=lambda r: r.id)])
        assert np.abs(got - want).max() < 1e-5


def test_ranks_under_masks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3)).round(1)
    x[7] = x[9]
    cols = ["u", "v", "w"]
    z = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, u double, v double, w double")
    own = {1: [0, 7, 9, 20], 2: [3, 4], 5: [30]}
    labels = spark.createDataFrame([(i, a) for a, ids in own.items() for i in ids], "id long, agent int")
    conditions = {"all": cols, "drop_u": ["v", "w"], "only_u": ["u"]}
    got = {(r.condition, r.agent): r for r in ablation.condition_metrics(z, labels, conditions).collect()}
    assert set(got) == {(c, a) for c in conditions for a in (1, 2)}  # one positive is too few
    for (c, a), r in got.items():
        at = [cols.index(k) for k in conditions[c]]
        p = x[own[a]][:, at].mean(0)
        size = np.linalg.norm(x[:, at], axis=1) * np.linalg.norm(p)
        score = np.round(np.where(size > 0, x[:, at] @ p / np.where(size > 0, size, 1), 0), 9)
        order = sorted(range(40), key=lambda i: (-score[i], i))
        ranks = [order.index(i) + 1 for i in own[a]]
        ap = np.mean([np.mean(np.isin(np.flatnonzero(score >= score[i]), own[a])) for i in own[a]])
        assert (r.n_pos, r.mrr_best) == (len(ranks), 1 / min(ranks)) and r.mean_rank == pytest.approx(np.mean(ranks)) and r.ap == pytest.approx(ap)


def test_deltas_need_all_conditions(spark):
    per = spark.createDataFrame([("raw", 1, 0.5), ("size", 1, 0.25), ("resid", 1, 0.75), ("raw", 2, 0.5)], "condition string, agent int, ap double")
    rows = ablation.condition_deltas(per, "resid", ["raw", "size"], ["ap"]).collect()
    assert [(r.agent, r.delta_raw, r.delta_size) for r in rows] == [(1, 0.25, 0.5)]


def test_paired_statistics_leave_out_small_conditions(spark):
    rows = [("all", a, 0.5 + a / 100) for a in range(12)] + [("less", a, 0.4 + a / 90) for a in range(12)] + [("few", a, 0.1) for a in range(4)]
    got = ablation.paired_statistics(spark.createDataFrame(rows, "condition string, agent int, ap double"), compared=["ap"], repeats=200).collect()
    assert [(r.condition, r.n_agents, r.sig_holm) for r in got] == [("less", 12, True)]
    d = np.array([0.4 + a / 90 - 0.5 - a / 100 for a in range(12)])
    assert got[0].median_delta == pytest.approx(np.median(d)) and got[0].w == 0 and got[0].p == pytest.approx(2 / 2**12) and got[0].ci_low <= np.median(d) <= got[0].ci_high


def test_accessibility_p(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    d = "/root/testdata/sf0.001"
    z = model_queries.residual_columns(model_queries.wide(spark, d)).cache()
    rows = model_queries.accessibility(z, model_queries.pairs(spark, d), repeats=300).collect()
    resid = [f"{y}_resid" for y in model_queries.PROBED]
    null = {}
    for r in resampling.top_k_null(z.select("id", *resid), resid, 10, 300, 1).collect():
        null.setdefault(r.feature, []).append(abs(r.null))
    data = {r.id: r for r in z.collect()}
    a = np.array([[r[c] for c in model_queries.SIZES] + [1.0] for r in data.values()])
    for y in model_queries.PROBED:
        b = np.array([r[y] for r in data.values()])
        assert np.allclose([r[f"{y}_resid"] for r in data.values()], b - a @ np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-9)
    for c in resid:
        ps = {r.agent: r[f"p_{c}"] for r in rows}
        for r in rows:
            assert ps[r.agent] == pytest.approx((1 + sum(v >= abs(r[c]) for v in null[c])) / 301)
        order = sorted(ps, key=lambda k: (ps[k], k))
        last = max((i for i, k in enumerate(order) if ps[k] <= 0.05 * (i + 1) / len(order)), default=-1)
        assert {r.agent for r in rows if r[f"bh_{c}"]} == set(order[: last + 1])
    z.unpersist()


def test_null_summary(spark):
    nulls = spark.createDataFrame([("m", i, i / 100, 0.5, 0.0) for i in range(99)], "mode string, rep int, mrr_best double, recall_5 double, ap double")
    seen = spark.createDataFrame([(0.985, 0.5, 0.1)], "mrr_best double, recall_5 double, ap double")
    rows = {r.metric: r for r in stats_queries.against_nulls(seen, nulls).collect()}
    assert rows["mrr_best"].p == 0.01 and rows["recall_5"].p == 1.0 and rows["ap"].p == 0.01
    assert rows["mrr_best"].holm_significant and rows["ap"].holm_significant and not rows["recall_5"].holm_significant
    assert rows["mrr_best"].null_mean == pytest.approx(0.49) and rows["ap"].null_std == 0


def test_folds_cover_all_rows(spark):
    seen, nulls = stats_queries.fold_run(spark, "/root/testdata/sf0.001", folds=2, repeats=5)
    assert sorted(r.fold for r in seen.collect()) == [0, 1]
    got = nulls.groupBy("mode", "fold").agg(F.count("*").alias("n"), F.max("mrr_best").alias("m")).collect()
    assert len(got) == 4 and all(r.n == 5 and 0 < r.m <= 1 for r in got)
