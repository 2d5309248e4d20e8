"""Forests of all agents, against trees grown one by one in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forests


def gini(neg, pos, up, down):
    n, p = neg * down, pos * up
    return 2 * n * p / (n + p) if n + p else 0.0


def plain_tree(bins, y, times, key, up, down, depth, k):
    """Leaf shares of one tree for each row, by recursion over the rows themselves."""
    out = np.full(len(bins), 0.5)

    def down_from(node, rows, level):
        w = times[rows]
        pos, neg = int(w[y[rows]].sum()), int(w[~y[rows]].sum())
        if pos + neg:
            out[rows] = np.float32(up * pos / (up * pos + down * neg))
        if level == depth or not pos or not neg:
            return
        best = (0.0, None, None)
        for c in forests.columns_of(np.array([key]), np.array([node]), bins.shape[1], k)[0]:
            for b in range(forests.BINS - 1):
                left = bins[rows, c] <= b
                lp, ln = int(w[left & y[rows]].sum()), int(w[left & ~y[rows]].sum())
                if lp + ln in (0, pos + neg):
                    continue
                gain = round((gini(neg, pos, up, down) - gini(ln, lp, up, down) - gini(neg - ln, pos - lp, up, down)) / (neg * down + pos * up), 12)
                if gain > best[0]:
                    best = (gain, c, b)
        if best[1] is not None:
            left = bins[rows, best[1]] <= best[2]
            down_from(2 * node + 1, rows[left], level + 1)
            down_from(2 * node + 2, rows[~left], level + 1)

    down_from(0, np.arange(len(bins)), 0)
    return out


def setting(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4)).round(2)
    x[:, 3] = 1.0  # a column without a cut
    own = {"a": [i for i in range(150) if x[i, 0] + 0.3 * rng.normal() > 1], "b": [7], "c": list(range(150)), "d": [i for i in range(150) if x[i, 1] * x[i, 2] > 0.4]}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    labels = spark.createDataFrame([(a, i) for a, ids in own.items() for i in ids] + [("gone", 999), (None, 3), ("b", 7), ("b", None)], "agent string, id long")
    return x, own, vectors, labels


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_forests_equal_plain_trees(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        x, own, vectors, labels = setting(spark)
        rows = forests.forest_scores(vectors.repartition(5), labels, trees=6, depth=4, seed=3, batch=3, slots=40).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    edges = forests.edges_of(vectors, 4)
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    assert bins.max() < forests.BINS and len(rows) == 600
    hashes = np.array([r.h for r in vectors.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()]).view(np.uint64)
    for i, a in enumerate(sorted(own)):
        y = np.isin(np.arange(150), own[a])
        up, down = 150 / (2 * y.sum()), 150 / (2 * max(150 - y.sum(), 1))
        want = np.zeros(150)
        for t in range(6):
            key = forests.mixed(forests.mixed(np.array([i * 6 + t], np.uint64) + np.uint64(3 << 32)) + np.uint64(1))
            want += plain_tree(bins, y, forests.draws(hashes, key)[:, 0], key[0], up, down, 4, 2) / 6
        got = np.array([r.score for r in sorted((r for r in rows if r.agent == a), key=lambda r: r.id)])
        assert np.abs(got - want).max() < 1e-6


def test_forests_learn(spark):
    """Area under the curve on rows that the forests did not see, close to that of the true rule."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 4))
    y = x[:, 0] * x[:, 1] > 0.3
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    labels = spark.createDataFrame([(1, i) for i in np.flatnonzero(y[:600]).tolist()], "agent int, id long")
    # Rows from 600 on carry no label; both halves come from one distribution, so unlabelled positives must rank above others.
    s = np.array([r.score for r in forests.forest_scores(vectors, labels, trees=30).orderBy("id").collect()])[600:]
    hidden = y[600:]
    above = (s[hidden][:, None] > s[~hidden][None, :]).mean()
    assert above > 0.75


def test_draws_are_poisson():
    n = forests.draws(np.arange(20_000, dtype=np.uint64), forests.mixed(np.arange(5, dtype=np.uint64)))
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03
    assert np.abs(np.corrcoef(n.T) - np.eye(5)).max() < 0.03


def test_nulls_and_empty_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), 2.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [5.0, 1.0])], "id long, x array<double>")
    labels = spark.createDataFrame([(9, 3), (8, 1)], "agent int, id long")
    rows = forests.forest_scores(vectors, labels, trees=5, depth=3).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.agent == 9 and r.id == 3}) == 1
    assert forests.forest_scores(vectors, labels.limit(0)).collect() == []
    assert forests.forest_scores(vectors.limit(0), labels).collect() == []


def test_samples_and_walks_by_tree():
    """What a pass over many rows is made of: a tree at a time, whole numbers for the draws, leaves left behind."""
    keys, trees = np.arange(5000, dtype=np.uint64) * np.uint64(77), forests.mixed(np.arange(3, dtype=np.uint64) + np.uint64(1))
    for t in range(3):
        row, times = forests.sample(keys, trees[t])
        want = forests.draws(keys, trees)[:, t]
        assert np.array_equal(row, np.flatnonzero(want)) and np.array_equal(times, want[row])
    grown = forests.Trees(trees[:1], 2)
    grown.column[0, [0, 2]], grown.cut[0, [0, 2]] = (1, 0), (4, 7)
    bins = np.array([[7, 8, 9, 0], [4, 5, 6, 9]], np.uint8)
    assert [x.tolist() for x in grown.walk(0, bins, np.arange(4), 2)] == [[1, 2, 3], [6, 6, 5]]
    assert [x.tolist() for x in grown.walk(0, bins, np.arange(4), 2, whole=True)] == [[0, 1, 2, 3], [1, 6, 6, 5]]
