"""Preferences of first rows against plain arithmetic."""

import numpy as np
import pytest

from tidemark.operators import preference, resampling


def test_preferences(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3)).round(1)  # with ties
    scores = {a: rng.normal(size=30).round(1) for a in ("p", "q", "few")}
    own = {"p": {1, 2, 3}, "q": {4, 5}, "few": {6}}
    cols = ["u", "v", "w"]
    z = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, u double, v double, w double").cache()
    table = spark.createDataFrame([(a, i, float(s), i in own[a]) for a, v in scores.items() for i, s in enumerate(v)], "agent string, id long, score double, positive boolean")
    seen = preference.preferences(z, table, cols, ks=(3, 5, 30, 31))
    got = {(r.agent, r.k, r.feature): r for r in seen.collect()}
    assert set(got) == {(a, k, c) for a in ("p", "q") for k in (3, 5, 30) for c in cols}
    for (a, k, c), r in got.items():
        top = sorted(range(30), key=lambda i: (-scores[a][i], i))[:k]
        v, rest = x[top, cols.index(c)], np.delete(x[:, cols.index(c)], top)
        assert r.score == pytest.approx(v.mean()) and (r.n_positives, r.n_candidates) == (len(own[a]), 30)
        assert r.delta is None if k == 30 else r.delta == pytest.approx(np.sign(v[:, None] - rest[None]).mean())
    tested = preference.preference_tests(z, seen.filter("k < 30"), cols, (3, 5), repeats=200).collect()
    assert len(tested) == 12
    for k in (3, 5):
        null = {}
        for r in resampling.top_k_null(z, cols, k, 200, 1).collect():
            null.setdefault(r.feature, []).append(abs(r.null))
        for a in ("p", "q"):
            rows = sorted((r for r in tested if (r.agent, r.k) == (a, k)), key=lambda r: (r.p, r.feature))
            assert all(r.p == pytest.approx((1 + sum(v >= abs(r.score) for v in null[r.feature])) / 201) for r in rows)
            holm = np.minimum(1, np.maximum.accumulate([r.p * (3 - i) for i, r in enumerate(rows)]))
            assert [r.holm for r in rows] == pytest.approx(holm.tolist())
    z.unpersist()
