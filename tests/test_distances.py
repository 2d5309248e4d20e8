"""Ranked distances against brute force."""

import math

import duckdb
import numpy as np
import pytest

from tidemark.operators import distances
from tidemark.plans import ranking_queries

NAME = "W02_ascending_distance_rank"


@pytest.mark.parametrize("units", [None, 1, 2])
def test_distance_ranks_by_brute_force(spark, units):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0, 2.0]), (63, []), (64, [float("nan")] * 4), (65, [math.inf, 0.0, 0.0, 0.0]), (None, [0.0] * 4), (20, [9.0] * 4)]
    frame = spark.createDataFrame(rows, "id long, e array<float>").repartition(3)
    got = {}
    for r in distances.distance_ranks(frame, frame.filter("id % 20 = 0"), units, block=7).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.dist))
    want = {}
    for q, e in rows:
        for i, f in rows:
            if q is not None and i is not None and q % 20 == 0 and i != q:
                bad = e is None or f is None or None in e or None in f or len(e) != len(f)
                want.setdefault(q, []).append((None if bad else round(float(np.sqrt(np.sum((np.array(e) - np.array(f)) ** 2))), 9), i))
    assert set(got) == set(want) == {0, 20, 40, 60}
    key = lambda x: (x[0] is None, x[0] is not None and math.isnan(x[0]), 0.0 if x[0] is None or math.isnan(x[0]) else x[0], x[1])
    for q, pairs in want.items():
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(pairs) + 1))
        assert [str(x) for x in sorted(((d, i) for _, i, d in found), key=key)] == [str((d, i)) for _, i, d in found]
        assert [str((d, i)) for _, i, d in found] == [str(x) for x in sorted(pairs, key=key)]


def test_pairs_do_not_travel_and_null_vectors_rank_last(spark, tmp_path):
    rows = [(i, None if i == 7 else [float(i % 5), 0.5], 1) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = ranking_queries.QUERIES[NAME](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().index("MapInArrow") < 400  # nothing but projections above
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT q, id, dist, rank FROM ({ranking_queries.SQL[NAME]})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
