"""Nulls against brute force, and p-values against known ones."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, resampling, stats, vectors
from tidemark.plans import catalog


def test_permutations_are_bijections():
    for n in (1, 2, 5, 100, 4097):
        a = resampling.permuted(np.arange(n), n, np.full(n, 7, np.uint64))
        assert sorted(a.tolist()) == list(range(n))
    first = resampling.permuted(np.zeros(60000, np.int64), 6, np.arange(60000, dtype=np.uint64))
    assert np.bincount(first, minlength=6).min() > 9500


def test_dense_index(spark):
    got = sorted(r["index"] for r in resampling.dense_index(spark.range(500).union(spark.range(20)), "id").collect())
    assert got == list(range(500))


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    """With adaptive execution off, partitions stay apart, as they do on large tables."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", was)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("fold", [None, 4])
def test_permutation_null_by_brute_force(spark, fold, adaptive):
    rng = np.random.default_rng(1)
    z = {i: rng.normal(size=3) for i in range(40)}
    z[7] = z[3]
    labels = [(f"a{i % 3}", i) for i in range(0, 40, 2)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in z.items()], "id long, z array<double>")
    tested = None if fold is None else frame.select("id").filter(F.col("id") % fold == 0)
    out = resampling.permutation_null(frame, spark.createDataFrame(labels, "agent string, id long"), 3, repeats=3, seed=5, tested=tested, block=7, room=2)
    got = {(r.rep, r.agent): sorted(x for x in r.ranks) for r in out.groupBy("rep", "agent").agg(F.collect_list("rank").alias("ranks")).collect()}
    index = {r["id"]: r["index"] for r in resampling.dense_index(frame, "id").collect()}
    back = {v: k for k, v in index.items()}
    for rep in range(3):
        key = np.array([spark.range(1).select(F.xxhash64(F.lit(5), F.lit(rep))).first()[0]], np.int64).view(np.uint64)
        to = lambda i: int(resampling.permuted(np.array([index[i]]), 40, key)[0])  # noqa: B023, E731
        for agent in ("a0", "a1", "a2"):
            own = [i for a, i in labels if a == agent]
            train, test = (own, own) if fold is None else ([i for i in own if i % fold], [i for i in own if i % fold == 0])
            proto = np.mean([z[back[to(i)]] for i in train], axis=0)
            pool = [to(i) for i in z if fold is None or i % fold == 0]
            cos = {v: round(float(z[back[v]] @ proto / np.linalg.norm(z[back[v]]) / np.linalg.norm(proto)), 8) for v in pool}
            order = sorted(pool, key=lambda v: (-cos[v], v))
            assert got.get((rep, agent), []) == sorted(order.index(to(i)) + 1 for i in test)


def test_random_null_draws_ranks_without_replacement(spark):
    positives = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "agent string, id long")
    rows = resampling.random_null(positives, 12, repeats=200).collect()
    for rep in range(200):
        ranks = [r["rank"] for r in rows if r.rep == rep and r.agent == "a"]
        assert len(set(ranks)) == 10 and set(ranks) <= set(range(1, 13))
    assert abs(np.mean([r["rank"] for r in rows if r.agent == "a"]) - 6.5) < 0.2
    assert ranking.metrics(resampling.random_null(positives, 12, repeats=2), ["rep", "agent"]).count() == 4


def test_top_k_null_has_the_population_mean(spark):
    values = spark.range(30).select("id", (F.col("id") * 1.0).alias("x"))
    null = [r["null"] for r in resampling.top_k_null(values, ["x"], 5, repeats=2000).collect()]
    assert len(null) == 2000 and abs(np.mean(null) - 14.5) < 0.4 and abs(np.var(null) - 899 / 12 / 5 * 25 / 29) < 1.5


def test_exact_and_normal_p():
    for n1, n2, u in ((3, 4, 9), (5, 4, 12), (2, 6, 11)):
        sums = [sum(s) - n1 * (n1 + 1) / 2 for s in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        assert stats.rank_sum_p(u, n1, n2, 1.0, 0, "greater") == pytest.approx(np.mean([x >= u for x in sums]))
    sigma = math.sqrt(120 * 121 * 241 / 24)
    assert stats.signed_rank_p(422, 120, sigma, 1, "less") == pytest.approx(2.2e-17, rel=0.01)
    signs = [sum(k for k, s in zip(range(1, 7), c) if s) for c in itertools.product((0, 1), repeat=6)]
    assert stats.signed_rank_p(4, 6, 1.0, 0, "less") == pytest.approx(np.mean([s <= 4 for s in signs]))
    assert stats.correlation_p(0.5, 10) == pytest.approx(0.14111328125) and stats.correlation_p(None, 10) is None and stats.correlation_p(1.0, 5) == 0.0
    assert stats.rank_sum_p(0.0, 0, 5, None, 0, "two-sided") is None


def test_block_extremes(spark, adaptive):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    x[3] = 0
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    right = left.select((F.col("id") % 3).alias("group"), "e")
    for measure in ("cosine", "distance"):
        for r in vectors.block_extremes(left, right, measure, block=7).collect():
            others = x[r.group :: 3]
            size = np.linalg.norm(others, axis=1) * np.linalg.norm(x[r.id])
            want = max(np.where(size > 0, others @ x[r.id] / np.where(size > 0, size, 1), 0)) if measure == "cosine" else min(np.linalg.norm(others - x[r.id], axis=1))
            assert r.value == pytest.approx(want, abs=1e-7)


def test_permutations_of_uneven_sizes():
    sizes = np.repeat([1, 2, 3, 7, 64, 65, 1000], [1, 2, 3, 7, 64, 65, 1000])
    x = np.concatenate([np.arange(n) for n in (1, 2, 3, 7, 64, 65, 1000)])
    to = resampling.permuted(x, sizes, np.full(len(x), 11, np.uint64))
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(to[sizes == n].tolist()) == list(range(n))


def test_matched_null_by_brute_force(spark, adaptive):
    rng = np.random.default_rng(4)
    strata = {i * 3: int(i > 3) + int(i > 20) for i in range(30)}  # 4, 17 and 9 rows
    rows = [(a, i, float(round(rng.choice([0.1, 0.2, rng.random()]), 9)), (i + len(a)) % 4 == 0) for a in ("a", "bb") for i in strata]
    scored = spark.createDataFrame(rows, "agent string, id long, score double, positive boolean")
    ranks = ranking.ranked(scored, ["agent"])
    by_s = spark.createDataFrame(list(strata.items()), "id long, s int")
    out = resampling.matched_null(ranks, by_s, repeats=4, seed=9)
    got = {(r.rep, r.agent): sorted(r.x) for r in out.groupBy("rep", "agent").agg(F.collect_list(F.struct("rank", "n_above", "tp_above")).alias("x")).collect()}
    order = {s: sorted((i for i in strata if strata[i] == s), key=lambda i: (i % 256, i)) for s in range(3)}
    known = {(r.agent, r.id): r for r in ranks.collect()}
    for rep in range(4):
        for agent in ("a", "bb"):
            now = []
            for a, i, _, positive in rows:
                if a == agent and positive:
                    ids = order[strata[i]]
                    key = np.array([spark.range(1).select(F.xxhash64(F.lit(9), F.lit(rep), F.lit(strata[i]))).first()[0]], np.int64).view(np.uint64)
                    r = known[agent, ids[int(resampling.permuted(np.array([ids.index(i)]), len(ids), key)[0])]]
                    now.append((r["rank"], r.n_above))
            assert [tuple(x) for x in got[rep, agent]] == sorted((k, n, sum(m <= n for _, m in now)) for k, n in now)


def test_noise_sweep_by_brute_force(spark, adaptive):
    rng = np.random.default_rng(6)
    z = {i * 7: rng.normal(size=3) for i in range(25)}
    labels = [(i % 2, i * 7) for i in range(0, 25, 3)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in z.items()], "id long, z array<double>")
    out = resampling.noise_sweep(frame, spark.createDataFrame(labels, "agent int, id long"), 3, (0.0, 0.5), 3, seed=2, block=6)
    got = {(r.draw, r.agent): sorted(r.x) for r in out.groupBy("draw", "agent").agg(F.collect_list("rank").alias("x")).collect()}
    ids = np.array(sorted(z))
    for draw in range(6):
        now = np.array([z[i] for i in ids]) + (0.5 if draw >= 3 else 0.0) * resampling.noise(draw, ids, 3, 2)
        for agent in (0, 1):
            own = [i for a, i in labels if a == agent]
            proto = now[np.isin(ids, own)].mean(0)
            score = np.round(now @ proto / np.linalg.norm(now, axis=1) / np.linalg.norm(proto), 9)
            order = sorted(ids, key=lambda i: (-score[list(ids).index(i)], i))
            assert got[draw, agent] == sorted(order.index(i) + 1 for i in own)
    x = resampling.noise(3, np.arange(20000), 4)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02 and abs(np.corrcoef(x.T)[0, 1]) < 0.03


@pytest.mark.parametrize("depth", [0, 2, 30])
def test_best_matched_ranks_equal_those_of_all_draws(spark, depth, adaptive):
    rng = np.random.default_rng(8)
    strata = {i: None if i == 5 else i % 3 for i in range(30)}
    rows = [(a, i, float(rng.choice([0.1, 0.2, round(rng.random(), 9)])), (i + len(a)) % 7 == 0) for a in ("a", "bb") for i in strata]
    scored = spark.createDataFrame(rows, "agent string, id long, score double, positive boolean")
    by_s = spark.createDataFrame(list(strata.items()), "id long, s int")
    ranks = ranking.ranked(scored, ["agent"])
    want = {(r.rep, r.agent): r.best for r in resampling.matched_null(ranks, by_s, 6).groupBy("rep", "agent").agg(F.min("rank").alias("best")).collect()}
    top = ranking.best_ranked(scored, ["agent"], F.lit(depth)).filter(F.col("rank") <= depth)
    got = resampling.matched_best(scored, top, scored.filter("positive").select("agent", "id"), by_s, 6)
    assert {(r.rep, r.agent): r.best for r in got.collect()} == want and len(want) == 12


def test_permutations_go_back():
    sizes = np.repeat([1, 7, 65, 1000], [1, 7, 65, 1000])
    x, key = np.concatenate([np.arange(n) for n in (1, 7, 65, 1000)]), np.arange(1073, dtype=np.uint64) % np.uint64(3)
    assert resampling.permuted(resampling.permuted(x, sizes, key), sizes, key, back=True).tolist() == x.tolist()


@pytest.mark.parametrize("wanted", [0, 3, 40])
def test_first_rows_are_ranked_as_among_all(spark, wanted):
    rng = np.random.default_rng(9)
    rows = [(a, i, s, i % k == 0) for a, k in (("a", 9), ("b", 50)) for i, s in enumerate([None, float("nan"), 0.3, 0.3, 0.3, *rng.uniform(-1, 1, 45).round(9).tolist()], 1)]
    scored = spark.createDataFrame(rows, "agent string, id long, score double, positive boolean")
    full = {(r.agent, r.id): r for r in ranking.ranked(scored, ["agent"]).collect()}
    got = ranking.best_ranked(scored, ["agent"], F.lit(wanted), ranges=16).collect()
    for agent in ("a", "b"):
        mine = sorted((r["rank"], r.id, r.positive, r.p_before, r.n_pos) for r in got if r.agent == agent)
        order = sorted((r["rank"], i, r.positive) for (a, i), r in full.items() if a == agent)
        total = sum(p for _, _, p in order)
        assert mine == [(k, i, p, sum(q for _, _, q in order[: k - 1]), total) for k, i, p in order[: len(mine)]]
        assert any(p for _, _, p, _, _ in mine) and (len(mine) == 50 or sum(not p for _, _, p, _, _ in mine) >= wanted)


def test_contaminated_by_brute_force(spark, adaptive):
    pool = [(a, i, i - 3 * a) for a, m in ((1, 40), (2, 7), (3, 1)) for i in range(10, 10 + m)]
    frame = spark.createDataFrame(pool, "agent int, id long, rank long").repartition(3)
    got = sorted((r.level, r.rep, r.agent, r.n, r.best, r.hits) for r in resampling.contaminated(frame, (0.0, 0.1, 0.5), 13, chunks=4).collect())
    want = []
    for agent in (1, 2, 3):
        for rep in range(13):
            order = sorted((hashlib.md5(f"3|{rep}|{a}|{i}".encode()).hexdigest(), k) for a, i, k in pool if a == agent)
            for level in (0.1, 0.5):
                some = [k for _, k in order[: math.floor(len(order) * level + 1e-9)]]
                if some:
                    want.append((level, rep, agent, len(some), min(some), sum(k <= 10 for k in some)))
    assert got == sorted(want)


def test_contamination_orders_no_draws_in_windows(spark):
    plan = catalog.queries()["T18_contamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "md5" not in plan
