"""Hand-sized cases with known answers, and properties."""

import hashlib
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import bootstrap, forests, models, ranking, splits, stats, structure, vectors


def one(df):
    return df.collect()[0]


def ranked(spark, rows):
    df = spark.createDataFrame([("a", i, s, p) for i, (s, p) in enumerate(rows)], "agent string, id int, score double, positive boolean")
    return ranking.metrics(ranking.ranked(df, ["agent"]), ["agent"])


def test_rank_metrics(spark):
    r = one(ranked(spark, [(0.9, False), (0.8, True), (0.7, False), (0.6, True)]))
    assert (r.mrr_best, r.mrr_mean, r.recall_1, r.recall_3, r.mean_rank, r.ap) == (0.5, 0.375, 0.0, 0.5, 3.0, 0.5)


def test_tied_scores_share_precision(spark):
    assert one(ranked(spark, [(1.0, False), (1.0, True), (0.0, False)])).ap == 0.5


def test_average_precision_needs_both_kinds(spark):
    assert one(ranked(spark, [(0.5, True), (0.4, True)])).ap is None
    assert ranked(spark, [(0.5, False)]).count() == 0


def test_perfect_ranking_and_order_of_rows(spark):
    rows = [(1 - i / 10, i < 3) for i in range(8)]
    a, b = one(ranked(spark, rows)), one(ranked(spark, rows))
    assert a.mrr_best == a.ap == 1.0 and a == b


def test_ranks_do_not_depend_on_ranges(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), "id", (F.sin("id") * 0.99).alias("score"), (F.col("id") % 7 == 0).alias("positive"))
    a = ranking.ranked(df, ["g"], ranges=1).select("id", "rank", "n_above", "tp_above").collect()
    b = ranking.ranked(df, ["g"], ranges=97).select("id", "rank", "n_above", "tp_above").collect()
    assert sorted(a) == sorted(b)


def test_constant_column_has_zero_z(spark):
    z = vectors.zscore(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(r.z_a, r.z_b) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]


def test_cliffs_delta_and_symmetry(spark):
    df = spark.createDataFrame([("g", 2.0, True), ("g", 3.0, True), ("g", 1.0, False), ("g", 2.0, False)], "g string, v double, x boolean")
    r = one(stats.mann_whitney(df, "v", "x", ["g"]))
    assert (r.u, r.delta) == (3.5, 0.75)
    assert one(stats.mann_whitney(df.withColumn("x", ~F.col("x")), "v", "x", ["g"])).delta == -0.75


def test_holm_and_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.013, 0.02, 0.04, 0.3])], "id int, p double")
    r = stats.corrections(df, "p", "id").orderBy("id").collect()
    assert [round(x.holm, 6) for x in r] == [0.005, 0.052, 0.06, 0.08, 0.3]
    assert [x.bh for x in r] == [True, True, True, True, False]
    assert all(x.holm >= x.p for x in r)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.0001, 0.9999), min_size=1, max_size=12))
def test_step_up_keeps_what_step_down_keeps(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p double")
    assert all(x.bh or not x.holm_step for x in stats.corrections(df, "p", "id").collect())


def test_empirical_p_floor(spark):
    null = spark.range(1000).select((F.col("id") / 1000.0).alias("v"))
    seen = spark.createDataFrame([(2.0,)], "seen double")
    assert one(stats.empirical_p(null, seen, [], "v", "seen")).p == pytest.approx(1 / 1001)


def test_concentration(spark):
    even = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    r = one(stats.concentration(even, "k"))
    assert (round(r.gini, 9), r.hhi, r.singletons, r.top1_share) == (0.0, 0.25, 1.0, 0.25)
    r = one(stats.concentration(spark.createDataFrame([("a",)] * 4, "k string"), "k"))
    assert (round(r.gini, 9), r.hhi) == (0.0, 1.0)


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([("g", d) for d in (0.0, 1.0, 2.0, -3.0)], "g string, d double")
    r = one(stats.wilcoxon(df, "d", ["g"]))
    assert (r.n, r.w_plus, r.w_minus) == (3, 3.0, 3.0)


def test_leave_one_positive_out(spark):
    df = spark.createDataFrame([(1 / 16,), (1 / 20,)], "x double")
    mean, sd = ranking.leave_one_out("x")
    r = one(df.agg(mean.alias("m"), sd.alias("s")))
    assert r.m == pytest.approx(0.05625) and r.s == pytest.approx(0.0088388, abs=1e-6)


def test_residuals_of_an_exact_plane(spark):
    df = spark.range(12).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") * F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", 1 + 2 * F.col("a") + 3 * F.col("b"))
    r = one(vectors.plane_fit(df, ["y"], "a", "b")).r_y
    assert (r.c0, r.ca, r.cb) == (pytest.approx(1), pytest.approx(2), pytest.approx(3))


def test_group_folds_balance(spark):
    df = spark.createDataFrame([(g,) for g, n in zip("abcd", (5, 3, 2, 2)) for _ in range(n)], "g string")
    r = {x.g: x.fold for x in splits.group_folds(df, "g", 2).collect()}
    assert (r["a"], r["b"]) == (0, 1) and {r["c"], r["d"]} == {0, 1}  # equal groups go in hash order


def test_group_folds_equal_the_greedy_walk(spark):
    rng = random.Random(5)
    for folds in (2, 3, 5):
        sizes = [rng.choice((1, 1, 1, 2, 3, 7, 40)) for _ in range(60)]
        df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
        got = splits.group_folds(df, "g", folds).collect()
        load, want = [0] * folds, []
        for n in sorted(sizes, reverse=True):
            at = load.index(min(load))
            load[at] += n
            want.append((n, at))
        assert sorted((r.n, r.fold) for r in got) == sorted(want) and len({r.g for r in got}) == 60


def test_iid_split_is_stable_and_disjoint(spark):
    ids = spark.range(103).withColumnRenamed("id", "k")
    a, b = splits.iid_split(ids, "k", 0.2, 1).collect(), splits.iid_split(ids.repartition(3), "k", 0.2, 1).collect()
    assert sorted(a) == sorted(b) and sum(r.side == "test" for r in a) == 20 and len(a) == 103


LINE = [("m", i, f"R{i}", i, float(i), 0.0, 0.0) for i in range(3)]
ATOMS = "mol string, atom int, res string, seq int, x double, y double, z double"


def test_shape_of_a_line(spark):
    r = one(structure.shape(spark.createDataFrame(LINE, ATOMS), "atom"))
    assert (r.n_atoms, round(r.rg, 6), r.max_d, round(r.compactness, 6)) == (3, 0.816497, 2.0, 0.408248)


def test_contacts_are_strict(spark):
    df = spark.createDataFrame(LINE, ATOMS)
    assert structure.contacts(df, 2.0).count() == 2
    triangle = structure.contacts(df, 4.5)
    assert one(structure.spectral_gap(triangle)).gap == pytest.approx(3.0)
    g = one(structure.graph_figures(triangle, df))
    assert (g.n_edges, g.density, g.core) == (3, 1.0, 0.5)
    assert one(structure.exposure(df, "atom", 4.0)).exposure == 2.0


def test_grid_join_equals_all_pairs(spark):
    rows = [("m", i, f"R{i}", i, 3 * math.sin(i), 3 * math.cos(2 * i), 0.1 * i) for i in range(40)]
    got = {(r.atom, r.atom2) for r in structure.close_pairs(spark.createDataFrame(rows, ATOMS), ["atom"], 1.5).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and math.dist(a[4:], b[4:]) < 1.5}
    assert got == want


def test_sequence_keys(spark):
    plain, slash = "WURCS=2.0/1,2,1/[a2122h-1b_1-5]/1-1/a4-b1", "WURCS=2.0/1,2,1/[a2122h-1b_1-5_2*NCC/3=O]/1-1/a4-b1"
    full = "WURCS=2.0/2,3,2/1-1/[b1_4*OC][a12*h-1x][a2122h-1b_1-5]/a4-b1_a3-c1_a4-b1"
    rows = [("G00001AB", plain, None), ("G00002AB", slash, ""), ("G0000003C", full, None), ("G00004", None, "Gal(b1-4)[Fuc(a1-3)]Glc NAc"), ("G00000005", "", None)]
    df = spark.createDataFrame(rows, "id string, wurcs string, iupac string")
    r = {x.id: x for x in keys.structure_keys(df, "id", "wurcs", "iupac").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert r["G00001AB"].linkage_key == f"wurcs_linkage_{sha('a4-b1')}" and r["G00001AB"].scaffold_key == f"wurcs_scaffold_{sha('|[a2122h-1b_1-5]')}"
    assert r["G00002AB"].linkage_key == "fallback_linkage_G00002AB" and r["G00002AB"].terminal_motif_key == "fallback_terminal_G00002AB"
    assert r["G0000003C"].linkage_key == f"wurcs_linkage_{sha('a3-c1,a4-b1')}" and r["G0000003C"].terminal_motif_key == f"wurcs_terminal_{sha('a12*h-1x,a2122h-1b_1-5')}"
    assert r["G0000003C"].scaffold_key == f"wurcs_scaffold_{sha('a2122h-1b_,ah-1x,b1|1-1')}"
    assert r["G00004"].linkage_key == f"iupac_linkage_{sha('a1-3,b1-4')}" and r["G00004"].terminal_motif_key == f"iupac_terminal_{sha('Ac,Fuc,Gal')}"
    assert r["G00000005"].scaffold_key == "fallback_scaffold_G0000000"


def test_model_registry():
    assert models.get_model("linear") is models.linear
    with pytest.raises(ValueError):
        models.get_model("none")


def test_multi_prototype_of_few_rows_is_the_mean(spark):
    df = spark.createDataFrame([("a", [0.0, 2.0]), ("a", [2.0, 4.0])], "g string, v array<double>")
    r = models.multi_prototypes(df, "v", "g", 3).collect()
    assert len(r) == 1 and list(r[0].prototype) == [1.0, 3.0]


def test_multi_prototypes_cover_all_rows(spark):
    rows = [(1, [10.0 * c + (i % 7) * 0.1, 5.0 * (c == 1)]) for c in range(3) for i in range(70)] + [(2, [1.0, 1.0])] * 4 + [(None, [0.0, 0.0]), (1, None)]
    r = models.multi_prototypes(spark.createDataFrame(rows, "g int, v array<double>"), "v", "g", 3).collect()
    own = sorted(tuple(round(x, 6) for x in p.prototype) for p in r if p.g == 1)
    assert own == [(0.3, 0.0), (10.3, 5.0), (20.3, 0.0)]
    assert {tuple(p.prototype) for p in r if p.g == 2} == {(1.0, 1.0)} and len(r) == 6
    assert models.multi_prototypes(spark.createDataFrame([], "g int, v array<double>"), "v", "g", 3).collect() == []


def test_spectral_gap_of_all_molecules(spark):
    import numpy as np

    from tidemark.plans import catalog

    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect():
        xyz = 20 * np.array(r.embedding[:63], float).reshape(7, 3, 3).mean(1)
        near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) < 9.0
        np.fill_diagonal(near, False)
        near = near[near.any(1)][:, near.any(1)].astype(float)
        if len(near):
            want[r.vec_id] = np.linalg.eigvalsh(np.diag(near.sum(1)) - near)[1]
    got = {r.mol: r.gap for r in catalog.queries()["N14_spectral_gap"](spark, folder).collect()}
    assert max(want) > 120 and got == pytest.approx(want, abs=1e-5)


def test_survey_counts_of_draws(spark, monkeypatch):
    import numpy as np

    from tidemark.plans import catalog

    folder, queries, seen = "/root/testdata/sf0.001", catalog.queries(), {}
    rows = {round(r.noise, 2): r for r in queries["T19_noise_sweep"](spark, folder).collect()}
    assert sorted(rows) == [0.0, 0.02, 0.05, 0.1, 0.2] and {r.draws for r in rows.values()} == {50}
    assert rows[0.0].mrr_best != rows[0.2].mrr_best
    real = bootstrap.bootstrap
    monkeypatch.setattr(bootstrap, "bootstrap", lambda df, v, k, n, *a, **b: seen.update(c05=n) or real(df, v, k, n, *a, **b))
    bare = lambda rows, agents, positives, n, dim, trees, depth, *a: seen.update(b06=(trees, depth)) or forests.Trees(np.zeros(len(agents) * trees, np.uint64), depth)
    monkeypatch.setattr(forests, "grow", bare)
    monkeypatch.setattr(stats, "empirical_p", lambda null, *a: null)
    queries["C05_source_evaluation_ci"](spark, folder)
    queries["B06_random_forest"](spark, folder)
    assert seen == {"c05": 1000, "b06": (100, 10)}
    assert queries["T21_matched_null"](spark, folder).count() == 200


def test_exploded_neighbours_are_not_broadcast(spark):
    points = spark.range(50).selectExpr("id % 5 as mol", "id as atom", "cast(id as double) as x", "0.0D as y", "0.0D as z")
    plan = structure.close_pairs(points, ["atom"], 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_last_significant_row_is_found_from_the_end(spark):
    x = spark.createDataFrame([(i, p) for i, p in enumerate([0.04, 0.001, 0.03, 0.03, 0.9])], "id int, p double")
    out = stats.corrections(x, "p", "id")
    assert "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" not in out._jdf.queryExecution().analyzed().toString()
    assert [r.bh for r in out.orderBy("id").collect()] == [True, True, True, True, False]


def test_means_on_a_limit_do_not_depend_on_the_order_of_the_sum(spark, tmp_path):
    from tidemark.plans import split_queries

    for i, discounts in enumerate(([0.01, 0.02, 0.05, 0.06, 0.07, 0.06], [0.07, 0.06, 0.06, 0.05, 0.02, 0.01], [0.1, 0.02, 0.03, 0.03], [0.03, 0.03, 0.02, 0.1])):
        spark.createDataFrame([(i, 10.0, x, 0.0, 1) for x in discounts], "l_partkey long, l_quantity double, l_discount double, l_tax double, l_linenumber int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 1, 1.0, "b", "t") for i in range(4)], "p_partkey long, p_size int, p_retailprice double, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    rows = split_queries.QUERIES["P06_P07_proxy_keys"](spark, str(tmp_path)).collect()
    assert {r.linkage.split("_")[0] for r in rows} == {"medium"}


def test_means_on_a_limit_are_summed_in_file_order(spark, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.plans import split_queries

    rng, rows, want = random.Random(1), [], {}
    for i in range(40):
        cents = [0]
        while sum(cents) != 108:
            cents = rng.choices(range(11), k=24)
        rows += [(i, 10.0, x / 100, 0.0, 1) for x in cents]
    rng.shuffle(rows)
    for i in range(40):
        total = 0.0
        for x in (r[2] for r in rows if r[0] == i):
            total += x
        want[i] = "loose" if total / 24 < 0.045 else "medium"
    assert set(want.values()) == {"loose", "medium"}
    (tmp_path / "lineitem.parquet").mkdir()
    names = ["l_partkey", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
    for name, some in (("a", rows[:500]), ("b", rows[500:])):
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*some))))), tmp_path / "lineitem.parquet" / f"{name}.parquet", row_group_size=100)
    spark.createDataFrame([(i, 1, 1.0, "b", "t") for i in range(40)], "p_partkey long, p_size int, p_retailprice double, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = split_queries.QUERIES["P06_P07_proxy_keys"](spark, str(tmp_path)).collect()
    assert {r.id: r.linkage.split("_")[0] for r in got} == want


@pytest.mark.parametrize("values", [[0.5], [3.0, 1.0], [2.0] * 50 + [None, 7.0], [float(i * i % 9973) for i in range(9000)] + [None], [float(i * i % 99991) for i in range(50_000)], []])
def test_quantiles_are_exact_and_no_task_holds_all_values(spark, values):
    shares = [0.0, 0.25, 0.5, 0.33, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0] or [None] * len(shares)
    got = stats.quantiles(df, "v", shares)
    assert list(got.first()) == pytest.approx(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
