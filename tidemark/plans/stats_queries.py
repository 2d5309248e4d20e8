"""Tests, effect sizes, corrections, resampling and nulls (T, C09-C11, C15-C16, B01-B02)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cosine
from tidemark.operators import bootstrap, preference, ranking, resampling, splits, stats, vectors
from tidemark.operators.counting import positive_ranks
from tidemark.plans.base import FEATURES, SQL_FEATURES, SQL_INTERVAL, SQL_PAIRS, Catalog, features, pairs, read, rounded, sql_bootstrap, sql_ranked, sql_tail
from tidemark.plans.ranking_queries import FULL, MACRO, METRICS, ZCOLS, ZF, embedded, marked, marked_scores, sql_wide, wide, wide_scores
from tidemark.sources.scratch import staged

C = Catalog()
QUERIES, SQL = C.queries, C.sql

# Long form of features by agent: does the agent have the part?
TESTED = ["p_size", "p_retailprice", "avg_qty"]
LONG_SQL = f"""{SQL_FEATURES}, {SQL_PAIRS}, ag AS (SELECT DISTINCT agent FROM pairs), fl AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS feature, {c} AS value FROM features" for c in TESTED)}),
 xl AS (SELECT a.agent, f.feature, round(f.value, 6) AS value, p.id IS NOT NULL AS pos FROM fl f CROSS JOIN ag a LEFT JOIN pairs p ON p.agent = a.agent AND p.id = f.id)"""


def tested(spark, d):
    f = features(spark, d).select("id", *TESTED).unpivot("id", TESTED, "feature", "value").withColumn("value", F.round("value", 6))
    labels = pairs(spark, d)
    x = f.crossJoin(labels.select("agent").distinct())
    return x.join(labels.withColumn("pos", F.lit(True)), ["agent", "id"], "left").select("agent", "feature", "value", F.coalesce("pos", F.lit(False)).alias("pos"))


MWU = """r AS (SELECT agent, feature, pos, rank() OVER (PARTITION BY agent, feature ORDER BY value) + (count(*) OVER (PARTITION BY agent, feature, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY agent, feature, value) AS t FROM xl),
 s AS (SELECT agent, feature, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n2, sum(rk) FILTER (pos) AS r1, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1, 2),
 m AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sg FROM s)"""


@C.add("T01_T03_rank_sum", f"WITH {LONG_SQL}, {MWU} SELECT agent, feature, n1, n2, round(u, 6) AS u, round((u - n1 * n2 / 2.0 - sign(u - n1 * n2 / 2.0) * 0.5) / sg, 6) AS z, round(2 * u / (n1 * n2) - 1, 6) AS delta, round(least(1.0, 2 * {sql_tail('q')}), 6) AS p FROM (SELECT *, (abs(u - n1 * n2 / 2.0) - 0.5) / sg AS q FROM m)")
def t01(spark, d):
    return rounded(stats.mann_whitney(tested(spark, d), "value", "pos", ["agent", "feature"], "two-sided", exact=False))


@C.add("T02_wilcoxon", f"WITH x AS (SELECT p_brand, round(p_retailprice - 1300, 2) AS diff FROM part), r AS (SELECT p_brand, diff, rank() OVER (PARTITION BY p_brand ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY p_brand, abs(diff)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY p_brand, abs(diff)) AS t FROM x WHERE diff <> 0), s AS (SELECT p_brand, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS wm, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1) SELECT p_brand, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(z, 6) AS z, round(1 - {sql_tail('z')}, 6) AS p FROM (SELECT *, (wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM s)")
def t02(spark, d):
    x = read(spark, d, "part").select("p_brand", F.round(F.col("p_retailprice") - 1300, 2).alias("diff"))
    return rounded(stats.wilcoxon(x, "diff", ["p_brand"], "less", exact=False))


@C.add("T04_cohens_d", f"WITH {LONG_SQL}, s AS (SELECT agent, feature, count(*) FILTER (pos) AS n1, count(*) FILTER (NOT pos) AS n2, avg(value) FILTER (pos) AS m1, avg(value) FILTER (NOT pos) AS m2, var_samp(value) FILTER (pos) AS v1, var_samp(value) FILTER (NOT pos) AS v2 FROM xl GROUP BY 1, 2) SELECT agent, feature, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM s")
def t04(spark, d):
    return rounded(stats.cohens_d(tested(spark, d), "value", "pos", ["agent", "feature"]))


PVAL = "ps AS (SELECT p_partkey AS id, p_brand AS g, round(((p_partkey * 7919) % 1000 + 1) / 4000.0, 6) AS p FROM part)"
CORR = f"""WITH {PVAL}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS k, count(*) OVER (PARTITION BY g) AS n FROM ps)
SELECT id, g, p, round(least(1.0, max((n - k + 1) * p) OVER w), 6) AS holm, p <= 0.05 / (n - k + 1) AS holm_rank, min((p <= 0.05 / (n - k + 1))::INT) OVER w = 1 AS holm_step, max((p <= 0.05 * k / n)::INT) OVER (PARTITION BY g ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS bh
FROM k WINDOW w AS (PARTITION BY g ORDER BY p, id ROWS UNBOUNDED PRECEDING)"""


@C.add("T05_T08_corrections", CORR)
def t05(spark, d):
    x = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.round(((F.col("p_partkey") * 7919) % 1000 + 1) / 4000.0, 6).alias("p"))
    return rounded(stats.corrections(x, "p", "id", groups=["g"]))


@C.add("T09_empirical_p", "WITH o AS (SELECT p_brand, avg(p_retailprice) AS seen FROM part WHERE p_size > 25 GROUP BY 1) SELECT p_brand, round((1 + count(*) FILTER (p_retailprice >= seen)) / (1 + count(*)), 6) AS p FROM part JOIN o USING (p_brand) GROUP BY 1")
def t09(spark, d):
    p = read(spark, d, "part")
    seen = p.filter("p_size > 25").groupBy("p_brand").agg(F.avg("p_retailprice").alias("seen"))
    return rounded(stats.empirical_p(p.select("p_brand", "p_retailprice"), seen, ["p_brand"], "p_retailprice", "seen"))


TOPK = f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {sql_wide(ZCOLS)}, {sql_ranked('agent')}"


@C.add("T10_C09_top_k_preference", f"{TOPK} SELECT agent, {', '.join(f'round(avg(z.{c}), 6) AS {c}' for c in ZCOLS)} FROM ranked JOIN z USING (id) WHERE rank <= 20 GROUP BY agent")
def t10(spark, d):
    z = wide(spark, d)
    w = Window.partitionBy("agent").orderBy(F.desc("score"), "id")
    top = wide_scores(z, pairs(spark, d), ZCOLS).withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("agent", "id")
    return rounded(top.join(z.select("id", *ZCOLS), "id").groupBy("agent").agg(*(F.avg(c).alias(c) for c in ZCOLS)))


PREFERRED = f"""{TOPK}, np AS (SELECT agent, count(*) AS n_positives FROM ranked WHERE positive GROUP BY 1 HAVING count(*) >= 2), zl AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS feature, round({c}, 9) AS value FROM z" for c in ZCOLS)}),
 tp AS (SELECT agent, k::INT AS k, id FROM ranked JOIN np USING (agent), (VALUES (10), (20)) v(k) WHERE rank <= k), tv AS (SELECT agent, k, feature, id, value FROM tp JOIN zl USING (id)), mn AS (SELECT agent, k, feature, avg(value) AS score FROM tv GROUP BY 1, 2, 3),
 rv AS (SELECT g.agent, g.k, zl.feature, zl.value FROM (SELECT DISTINCT agent, k FROM tp) g CROSS JOIN zl LEFT JOIN tp ON tp.agent = g.agent AND tp.k = g.k AND tp.id = zl.id WHERE tp.id IS NULL), dl AS (SELECT agent, k, feature, avg(sign(tv.value - rv.value)) AS delta FROM tv JOIN rv USING (agent, k, feature) GROUP BY 1, 2, 3)"""


@C.add("C09_preference_effects", f"{PREFERRED} SELECT agent, k, feature, round(score, 6) AS score, round(delta, 6) AS delta, n_positives, (SELECT count(*) FROM z) AS n_candidates FROM mn JOIN np USING (agent) LEFT JOIN dl USING (agent, k, feature)")
def c09(spark, d):
    """Means and Cliff's delta of each agent's first ten and twenty rows against the rest."""
    z = staged(wide(spark, d).select("id", *ZCOLS), "preferred")
    return rounded(preference.preferences(z, wide_scores(z, pairs(spark, d), ZCOLS), ZCOLS))


@C.add("C09_preference_tests")
def c09_tests(spark, d):
    """The same with permutation p and corrections over the features of an agent."""
    z = staged(wide(spark, d).select("id", *ZCOLS), "preferred")
    return rounded(preference.preference_tests(z, preference.preferences(z, wide_scores(z, pairs(spark, d), ZCOLS), ZCOLS), ZCOLS))


@C.add("T10_permutation_p")
def t10p(spark, d):
    z = wide(spark, d)
    seen = t10(spark, d).unpivot("agent", ZCOLS, "feature", "score")
    null = resampling.top_k_null(z.select("id", *ZCOLS), ZCOLS, 20)
    both = seen.join(null, "feature").groupBy("agent", "feature", "score")
    return rounded(both.agg(((1 + F.count_if(F.abs("null") >= F.abs("score"))) / (1 + F.count("*"))).alias("p")))


UNI = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"
NULL_RANDOM = f"WITH {SQL_PAIRS}, scored AS (SELECT r AS rep, agent, p_partkey AS id, round({UNI.format(chr(39) + '42|' + chr(39) + ' || r || ' + chr(39) + '|' + chr(39) + ' || agent || ' + chr(39) + '|' + chr(39) + ' || p_partkey')}, 9) AS score, EXISTS (SELECT 1 FROM pairs q WHERE q.agent = a.agent AND q.id = p_partkey) AS positive FROM range(3) t(r), (SELECT DISTINCT agent FROM pairs) a, part), {sql_ranked('rep, agent')}, per AS ({FULL.format(g='rep, agent')}) SELECT rep, count(*) AS agents, {MACRO} FROM per GROUP BY rep"


@C.add("B01_random_baseline", NULL_RANDOM)
def b01(spark, d):
    labels, ids = pairs(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("at"), F.array(F.lit(0.0)).alias("z"))
    agents = labels.select("agent").distinct()
    draws = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    groups = agents.withColumn("rep", draws).withColumn("draw", F.concat_ws("|", F.lit("42"), "rep", "agent")).withColumn("p", F.array(F.lit(1.0)))
    own = labels.withColumnRenamed("id", "at").join(ids, "at")  # a score is minus the distance of its number from one
    per = positive_ranks(groups, own, ids, ["agent"], ids.count(), 3 * agents.count(), measure="distance", summed=True, vary="draw", make=resampling.uniform)
    return rounded(per.groupBy("rep").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


def null_by_repeat(per, *groups: str):
    """Metrics of each repeat, averaged over agents."""
    return rounded(per.groupBy("rep", *groups).agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


@C.add("T11_random_null")
def t11(spark, d):
    return null_by_repeat(resampling.random_metrics(pairs(spark, d), read(spark, d, "part").count()))


def standardised(spark, d):
    """Vectors (id, z), labels (agent, id) and the number of components of the embeddings."""
    z = vectors.zscore_array(read(spark, d, "embeddings"), "embedding").select(F.col("vec_id").alias("id"), F.col("label").alias("agent"), "z")
    return z.select("id", "z"), z.filter("agent is not null").select("agent", "id"), z.select(F.max(F.size("z"))).first()[0] or 0


def raw(spark, d):
    """The vectors as they are (id, z), and their means and deviations by component."""
    e = read(spark, d, "embeddings")
    row = vectors.long_form(e, "embedding").groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("j").collect()
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("z")), ([r["m"] for r in row], [r["s"] for r in row])


@C.add("T12_permutation_null")
def t12(spark, d):
    _, labels, dim = standardised(spark, d)
    z, scale = raw(spark, d)
    return null_by_repeat(resampling.permutation_null(z, labels, dim, summed=True, scale=scale))


TESTED_METRICS = ["mrr_best", "recall_5", "ap"]


def against_nulls(seen, nulls):
    """(mode, metric, observed, null_mean, null_std, p, holm_significant): `seen` is one row, `nulls` (mode, rep, metrics).
    Holm's step-down runs over the metrics of a mode."""
    long = nulls.unpivot(["mode", "rep"], TESTED_METRICS, "metric", "value")
    observed = seen.unpivot([], TESTED_METRICS, "metric", "observed")
    both = long.join(F.broadcast(observed), "metric").groupBy("mode", "metric")
    out = both.agg(F.max("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_std"), ((1 + F.count_if(F.col("value") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))
    return stats.corrections(out, "p", "metric", groups=["mode"]).select("mode", "metric", "observed", "null_mean", "null_std", "p", F.col("holm_step").alias("holm_significant"))


def mean_of(per, *groups: str):
    """Metrics of `groups`, averaged over agents."""
    return per.groupBy(*groups).agg(*(F.avg(c).alias(c) for c in TESTED_METRICS))


@C.add("C13_null_run")
def c13(spark, d):
    """The baselines' run: observed prototypes against 1,000 random rankings and 1,000 permutations of the rows."""
    z, labels, dim = standardised(spark, d)
    z, labels = staged(z, "null-vectors"), staged(labels, "null-labels")
    seen = ranking.metrics(ranking.ranked(embedded(spark, d), ["agent"]), ["agent"]).agg(*(F.avg(c).alias(c) for c in TESTED_METRICS))
    random = mean_of(resampling.random_metrics(labels, z.count()), "rep").withColumn("mode", F.lit("random"))
    own, scale = raw(spark, d)
    permuted = mean_of(resampling.permutation_null(own, labels, dim, summed=True, scale=scale), "rep").withColumn("mode", F.lit("permutation"))
    return rounded(against_nulls(seen, random.unionByName(permuted)))


def fold_run(spark, d, folds: int = 5, repeats: int = 1000):
    """(observed metrics of each fold (fold, …), nulls of each fold (mode, rep, fold, …)): the folds are `id % folds`."""
    z, labels, dim = standardised(spark, d)
    z, labels = staged(z, "fold-vectors"), staged(labels, "fold-labels")
    # All folds' permutations share the passes over the rows.
    own, scale = raw(spark, d)
    moved = resampling.permutation_null(own, labels, dim, repeats, folds=folds, summed=True, scale=scale)
    seen, nulls = None, mean_of(moved, "rep", "fold").select(F.lit("permutation").alias("mode"), "rep", "fold", *TESTED_METRICS)
    join = lambda a, b: b if a is None else a.unionByName(b)
    for fold in range(folds):
        test = z.filter(F.col("id") % folds == fold).select("id")
        named = lambda rows, mode: mean_of(rows, "rep").select(F.lit(mode).alias("mode"), "rep", F.lit(fold).alias("fold"), *TESTED_METRICS)  # noqa: B023, E731
        known = labels.join(test, "id", "left_anti").select("agent").distinct()
        held = labels.join(test, "id", "left_semi").join(known, "agent", "left_semi")
        nulls = join(nulls, named(resampling.random_metrics(held, test.count(), repeats, seed=42 + fold), "random"))
        proto = vectors.mean_vector(z.join(labels, "id").join(test, "id", "left_anti"), "z", "agent", "p")
        scored = z.join(test, "id", "left_semi").crossJoin(proto).select("agent", "id", F.round(cosine(F.col("z"), F.col("p")), 9).alias("score"))
        scored = scored.join(held.withColumn("positive", F.lit(True)), ["agent", "id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
        own = ranking.metrics(ranking.ranked(scored, ["agent"]), ["agent"]).agg(*(F.avg(c).alias(c) for c in TESTED_METRICS))
        seen = join(seen, own.select(F.lit(fold).alias("fold"), *TESTED_METRICS))
    return seen, nulls


@C.add("T13_fold_nulls")
def t13(spark, d):
    """p of the mean over five folds against random and permuted nulls of each fold, 1,000 a fold."""
    seen, nulls = fold_run(spark, d)
    seen = seen.agg(F.avg("mrr_best").alias("seen"))
    return rounded(stats.empirical_p(nulls.select("mode", F.col("mrr_best").alias("m")), seen.select(F.explode(F.array(F.lit("random"), F.lit("permutation"))).alias("mode"), "seen"), ["mode"], "m", "seen"))


@C.add("C14_fold_nulls")
def c14(spark, d):
    """The folds' run: means over folds against each fold's nulls, for three metrics, with Holm's step-down."""
    seen, nulls = fold_run(spark, d)
    return rounded(against_nulls(seen.agg(*(F.avg(c).alias(c) for c in TESTED_METRICS)), nulls))


BRANDS = "x AS (SELECT p_brand, p_partkey AS o, p_retailprice AS v FROM part)"
FIGURES = "SELECT p_brand, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi, round(CASE WHEN mean <> 0 THEN std / abs(mean) ELSE 0 END, 6) AS cv"


def brand_bootstrap(spark, d, seed: int, median: bool):
    drawn = bootstrap.bootstrap(read(spark, d, "part"), "p_retailprice", "p_partkey", 1000, seed, ["p_brand"], median)
    return rounded(bootstrap.interval(drawn, ["p_brand"]))


@C.add("T14_T17_bootstrap", f"WITH {BRANDS}, {sql_bootstrap('p_brand', 11, 'avg')} {FIGURES} FROM (SELECT p_brand, {SQL_INTERVAL} FROM b GROUP BY 1)")
def t14(spark, d):
    return brand_bootstrap(spark, d, 11, median=False)


@C.add("T15_bootstrap_median", f"WITH {BRANDS}, {sql_bootstrap('p_brand', 12, 'median')} {FIGURES} FROM (SELECT p_brand, {SQL_INTERVAL} FROM b GROUP BY 1)")
def t15(spark, d):
    return brand_bootstrap(spark, d, 12, median=True)


CONT = f"""WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {sql_wide(ZCOLS)}, {sql_ranked('agent')}, np AS (SELECT agent, count(*) AS n_pos FROM ranked WHERE positive GROUP BY 1),
 un AS (SELECT agent, id, rank, row_number() OVER (PARTITION BY agent ORDER BY rank) AS k FROM ranked WHERE NOT positive), pool AS (SELECT un.*, n_pos, least(2 * n_pos, (SELECT count(*) FROM un u2 WHERE u2.agent = un.agent)) AS m FROM un JOIN np USING (agent) WHERE k <= 2 * n_pos),
 lv AS (SELECT level, rep FROM (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.3), (0.5)) v(level), range(100) t(rep)),
 pick AS (SELECT level, rep, agent, id, rank, floor(m * level + 1e-9)::BIGINT AS take, row_number() OVER (PARTITION BY level, rep, agent ORDER BY md5('3|' || rep || '|' || agent || '|' || id), id) AS o FROM pool, lv),
 al AS (SELECT level, rep, agent, rank FROM pick WHERE o <= take UNION ALL SELECT level, rep, agent, rank FROM ranked, lv WHERE positive),
 one AS (SELECT level, rep, agent, count(*) AS n_pos, 1.0 / min(rank) AS mrr, avg((rank <= 10)::INT) AS r10 FROM al GROUP BY 1, 2, 3)
SELECT level, agent, max(n_pos) AS n_pos, round(avg(mrr), 6) AS mrr_best, round(avg(r10), 6) AS recall_10 FROM one GROUP BY 1, 2"""


CONT_LEVELS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5)


@C.add("T18_contamination", CONT)
def t18(spark, d):
    # Rows up to rank 10, the first positive and the pool, which is the first unlabelled rows, twice as many as positives.
    scored = marked_scores(marked(spark, d), ZCOLS)
    r = staged(ranking.best_ranked(scored, ["agent"], F.greatest(2 * F.col("n_pos"), F.lit(10))).filter("n_pos > 0"), "first")
    pool = r.filter(~F.col("positive") & (F.col("rank") - F.col("p_before") <= 2 * F.col("n_pos"))).select("agent", "id", "rank")
    drawn = resampling.contaminated(pool, CONT_LEVELS)
    levels = F.explode(F.array(*map(F.lit, CONT_LEVELS))).alias("level")
    pos = r.filter("positive").groupBy("agent").agg(F.max("n_pos").alias("n"), F.min("rank").alias("best"), F.sum((F.col("rank") <= 10).cast("long")).alias("hits"))
    every = drawn.unionByName(resampling.repeated(pos.select("*", levels), 100))
    one = every.groupBy("level", "rep", "agent").agg(F.sum("n").alias("n_pos"), (1.0 / F.min("best")).alias("mrr"), (F.sum("hits") / F.sum("n")).alias("r10"))
    return rounded(one.groupBy("level", "agent").agg(F.max("n_pos").alias("n_pos"), F.avg("mrr").alias("mrr_best"), F.avg("r10").alias("recall_10")))


@C.add("T22_strata_metrics", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, t AS (SELECT quantile_cont(p_size, 0.33) AS a, quantile_cont(p_size, 0.67) AS b FROM features), {sql_wide(ZCOLS, out='s0')}, scored AS (SELECT CASE WHEN f.p_size <= a THEN 'S' WHEN f.p_size <= b THEN 'M' ELSE 'L' END AS stratum, s0.* FROM s0 JOIN features f USING (id), t), {sql_ranked('stratum, agent')}, per AS ({FULL.format(g='stratum, agent')}) SELECT stratum, count(*) AS agents, {MACRO} FROM per GROUP BY stratum")
def t22(spark, d):
    z = wide(spark, d)
    t = z.agg(F.percentile("p_size", F.lit(0.33)).alias("a"), F.percentile("p_size", F.lit(0.67)).alias("b"))
    strata = z.crossJoin(F.broadcast(t)).select("id", splits.tercile_key(F.col("p_size"), F.col("a"), F.col("b")).alias("stratum"))
    x = wide_scores(z, pairs(spark, d), ZCOLS).join(strata, "id")
    per = ranking.metrics(ranking.ranked(x, ["stratum", "agent"]), ["stratum", "agent"])
    return rounded(per.groupBy("stratum").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


@C.add("T23_distance_comparison", f"WITH xl AS (SELECT p_type AS agent, 'v' AS feature, p_size > 25 AS pos, round(p_retailprice, 6) AS value FROM part), {MWU}, p AS (SELECT agent, u, {sql_tail('q')} AS p FROM (SELECT *, (u - n1 * n2 / 2.0 - 0.5) / sg AS q FROM m)) SELECT agent AS g, round(avg(value) FILTER (pos), 6) AS mean_a, round(avg(value) FILTER (NOT pos), 6) AS mean_b, round(median(value) FILTER (pos), 6) AS median_a, round(stddev_samp(value) FILTER (NOT pos), 6) AS std_b, round(max(u), 6) AS u, round(max(p), 6) AS p FROM xl JOIN p USING (agent) GROUP BY 1")
def t23(spark, d):
    x = read(spark, d, "part").select(F.col("p_type").alias("g"), (F.col("p_size") > 25).alias("big"), F.round("p_retailprice", 6).alias("v"))
    a, b = F.when(F.col("big"), F.col("v")), F.when(~F.col("big"), F.col("v"))
    shape = x.groupBy("g").agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.median(a).alias("median_a"), F.stddev_samp(b).alias("std_b"))
    return rounded(shape.join(stats.mann_whitney(x, "v", "big", ["g"], "greater", exact=False).select("g", "u", "p"), "g"))


@C.add("T24_spearman", "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def t24(spark, d):
    r = read(spark, d, "part").select("p_brand", ranking.average_rank("p_size", "p_brand").alias("a"), ranking.average_rank("p_retailprice", "p_brand").alias("b"))
    return rounded(r.groupBy("p_brand").agg(F.corr("a", "b").alias("rho")))


@C.add("T24_spearman_p")
def t24p(spark, d):
    return rounded(stats.spearman(read(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"]))


PROFILE = f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {' , '.join(f'm_{c} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM features)' for c in FEATURES)}, p AS ({' UNION ALL '.join(f'''SELECT agent, '{c}' AS feature, (avg({c}) - max(m)) / max(s) AS zs FROM pairs JOIN features USING (id), m_{c} GROUP BY agent''' for c in FEATURES)}), k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY round(abs(zs), 9) DESC, feature) AS r FROM p) SELECT agent, feature, round(zs, 6) AS zs, r FROM k WHERE r <= 5"


@C.add("T25_profile_top_5", PROFILE)
def t25(spark, d):
    f = features(spark, d).select("id", *FEATURES)
    stat = f.agg(*(F.avg(c).alias(f"m_{c}") for c in FEATURES), *(F.stddev_samp(c).alias(f"s_{c}") for c in FEATURES))
    p = pairs(spark, d).join(f, "id").groupBy("agent").agg(*(F.avg(c).alias(c) for c in FEATURES)).crossJoin(F.broadcast(stat))
    p = p.select("agent", *((F.col(c) - F.col(f"m_{c}")).alias(f"d_{c}") for c in FEATURES), *(F.col(f"s_{c}") for c in FEATURES)).select("agent", *((F.col(f"d_{c}") / F.col(f"s_{c}")).alias(c) for c in FEATURES))
    x = p.unpivot("agent", FEATURES, "feature", "zs")
    w = Window.partitionBy("agent").orderBy(F.desc(F.round(F.abs("zs"), 9)), "feature")
    return rounded(x.withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 5"))


@C.add("T26_decision", "SELECT p_brand, round(100 * avg((p_size > 30)::INT), 6) AS pct, CASE WHEN avg((p_size > 30)::INT) >= 0.42 THEN 'MAIN_TEXT' WHEN avg((p_size > 30)::INT) >= 0.38 THEN 'SUPPLEMENTARY' ELSE 'BRIEF' END AS decision FROM part GROUP BY 1")
def t26(spark, d):
    x = read(spark, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 30).cast("int")).alias("a"))
    return x.select("p_brand", F.round(100 * F.col("a"), 6).alias("pct"), F.when(F.col("a") >= 0.42, "MAIN_TEXT").when(F.col("a") >= 0.38, "SUPPLEMENTARY").otherwise("BRIEF").alias("decision"))


PLACEMENT = f"""WITH x AS (SELECT l_partkey, p_brand, avg(l_discount) AS base, avg(l_discount) FILTER (l_discount >= right(p_brand, 1)::INT / 100.0 - 0.001) AS other FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 y AS (SELECT *, round(other - base, 9) AS diff FROM x WHERE other IS NOT NULL), r AS (SELECT p_brand, diff, rank() OVER (PARTITION BY p_brand ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY p_brand, abs(diff)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY p_brand, abs(diff)) AS t FROM y WHERE diff <> 0),
 s AS (SELECT p_brand, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wp, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1), z AS (SELECT p_brand, abs((wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48)) AS z FROM s),
 q AS (SELECT p_brand, least(1.0, 2 * {sql_tail('z')}) AS p FROM z), g AS (SELECT p_brand, count(*) AS n, 100 * avg((round(other - 1.05 * base, 9) > 0)::INT) AS pct, 100 * (avg(other) / avg(base) - 1) AS rel FROM y GROUP BY 1)
SELECT p_brand, n, round(pct, 6) AS pct_improved, round(rel, 6) AS relative_gain, round(p, 6) AS p, CASE WHEN pct > 30 AND rel > 20 AND p < 0.01 THEN 'MAIN_TEXT' WHEN pct > 15 AND rel > 10 AND p < 0.05 THEN 'SUPPLEMENTARY' ELSE 'BRIEF_MENTION' END AS decision FROM g LEFT JOIN q USING (p_brand)"""


@C.add("T26_placement", PLACEMENT)
def t26_placement(spark, d):
    x = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    least = F.substring("p_brand", -1, 1).cast("int") / 100.0 - 0.001
    x = x.groupBy("l_partkey", "p_brand").agg(F.avg("l_discount").alias("base"), F.avg(F.when(F.col("l_discount") >= least, F.col("l_discount"))).alias("other"))
    return rounded(stats.placement(x, "base", "other", ["p_brand"]))


PROFILE_TESTS = f"""WITH {LONG_SQL}, {MWU}, md AS (SELECT agent, feature, avg(value) FILTER (pos) AS m1, avg(value) FILTER (NOT pos) AS m2, var_samp(value) FILTER (pos) AS v1, var_samp(value) FILTER (NOT pos) AS v2 FROM xl GROUP BY 1, 2),
 t AS (SELECT agent, feature, n1, n2, 2 * u / (n1 * n2) - 1 AS delta, least(1.0, 2 * {sql_tail('q')}) AS p FROM (SELECT *, (abs(u - n1 * n2 / 2.0) - 0.5) / sg AS q FROM m WHERE n1 >= 5 AND n2 >= 3)),
 h AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY agent) AS n FROM t WINDOW w AS (PARTITION BY agent ORDER BY round(p, 12), feature))
SELECT agent, feature, n1, n2, round(delta, 6) AS delta, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d, round(p, 6) AS p, round(holm, 6) AS p_holm, CASE WHEN m1 > m2 THEN 'higher' ELSE 'lower' END AS direction, holm < 0.05 AND abs(round(delta, 9)) >= 0.33 AS preferred
FROM (SELECT *, least(1.0, max((n - k + 1) * p) OVER (PARTITION BY agent ORDER BY k)) AS holm FROM h) JOIN md USING (agent, feature)"""


@C.add("C10_preference_profile", PROFILE_TESTS)
def c10(spark, d):
    x, keys = tested(spark, d), ["agent", "feature"]
    m = stats.mann_whitney(x, "value", "pos", keys, "two-sided", exact=False).filter("n1 >= 5 and n2 >= 3").drop("u", "z")
    m = stats.corrections(m.withColumn("__p", F.round("p", 12)), "__p", "feature", groups=["agent"]).withColumnRenamed("holm", "p_holm")
    means = x.groupBy(*keys).agg(F.avg(F.when(F.col("pos"), F.col("value"))).alias("m1"), F.avg(F.when(~F.col("pos"), F.col("value"))).alias("m2"))
    out = m.join(stats.cohens_d(x, "value", "pos", keys), keys).join(means, keys)
    kept = (F.col("p_holm") < 0.05) & (F.abs(F.round("delta", 9)) >= 0.33)
    return rounded(out.select(*keys, "n1", "n2", "delta", "d", "p", "p_holm", F.when(F.col("m1") > F.col("m2"), "higher").otherwise("lower").alias("direction"), kept.alias("preferred")))


@C.add("B10_C11_few_shot", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, pk AS (SELECT rep, agent, id, row_number() OVER (PARTITION BY rep, agent ORDER BY md5('42|' || rep || '|' || agent || '|' || id), id) AS o FROM pairs, range(20) t(rep)), shots AS (SELECT k, rep, agent, id FROM pk, (VALUES (1), (2), (3)) v(k) WHERE o <= k), pr AS (SELECT k, rep, agent, {', '.join(f'avg({c}) AS p_{c}' for c in ZCOLS)} FROM shots JOIN z USING (id) GROUP BY 1, 2, 3), ds AS (SELECT k, rep, agent, z.id, round(-sqrt({' + '.join(f'({c} - p_{c}) * ({c} - p_{c})' for c in ZCOLS)}), 9) AS score FROM z, pr), scored AS (SELECT ds.*, l.id IS NOT NULL AS positive FROM ds LEFT JOIN pairs l ON l.agent = ds.agent AND l.id = ds.id), {sql_ranked('k, rep, agent')}, per AS ({FULL.format(g='k, rep, agent')}) SELECT k, count(DISTINCT agent) AS agents, {MACRO} FROM per GROUP BY k")
def b10(spark, d):
    labels, z = pairs(spark, d), staged(wide(spark, d).select("id", *ZCOLS), "shots")
    w = Window.partitionBy("rep", "agent").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "rep", "agent", "id").cast("binary")), "id")
    shots = resampling.repeated(labels, 20).withColumn("o", F.row_number().over(w)).filter("o <= 3").select("rep", "agent", "id", F.explode(F.sequence("o", F.lit(3))).alias("k"))
    proto = shots.join(z, "id").groupBy("k", "rep", "agent").agg(*(F.avg(c).alias(f"p_{c}") for c in ZCOLS))
    groups = proto.select("k", "rep", "agent", F.array(*(f"p_{c}" for c in ZCOLS)).alias("p"))
    rows = z.select(F.col("id").alias("at"), F.array(*ZCOLS).alias("z"))
    size = 60 * labels.select("agent").distinct().count()
    per = positive_ranks(groups, labels.withColumnRenamed("id", "at").join(rows, "at"), rows, ["agent"], z.count(), size, measure="distance", summed=True)
    return rounded(per.groupBy("k").agg(F.countDistinct("agent").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


@C.add("C16_source_decomposition", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, x AS (SELECT DISTINCT data_source AS agent, id FROM rawpairs), xl AS (SELECT agent, 'price' AS feature, round(p_retailprice, 6) AS value, p_size > 25 AS pos FROM x JOIN features USING (id)), {MWU} SELECT agent AS data_source, n1, n2, round(u, 6) AS u, round(2 * u / (n1 * n2) - 1, 6) AS delta, round(least(1.0, 2 * {sql_tail('q')}), 6) AS p FROM (SELECT *, (abs(u - n1 * n2 / 2.0) - 0.5) / sg AS q FROM m)")
def c16(spark, d):
    x = pairs(spark, d, distinct=False).select("data_source", "id").distinct().join(features(spark, d), "id")
    x = x.select("data_source", F.round("p_retailprice", 6).alias("value"), (F.col("p_size") > 25).alias("pos"))
    return rounded(stats.mann_whitney(x, "value", "pos", ["data_source"], "two-sided", exact=False).select("data_source", "n1", "n2", "u", "delta", "p"))


COMPOSED = ["p_size", "n_lines", "avg_qty", "avg_disc"]


@C.add("C16_source_composition", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, x AS (SELECT DISTINCT data_source, id FROM rawpairs), l AS ({' UNION ALL '.join(f"SELECT data_source, '{c}' AS feature, round({c}, 9) AS v FROM x JOIN features USING (id)" for c in COMPOSED)}) SELECT data_source, feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median FROM l GROUP BY 1, 2")
def c16_composition(spark, d):
    return rounded(sourced(spark, d).groupBy("data_source", "feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile("v", F.lit(0.5)).alias("median")))


def sourced(spark, d):
    """(data_source, feature, v): features of each source's rows, a row once a source."""
    x = pairs(spark, d, distinct=False).select("data_source", "id").distinct().join(features(spark, d).select("id", *COMPOSED), "id")
    return x.unpivot(["data_source", "id"], COMPOSED, "feature", "v").select("data_source", "feature", F.round("v", 9).alias("v"))


@C.add("C16_source_comparison", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, x AS (SELECT DISTINCT data_source, id FROM rawpairs), so AS (SELECT DISTINCT data_source FROM x), l AS ({' UNION ALL '.join(f"SELECT data_source, '{c}' AS feature, round({c}, 9) AS value FROM x JOIN features USING (id)" for c in COMPOSED)}), xl AS (SELECT a.data_source || '|' || b.data_source AS agent, l.feature, l.value, l.data_source = a.data_source AS pos FROM so a JOIN so b ON a.data_source < b.data_source JOIN l ON l.data_source IN (a.data_source, b.data_source)), {MWU}, mm AS (SELECT agent, feature, avg(value) FILTER (pos) AS mean_a, avg(value) FILTER (NOT pos) AS mean_b FROM xl GROUP BY 1, 2), f AS (SELECT agent, feature, n1, n2, u, least(1.0, 2 * {sql_tail('q')}) AS p FROM (SELECT *, (abs(u - n1 * n2 / 2.0) - 0.5) / sg AS q FROM m)) SELECT agent AS sources, feature, n1, n2, round(u, 6) AS u, round(p, 6) AS p, p < 0.05 AS significant, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM f JOIN mm USING (agent, feature)")
def c16_comparison(spark, d):
    """Each pair of sources: rank test and means of each feature. Values meet as counts, so a row is not repeated for each pair."""
    counts = staged(sourced(spark, d).groupBy("data_source", "feature", F.col("v").alias("value")).agg(F.count("*").alias("c")), "sourced")
    own = counts.select("data_source").distinct()
    a, b = own.select(F.col("data_source").alias("a")), own.select(F.col("data_source").alias("b"))
    ways = a.join(b, F.col("a") < F.col("b"))
    both = counts.join(ways, (F.col("data_source") == F.col("a")) | (F.col("data_source") == F.col("b"))).select(F.concat("a", F.lit("|"), "b").alias("sources"), "feature", "value", "c", (F.col("data_source") == F.col("a")).alias("pos"))
    test = stats.mann_whitney(both, "value", "pos", ["sources", "feature"], "two-sided", exact=False, times="c")
    mean = lambda side: F.sum(F.when(side, F.col("value") * F.col("c"))) / F.sum(F.when(side, F.col("c")))
    means = both.groupBy("sources", "feature").agg(mean(F.col("pos")).alias("mean_a"), mean(~F.col("pos")).alias("mean_b"))
    return rounded(test.join(means, ["sources", "feature"]).select("sources", "feature", "n1", "n2", "u", "p", (F.col("p") < 0.05).alias("significant"), "mean_a", "mean_b"))


@C.add("C16_agent_overlap", f"WITH {SQL_PAIRS}, x AS (SELECT DISTINCT data_source, agent FROM rawpairs), n AS (SELECT data_source, count(*) AS n FROM x GROUP BY 1), s AS (SELECT a.data_source AS a, b.data_source AS b, count(*) AS shared FROM x a JOIN x b ON a.agent = b.agent AND a.data_source < b.data_source GROUP BY 1, 2) SELECT na.data_source AS source_a, nb.data_source AS source_b, na.n AS agents_a, nb.n AS agents_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (na.n + nb.n - coalesce(shared, 0)), 6) AS jaccard FROM n na JOIN n nb ON na.data_source < nb.data_source LEFT JOIN s ON s.a = na.data_source AND s.b = nb.data_source")
def c16_overlap(spark, d):
    """Agents of each pair of sources, shared ones and their Jaccard index; pairs that share none are there with zeros."""
    own = staged(pairs(spark, d, distinct=False).select("data_source", "agent").distinct(), "source-agents")
    n = own.groupBy("data_source").agg(F.count("*").alias("n"))
    ways = n.select(F.col("data_source").alias("source_a"), F.col("n").alias("agents_a")).join(n.select(F.col("data_source").alias("source_b"), F.col("n").alias("agents_b")), F.col("source_a") < F.col("source_b"))
    met = own.withColumnRenamed("data_source", "source_a").join(own.withColumnRenamed("data_source", "source_b"), "agent").filter("source_a < source_b").groupBy("source_a", "source_b").agg(F.count("*").alias("s"))
    shared = F.coalesce("s", F.lit(0))
    return rounded(ways.join(met, ["source_a", "source_b"], "left").select("source_a", "source_b", "agents_a", "agents_b", shared.alias("shared"), (shared / (F.col("agents_a") + F.col("agents_b") - shared)).alias("jaccard")))


@C.add("X27_generalisation_gap", f"WITH {SQL_PAIRS}, a AS (SELECT agent, count(*) FILTER (id % 2 = 0) AS i, count(*) FILTER (id % 2 = 1) AS o FROM pairs GROUP BY 1) SELECT agent, i - o AS gap, round(CASE WHEN i = 0 THEN 0 ELSE (i - o) / i * 100 END, 6) AS gap_pct FROM a")
def x27(spark, d):
    a = pairs(spark, d).groupBy("agent").agg(F.count_if(F.col("id") % 2 == 0).alias("i"), F.count_if(F.col("id") % 2 == 1).alias("o"))
    return a.select("agent", (F.col("i") - F.col("o")).alias("gap"), F.round(F.when(F.col("i") == 0, 0.0).otherwise((F.col("i") - F.col("o")) / F.col("i") * 100), 6).alias("gap_pct"))
