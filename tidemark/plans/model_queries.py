"""Models and composite runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cosine
from tidemark.operators import ablation, bootstrap, forests, logistic, models, ranking, resampling, stats, vectors
from tidemark.operators.counting import positive_ranks
from tidemark.plans.base import FEATURES, SQL_FEATURES, SQL_INTERVAL, SQL_PAIRS, Catalog, features, pairs, read, rounded, sql_bootstrap, sql_ranked, sql_z
from tidemark.plans.ranking_queries import FULL, MACRO, METRICS, ZCOLS, ZF, marked, marked_scores, nearest_train, sql_wide, wide, wide_scores
from tidemark.sources.scratch import staged

C = Catalog()
QUERIES, SQL = C.queries, C.sql


@C.add("B05_logistic_regression")
def b05(spark, d):
    """A score of each agent's model for each id."""
    return rounded(logistic.linear_scores(wide(spark, d).select("id", F.array(*ZCOLS).alias("x")), pairs(spark, d)), 4)


@C.add("B06_random_forest")
def b06(spark, d):
    """A score of each agent's forest for each id."""
    return rounded(forests.forest_scores(wide(spark, d).select("id", F.array(*ZCOLS).alias("x")), pairs(spark, d)), 4)


@C.add("B07_multi_prototype")
def b07(spark, d):
    z = vectors.zscore_array(read(spark, d, "embeddings"), "embedding")
    proto = models.multi_prototypes(z, "z", "label", 3)
    best = z.crossJoin(proto.select(F.col("label").alias("agent"), "prototype")).groupBy("agent", F.col("vec_id").alias("id"))
    return best.agg(F.round(F.greatest(F.lit(0.0), F.max(cosine(F.col("z"), F.col("prototype")))), 4).alias("score"))


@C.add("B13_agent_map")
def b13(spark, d):
    x = pairs(spark, d).join(wide(spark, d), "id").groupBy("agent").agg(*(F.avg(c).alias(c) for c in ZCOLS))
    return rounded(models.agent_map(x, ZCOLS, "agent"), 4)


@C.add("B04_prototype", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF} SELECT agent, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ZCOLS)} FROM pairs JOIN z USING (id) GROUP BY agent")
def b04(spark, d):
    x = pairs(spark, d).join(wide(spark, d).select("id", *ZCOLS), "id")
    return rounded(x.groupBy("agent").agg(*(F.avg(c).alias(c) for c in ZCOLS)))


@C.add("B02_permuted_columns")
def b02(spark, d):
    mixed = resampling.permuted_columns(wide(spark, d).select("id", *ZCOLS), "id", ZCOLS)
    per = ranking.metrics(ranking.ranked(wide_scores(mixed, pairs(spark, d), ZCOLS), ["agent"]), ["agent"])
    return rounded(per)


SETS = {"a": ZCOLS[:4], "b": ZCOLS[4:], "a+b": ZCOLS}


@C.add("C06_feature_sets", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {', '.join(sql_wide(c, out=f'c{i}') for i, c in enumerate(SETS.values()))}, scored AS ({' UNION ALL '.join(f'''SELECT '{k}' AS fs, * FROM c{i}''' for i, k in enumerate(SETS))}), {sql_ranked('fs, agent')}, per AS ({FULL.format(g='fs, agent')}) SELECT fs, count(*) AS agents, {MACRO} FROM per GROUP BY fs")
def c06(spark, d):
    z = vectors.zscore(staged(features(spark, d).select("id", *FEATURES), "features"), FEATURES)
    per = ablation.condition_metrics(z, pairs(spark, d), SETS, least=1).withColumnRenamed("condition", "fs")
    return rounded(per.groupBy("fs").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


@C.add("P01_P02_feature_set_join", "SELECT p_partkey AS id, p_size AS a1, round(p_retailprice, 6) AS a2, n AS b1 FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def p01(spark, d):
    a = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("a1"), F.round("p_retailprice", 6).alias("a2"))
    return a.join(read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("b1")), "id")


FOLDS = f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, tr AS (SELECT f, agent, id FROM pairs, range(5) t(f) WHERE id % 5 <> f), te AS (SELECT id % 5 AS f, agent, id FROM pairs), pr AS (SELECT f, agent, {', '.join(f'avg({c}) AS p_{c}' for c in ZCOLS)} FROM tr JOIN z USING (id) GROUP BY 1, 2), nn AS (SELECT *, sqrt({' + '.join(f'p_{c} * p_{c}' for c in ZCOLS)}) AS np FROM pr), s AS (SELECT f, agent, id, round(CASE WHEN np * sqrt({' + '.join(f'{c} * {c}' for c in ZCOLS)}) = 0 THEN 0 ELSE ({' + '.join(f'{c} * p_{c}' for c in ZCOLS)}) / (np * sqrt({' + '.join(f'{c} * {c}' for c in ZCOLS)})) END, 9) AS score FROM z JOIN nn ON z.id % 5 = f), scored AS (SELECT s.*, te.id IS NOT NULL AS positive FROM s LEFT JOIN te USING (f, agent, id)), {sql_ranked('f, agent')}, per AS ({FULL.format(g='f, agent')}), fo AS (SELECT f, avg(mrr_best) AS mrr, avg(recall_5) AS r5 FROM per GROUP BY f) SELECT 'observed_mean' AS stat, round(avg(mrr), 6) AS mrr, round(avg(r5), 6) AS recall_5 FROM fo UNION ALL SELECT 'observed_std', round(stddev_samp(mrr), 6), round(stddev_samp(r5), 6) FROM fo"


@C.add("G29_C14_fold_aggregate", FOLDS)
def g29(spark, d):
    labels, z = pairs(spark, d), wide(spark, d).select("id", *ZCOLS)
    train = labels.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("id % 5 <> f")
    proto = train.join(z, "id").groupBy("f", "agent").agg(*(F.avg(c).alias(f"p_{c}") for c in ZCOLS))
    add = lambda g: sum((g(c) for c in ZCOLS), F.lit(0.0))
    n = F.sqrt(add(lambda c: F.col(f"p_{c}") * F.col(f"p_{c}"))) * F.sqrt(add(lambda c: F.col(c) * F.col(c)))
    s = z.withColumn("f", (F.col("id") % 5).cast("int")).join(proto, "f").select("f", "agent", "id", F.round(F.when(n == 0, 0.0).otherwise(add(lambda c: F.col(c) * F.col(f"p_{c}")) / n), 9).alias("score"))
    s = s.join(labels.withColumn("positive", F.lit(True)), ["agent", "id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    fold = ranking.metrics(ranking.ranked(s, ["f", "agent"]), ["f", "agent"]).groupBy("f").agg(F.avg("mrr_best").alias("mrr"), F.avg("recall_5").alias("recall_5"))
    a = fold.agg(*(F.struct(F.avg(c), F.stddev_samp(c)).alias(c) for c in ("mrr", "recall_5")))
    rows = F.array(F.struct(F.lit("observed_mean").alias("stat"), F.col("mrr.col1").alias("mrr"), F.col("recall_5.col1").alias("recall_5")), F.struct(F.lit("observed_std").alias("stat"), F.col("mrr.col2").alias("mrr"), F.col("recall_5.col2").alias("recall_5")))
    return rounded(a.select(F.explode(rows).alias("r")).select("r.*"))


@C.add("G30_B11_seed_aggregate", "WITH s AS (SELECT o_orderkey % 3 AS seed, o_orderpriority AS task, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), m AS (SELECT seed, avg(v) AS v FROM s GROUP BY 1) SELECT count(*) AS seeds, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM m")
def g30(spark, d):
    s = read(spark, d, "orders").groupBy((F.col("o_orderkey") % 3).alias("seed"), "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return rounded(s.groupBy("seed").agg(F.avg("v").alias("v")).agg(F.count("*").alias("seeds"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")), 4)


@C.add("G21_feature_mean_by_id", f"WITH {SQL_FEATURES}, {SQL_PAIRS} SELECT id, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM rawpairs JOIN features USING (id) GROUP BY id")
def g21(spark, d):
    return rounded(pairs(spark, d, distinct=False).join(features(spark, d), "id").groupBy("id").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price")))


@C.add("G31_source_overlap_means", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, s AS (SELECT id, bool_or(data_source = 'A') AS a, bool_or(data_source = 'N') AS b FROM rawpairs GROUP BY 1) SELECT CASE WHEN a AND b THEN 'overlap' WHEN a THEN 'train' WHEN b THEN 'test' ELSE 'other' END AS part, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FEATURES)} FROM s JOIN features USING (id) GROUP BY 1")
def g31(spark, d):
    s = pairs(spark, d, distinct=False).groupBy("id").agg(F.bool_or(F.col("data_source") == "A").alias("a"), F.bool_or(F.col("data_source") == "N").alias("b"))
    part = F.when(F.col("a") & F.col("b"), "overlap").when(F.col("a"), "train").when(F.col("b"), "test").otherwise("other")
    return rounded(s.join(features(spark, d), "id").groupBy(part.alias("part")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in FEATURES)))


CROSSED = ["mrr_best", "recall_5", "recall_10", "ap"]
CROSS_SQL = f"""WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, sp AS (SELECT DISTINCT id, agent, data_source FROM rawpairs), so AS (SELECT data_source FROM sp GROUP BY 1 HAVING count(*) >= 10), dr AS (SELECT a.data_source AS tr, b.data_source AS te, a.data_source || '>' || b.data_source AS direction FROM so a JOIN so b ON a.data_source <> b.data_source),
 tn AS (SELECT direction, agent, id FROM sp JOIN dr ON tr = data_source), ka AS (SELECT direction, agent FROM tn GROUP BY 1, 2 HAVING count(*) >= 2), tt AS (SELECT direction, agent, id FROM sp JOIN dr ON te = data_source JOIN ka USING (direction, agent)),
 pr AS (SELECT direction, agent, {', '.join(f'avg({c}) AS p_{c}' for c in ZCOLS)} FROM tn JOIN ka USING (direction, agent) JOIN z USING (id) GROUP BY 1, 2), s0 AS (SELECT direction, agent, z.id, {' + '.join(f'{c} * p_{c}' for c in ZCOLS)} AS dp, sqrt({' + '.join(f'{c} * {c}' for c in ZCOLS)}) * sqrt({' + '.join(f'p_{c} * p_{c}' for c in ZCOLS)}) AS nn FROM z, pr),
 scored AS (SELECT s0.direction, s0.agent, s0.id, round(CASE WHEN nn = 0 THEN 0 ELSE dp / nn END, 9) AS score, t.id IS NOT NULL AS positive FROM s0 LEFT JOIN tt t ON t.direction = s0.direction AND t.agent = s0.agent AND t.id = s0.id), {sql_ranked('direction, agent')}, per AS ({FULL.format(g='direction, agent')}),
 lg AS ({' UNION ALL '.join(f"SELECT direction, agent, '{m}' AS metric, {m} AS value FROM per WHERE {m} IS NOT NULL" for m in CROSSED)}), x AS (SELECT direction, metric, agent AS o, value AS v FROM lg), {sql_bootstrap('direction, metric', 42, 'avg')}, iv AS (SELECT direction, metric, {SQL_INTERVAL} FROM b GROUP BY 1, 2), ob AS (SELECT direction, metric, count(*) AS agents, avg(value) AS observed FROM lg GROUP BY 1, 2)"""


@C.add("C05_source_evaluation_ci", f"{CROSS_SQL} SELECT direction, metric, agents, round(observed, 6) AS observed, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ob JOIN iv USING (direction, metric)")
def c05(spark, d):
    """Prototypes learnt from one source rank the other's positives, for every ordered pair of sources with ten pairs or more;
    bootstrap intervals of each metric's mean over agents."""
    own = pairs(spark, d, distinct=False).select("id", "agent", "data_source").distinct()
    sources = own.groupBy("data_source").agg(F.count("*").alias("n")).filter("n >= 10").select("data_source")
    ways = sources.select(F.col("data_source").alias("tr")).join(sources.select(F.col("data_source").alias("te")), F.col("tr") != F.col("te")).withColumn("direction", F.concat("tr", F.lit(">"), "te"))
    z = staged(wide(spark, d).select("id", *ZCOLS), "crossed")
    train = own.join(ways, F.col("tr") == F.col("data_source")).select("direction", "agent", "id")
    known = train.groupBy("direction", "agent").agg(F.count("*").alias("c")).filter("c >= 2").select("direction", "agent")
    test = own.join(ways, F.col("te") == F.col("data_source")).select("direction", "agent", "id").join(known, ["direction", "agent"], "left_semi")
    proto = train.join(known, ["direction", "agent"], "left_semi").join(z, "id").groupBy("direction", "agent").agg(*(F.avg(c).alias(f"p_{c}") for c in ZCOLS))
    at = F.col("id").alias("at")
    groups = proto.select("direction", "agent", F.array(*(f"p_{c}" for c in ZCOLS)).alias("p"))
    asked = test.join(z, "id").select("direction", "agent", at, F.array(*ZCOLS).alias("z"))
    rows = z.select(at, F.array(*ZCOLS).alias("z"))
    per = staged(positive_ranks(groups, asked, rows, ["direction", "agent"], z.count(), 150, summed=True), "crossed-metrics")
    long = per.unpivot(["direction", "agent"], CROSSED, "metric", "value").filter("value is not null")
    seen = long.groupBy("direction", "metric").agg(F.count("*").alias("agents"), F.avg("value").alias("observed"))
    drawn = bootstrap.interval(bootstrap.bootstrap(long, "value", "agent", 1000, 42, ["direction", "metric"]), ["direction", "metric"])
    out = seen.join(drawn, ["direction", "metric"]).select("direction", "metric", "agents", "observed", "mean", "lo", "hi")
    # Means of few distinct values often lie halfway between six-digit numbers: sums in another order must not part them.
    return rounded(rounded(out, 12))


@C.add("C15_distance_bins", "WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), nr AS (SELECT t.id, round(min(list_distance(t.e, s.e)), 9) AS dist FROM x t, x s WHERE t.id % 5 = 0 AND s.id % 5 <> 0 GROUP BY 1), q AS (SELECT quantile_cont(dist, 0.25) AS a, quantile_cont(dist, 0.5) AS b, quantile_cont(dist, 0.75) AS c FROM nr) SELECT CASE WHEN dist <= a THEN 1 WHEN dist <= b THEN 2 WHEN dist <= c THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(dist), 6) AS mean FROM nr, q GROUP BY 1")
def c15(spark, d):
    near = nearest_train(spark, d, 5).withColumn("dist", F.round("dist", 9))
    edges = near.agg(F.percentile("dist", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    x = near.crossJoin(F.broadcast(edges)).withColumn("bin", (F.size(F.filter("q", lambda v: v < F.col("dist"))) + 1).cast("int"))
    return rounded(x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("dist").alias("mean")))


def vectors_of(z, cols):
    return z.select("id", F.array(*cols).alias("z"))


@C.add("T19_noise_sweep")
def t19(spark, d):
    """Five noise levels of fifty draws: metrics of each level, averaged over agents, then over draws."""
    levels = (0.0, 0.02, 0.05, 0.1, 0.2)
    z = vectors_of(staged(wide(spark, d).select("id", *ZCOLS), "noise"), ZCOLS)
    per = resampling.noise_sweep(z, pairs(spark, d), len(ZCOLS), levels, summed=True)
    one = per.groupBy("draw").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS))
    noise = F.element_at(F.array(*map(F.lit, levels)), F.floor(F.col("draw") / 50).cast("int") + 1)
    return rounded(one.groupBy(noise.alias("noise")).agg(F.count("*").alias("draws"), F.max("agents").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


@C.add("T20_size_residual_test", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, r AS (SELECT id, avg_qty - (regr_intercept(avg_qty, n_lines) OVER () + regr_slope(avg_qty, n_lines) OVER () * n_lines) AS res FROM features), sc AS (SELECT agent, avg(res) AS score, count(*) AS n FROM pairs JOIN r USING (id) GROUP BY 1) SELECT agent, n, round(score, 6) AS score FROM sc WHERE n >= 2")
def t20(spark, d):
    f = features(spark, d)
    fit = f.agg(F.regr_intercept("avg_qty", "n_lines").alias("c0"), F.regr_slope("avg_qty", "n_lines").alias("c1"))
    r = f.crossJoin(F.broadcast(fit)).select("id", (F.col("avg_qty") - (F.col("c0") + F.col("c1") * F.col("n_lines"))).alias("res"))
    return rounded(pairs(spark, d).join(r, "id").groupBy("agent").agg(F.count("*").alias("n"), F.avg("res").alias("score")).filter("n >= 2"))


PROBED = ["z_avg_qty", "z_avg_disc"]
SIZES = ["z_p_size", "z_n_lines"]


def residual_columns(z):
    """`z` with the residual of each probed column on the two size columns."""
    fit = vectors.plane_fit(z, PROBED, *SIZES)
    plane = lambda y: F.col(f"r_{y}.c0") + F.col(f"r_{y}.ca") * F.col(SIZES[0]) + F.col(f"r_{y}.cb") * F.col(SIZES[1])
    return z.crossJoin(F.broadcast(fit)).withColumns({f"{y}_resid": F.col(y) - plane(y) for y in PROBED}).select(*z.columns, *(f"{y}_resid" for y in PROBED))


def top_preferences(z, labels, k: int = 10):
    """(agent, n_positives, means of the probed columns and their residuals over the agent's first `k` rows)."""
    w = Window.partitionBy("agent").orderBy(F.desc("score"), "id")
    top = wide_scores(z, labels, ZCOLS).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("agent", "id")
    size = labels.groupBy("agent").agg(F.count("*").alias("n_positives")).filter("n_positives >= 2")
    cols = [c for y in PROBED for c in (y, f"{y}_resid")]
    return top.join(z.select("id", *cols), "id").groupBy("agent").agg(*(F.avg(c).alias(c) for c in cols)).join(size, "agent")


def _sql_plane(y: str) -> str:
    a, b = SIZES
    det = f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b}))"
    ca = f"((covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b})) / {det})"
    cb = f"((covar_pop({b}, {y}) * var_pop({a}) - covar_pop({a}, {y}) * covar_pop({a}, {b})) / {det})"
    return f"{ca} AS ca_{y}, {cb} AS cb_{y}, avg({y}) - {ca} * avg({a}) - {cb} * avg({b}) AS c0_{y}"


@C.add("T20_top_residuals", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {sql_wide(ZCOLS)}, {sql_ranked('agent')}, ft AS (SELECT {', '.join(map(_sql_plane, PROBED))} FROM z), zr AS (SELECT id, {', '.join(f'{y}, {y} - (c0_{y} + ca_{y} * {SIZES[0]} + cb_{y} * {SIZES[1]}) AS {y}_resid' for y in PROBED)} FROM z, ft), np AS (SELECT agent, count(*) AS n_positives FROM pairs GROUP BY 1 HAVING count(*) >= 2) SELECT agent, max(n_positives) AS n_positives, {', '.join(f'round(avg({c}), 6) AS {c}' for y in PROBED for c in (y, y + '_resid'))} FROM ranked JOIN zr USING (id) JOIN np USING (agent) WHERE rank <= 10 GROUP BY agent")
def t20_top(spark, d):
    return rounded(top_preferences(staged(residual_columns(wide(spark, d)), "residuals"), pairs(spark, d)))


def accessibility(z, labels, k: int = 10, repeats: int = 10_000, seed: int = 1):
    """Per agent: means over its first `k` rows, two-sided p of the residuals' means against `repeats` draws of `k` of all rows, and
    Benjamini-Hochberg flags over the agents; the correlation of each probed column with size. The null does not depend on the
    agent, so all agents share its draws, which are counted by value, not met one by one."""
    resid = [f"{y}_resid" for y in PROBED]
    top = top_preferences(z, labels, k)
    null = resampling.top_k_null(z.select("id", *resid), resid, k, repeats, seed)
    sizes = null.groupBy("feature").agg(F.sort_array(F.collect_list(F.abs("null"))).alias("sizes"))  # `repeats` numbers a column
    long = top.unpivot(["agent"], resid, "feature", "value").join(F.broadcast(sizes), "feature")
    hits = F.size(F.filter("sizes", lambda v: v >= F.abs("value")))
    p = long.select("agent", "feature", ((1 + hits) / (1 + F.size("sizes"))).alias("p"))
    flagged = stats.corrections(p, "p", "agent", groups=["feature"]).select("agent", "feature", "p", "bh")
    wide_p = flagged.groupBy("agent").agg(*(F.max(F.when(F.col("feature") == c, F.col(x))).alias(f"{x}_{c}") for c in resid for x in ("p", "bh")))
    corr = z.agg(*(F.corr(y, SIZES[0]).alias(f"corr_{y}") for y in PROBED))
    return top.join(wide_p, "agent").crossJoin(F.broadcast(corr))


@C.add("T20_accessibility")
def t20_test(spark, d):
    return rounded(accessibility(staged(residual_columns(wide(spark, d)), "residuals"), pairs(spark, d)))


FIRST = 1024  # rows of an agent at which T21 looks before it draws all positives


@C.add("T21_matched_null")
def t21(spark, d):
    """Scores permuted inside bands of ten sizes, 200 times."""
    z = marked(spark, d)
    scored = marked_scores(z, ZCOLS)
    top = staged(ranking.best_ranked(scored, ["agent"], F.lit(FIRST)).select("agent", "id", "rank", "positive").filter(f"positive or rank <= {FIRST}"), "top")
    seen = top.filter("positive").groupBy("agent").agg((1.0 / F.min("rank")).alias("mrr_best"))
    seen = ranking.macro(seen, ["mrr_best"]).select(F.col("mrr_best").alias("seen"))
    own = z.select("id", F.explode("own").alias("agent"))
    null = resampling.matched_best(scored, top.filter(f"rank <= {FIRST}"), own, z.select("id", F.floor(F.col("p_size") / 10).cast("int").alias("s")))
    return rounded(stats.empirical_p(null.groupBy("rep").agg(F.avg(1.0 / F.col("best")).alias("m")), seen, [], "m", "seen"))


STABLE = [c for c in FEATURES if c != "p_size"]
BANDS = f"""WITH {SQL_FEATURES}, cl AS (SELECT p_size::BIGINT AS size, count(*) AS c FROM features GROUP BY 1), bands AS (SELECT a.size AS band, b.size FROM cl a JOIN cl b ON abs(a.size - b.size) <= CASE WHEN a.c >= 5 THEN 0 ELSE 1 END),
 fl AS ({' UNION ALL '.join(f"SELECT id, p_size::BIGINT AS size, '{c}' AS feature, {c} AS value FROM features" for c in STABLE)}), x AS (SELECT band, feature, id AS o, value AS v FROM fl JOIN bands USING (size) WHERE value IS NOT NULL),
 wd AS (SELECT band, feature, count(*) AS n, var_pop(v) AS w FROM x GROUP BY 1, 2), {sql_bootstrap('band, feature', 42, 'avg')}, iv AS (SELECT band, feature, {SQL_INTERVAL} FROM b GROUP BY 1, 2),
 bf AS (SELECT band, feature, n, CASE WHEN n >= 3 THEN mean END AS mean, CASE WHEN n >= 3 THEN lo END AS lo, CASE WHEN n >= 3 THEN hi END AS hi, CASE WHEN n >= 3 THEN std ELSE 0 END AS std, CASE WHEN n >= 3 THEN w ELSE 0 END AS within_var FROM iv JOIN wd USING (band, feature))"""


def stability(spark, d):
    return bootstrap.band_bootstrap(features(spark, d), "id", "p_size", STABLE)


@C.add("C12_T16_stability", f"{BANDS} SELECT band, feature, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(std, 6) AS std, round(within_var, 6) AS within_var FROM bf")
def c12(spark, d):
    """Bootstrap of each feature inside each band of similar size: mean, interval, deviation and the band's own variance."""
    return rounded(stability(spark, d)[0])


@C.add("C12_feature_stability", f"{BANDS} SELECT feature, count(*) AS rows, round(avg(value), 6) AS mean_value, round(median(std), 6) AS median_std, round(avg(std), 6) AS mean_std, round(CASE WHEN avg(value) <> 0 THEN avg(std) / abs(avg(value)) ELSE 0 END, 6) AS cv FROM fl JOIN bf ON bf.band = fl.size AND bf.feature = fl.feature GROUP BY fl.feature".replace("SELECT feature, count(*) AS rows", "SELECT fl.feature, count(*) AS rows"))
def c12_summary(spark, d):
    return rounded(stability(spark, d)[1])


@C.add("C17_C18_release_summary", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {sql_z(FEATURES[:2])} SELECT 'pairs' AS metric, printf('%.3f', count(*)::DOUBLE) AS value FROM pairs UNION ALL SELECT 'agents', printf('%.3f', count(DISTINCT agent)::DOUBLE) FROM pairs UNION ALL SELECT 'mean_z', printf('%.3f', abs(round(avg(z_p_size), 3))) FROM z")
def c17(spark, d):
    text = lambda c: F.format_string("%.3f", c.cast("double"))
    p = pairs(spark, d)
    rows = p.agg(text(F.count("*")).alias("value")).withColumn("metric", F.lit("pairs")).unionByName(p.agg(text(F.countDistinct("agent")).alias("value")).withColumn("metric", F.lit("agents")))
    return rows.unionByName(vectors.zscore(features(spark, d), FEATURES[:2]).agg(text(F.abs(F.round(F.avg("z_p_size"), 3))).alias("value")).withColumn("metric", F.lit("mean_z")))
