"""Ranking, baselines, ablation and windows (M, B, W, J08-J12, P03-P04, X24-X25, C06-C08, G11-G12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cityblock, cosine, euclidean
from tidemark.operators import ablation, distances, ranking, vectors
from tidemark.plans.base import FEATURES, SQL_FEATURES, SQL_INTERVAL, SQL_METRICS, SQL_PAIRS, Catalog, features, pairs, read, rounded, sql_bootstrap, sql_ranked, sql_tail, sql_z
from tidemark.sources.scratch import staged

C = Catalog()
QUERIES, SQL = C.queries, C.sql
KS = [1, 3, 5, 10, 20]
METRICS = ["mrr_best", "mrr_mean", *(f"recall_{k}" for k in KS), "mean_rank", "ap"]

EMBED = """long AS (SELECT vec_id AS id, label AS own, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
 st AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY j),
 z AS (SELECT id, own, j, CASE WHEN s = 0 THEN 0.0 ELSE (x - m) / s END AS z FROM long JOIN st USING (j)),
 nz AS (SELECT id, own, sqrt(sum(z * z)) AS nz FROM z GROUP BY id, own)"""
PROTO = """proto AS (SELECT own AS agent, j, avg(z) AS p FROM z WHERE own IS NOT NULL GROUP BY own, j), np AS (SELECT agent, sqrt(sum(p * p)) AS np FROM proto GROUP BY agent),
 dots AS (SELECT id, agent, sum(z * p) AS d FROM z JOIN proto USING (j) GROUP BY id, agent),
 scored AS (SELECT agent, id, round(CASE WHEN nz * np = 0 THEN 0 ELSE d / (nz * np) END, 9) AS score, coalesce(own = agent, FALSE) AS positive FROM dots JOIN nz USING (id) JOIN np USING (agent))"""


def embedded(spark, d) -> DataFrame:
    return ranking.prototype_scores(read(spark, d, "embeddings"), "embedding", "vec_id", "label")


@C.add("M02_prototype_ranking", f"WITH {EMBED}, {PROTO}, {sql_ranked('agent')} {SQL_METRICS.format(g='agent')}")
def m02(spark, d):
    return rounded(ranking.metrics(ranking.ranked(embedded(spark, d), ["agent"]), ["agent"]))


MACRO = ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS)
MICRO = ", ".join(f"round(sum({c} * n_pos) / sum(n_pos), 6) AS {c}" for c in METRICS)
FULL = SQL_METRICS.replace("round(", "(").replace(", 6)", ")")


@C.add("G11_macro_average", f"WITH {EMBED}, {PROTO}, {sql_ranked('agent')}, per AS ({FULL.format(g='agent')}) SELECT count(*) AS agents, {MACRO} FROM per")
def g11(spark, d):
    return rounded(ranking.macro(ranking.metrics(ranking.ranked(embedded(spark, d), ["agent"]), ["agent"]), METRICS))


@C.add("G12_micro_average", f"WITH {EMBED}, {PROTO}, {sql_ranked('agent')}, per AS ({FULL.format(g='agent')}) SELECT sum(n_pos)::BIGINT AS weight, {MICRO} FROM per")
def g12(spark, d):
    return rounded(ranking.micro(ranking.metrics(ranking.ranked(embedded(spark, d), ["agent"]), ["agent"]), METRICS))


@C.add("W04_top_k_per_agent", f"WITH {EMBED}, {PROTO}, {sql_ranked('agent')} SELECT agent, id, rank, round(score, 6) AS score, positive FROM ranked WHERE rank <= 5")
def w04(spark, d):
    w = Window.partitionBy("agent").orderBy(F.desc("score"), "id")
    return rounded(embedded(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5"))


@C.add("W02_ascending_distance_rank", "WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT q, vec_id AS id, round(list_distance(e::DOUBLE[], embedding::DOUBLE[]), 9) AS dist FROM q, embeddings WHERE q <> vec_id) SELECT q, id, round(dist, 6) AS dist, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM x")
def w02(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return distances.distance_ranks(e, e.filter("id % 100 = 0"), digits=6)


@C.add("M01_prototypes", f"WITH {EMBED} SELECT own AS agent, (j - 1)::INT AS j, round(avg(z), 6) AS p FROM z WHERE own IS NOT NULL GROUP BY own, j")
def m01(spark, d):
    z = vectors.zscore_array(read(spark, d, "embeddings"), "embedding").filter("label is not null")
    return vectors.long_form(z, "z", "label").groupBy(F.col("label").alias("agent"), "j").agg(F.round(F.avg("x"), 6).alias("p"))


ZF = sql_z(FEATURES)
ZCOLS = [f"z_{c}" for c in FEATURES]


def wide(spark, d) -> DataFrame:
    return vectors.zscore(features(spark, d), FEATURES)


def _cosines(base: DataFrame, proto: DataFrame, cols: list[str]) -> DataFrame:
    """All rows (…, cols) by all prototypes (agent, p_ and each of cols), with their score."""
    dot = sum((F.col(c) * F.col(f"p_{c}") for c in cols), F.lit(0.0))
    nz = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    np_ = F.sqrt(sum((F.col(f"p_{c}") * F.col(f"p_{c}") for c in cols), F.lit(0.0)))
    return base.crossJoin(proto).withColumn("score", F.round(F.when(nz * np_ == 0, 0.0).otherwise(dot / (nz * np_)), 9))


def wide_scores(z: DataFrame, labels: DataFrame, cols: list[str], clamp: bool = False, how: str = "prototype") -> DataFrame:
    """(agent, id, score, positive) over wide standardised columns, by cosine with the agent's mean."""
    base = z.select("id", *cols)
    proto = labels.join(base, "id").groupBy("agent").agg(*(F.avg(c).alias(f"p_{c}") for c in cols))
    x = _cosines(base, proto, cols).select("agent", "id", "score")
    return x.join(labels.withColumn("positive", F.lit(True)), ["agent", "id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def marked(spark, d) -> DataFrame:
    """Standardised features with `own`, the agents of each row; tables are read once, for a staged copy of a row a part."""
    own = pairs(spark, d, distinct=False).groupBy("id").agg(F.collect_set("agent").alias("own"))
    return vectors.zscore(staged(features(spark, d).select("id", *FEATURES).join(own, "id", "left"), "marked"), FEATURES)


def marked_scores(z: DataFrame, cols: list[str]) -> DataFrame:
    """`wide_scores` of rows with `own`: scores meet no labels in a join, so they are cheap to make again."""
    proto = z.select(F.explode("own").alias("agent"), *cols).groupBy("agent").agg(*(F.avg(c).alias(f"p_{c}") for c in cols))
    x = _cosines(z.select("id", "own", *cols), staged(proto, "prototypes"), cols)
    return x.select("agent", "id", "score", F.coalesce(F.array_contains("own", F.col("agent")), F.lit(False)).alias("positive"))


def sql_wide(cols: list[str], z: str = "z", labels: str = "pairs", out: str = "scored", extra: str = "") -> str:
    means = ", ".join(f"avg({c}) AS p_{c}" for c in cols)
    dot = " + ".join(f"{c} * p_{c}" for c in cols)
    nz = "sqrt(" + " + ".join(f"{c} * {c}" for c in cols) + ")"
    np_ = "sqrt(" + " + ".join(f"p_{c} * p_{c}" for c in cols) + ")"
    return f"{out}_p AS (SELECT agent, {means} FROM {labels} JOIN {z} USING (id) GROUP BY agent), {out} AS (SELECT p.agent, z.id, round(CASE WHEN {nz} * {np_} = 0 THEN 0 ELSE ({dot}) / ({nz} * {np_}) END, 9) AS score, l.id IS NOT NULL AS positive FROM {z} z CROSS JOIN {out}_p p LEFT JOIN {labels} l ON l.agent = p.agent AND l.id = z.id)"


@C.add("M09_wide_evaluation", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {sql_wide(ZCOLS)}, {sql_ranked('agent')} {SQL_METRICS.format(g='agent')}")
def m09(spark, d):
    return rounded(ranking.metrics(ranking.ranked(wide_scores(wide(spark, d), pairs(spark, d), ZCOLS), ["agent"]), ["agent"]))


BLOCKS = {"size": ["z_p_size", "z_n_lines"], "price": ["z_p_retailprice"], "discount": ["z_avg_disc"], "tax": ["z_avg_tax"], "quantity": ["z_avg_qty", "z_sd_qty"], "shipping": ["z_avg_ship"]}
CONDITIONS = ablation.block_conditions(BLOCKS)


def block_metrics(spark, d) -> DataFrame:
    """(condition, agent, metrics) of the thirteen conditions."""
    z = vectors.zscore(staged(features(spark, d).select("id", *FEATURES), "features"), FEATURES)
    return ablation.condition_metrics(z, pairs(spark, d), CONDITIONS)


ABLATE = ", ".join(sql_wide(cols, out=f"c_{k}") for k, cols in CONDITIONS.items())
UNION = " UNION ALL ".join(f"SELECT '{k}' AS condition, * FROM c_{k}" for k in CONDITIONS)
ABLATED = f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {ABLATE}, scored AS ({UNION}), {sql_ranked('condition, agent')}, per AS ({FULL.format(g='condition, agent')} HAVING count(*) >= 2)"


@C.add("C07_block_ablation", f"{ABLATED} SELECT condition, count(*) AS agents, {MACRO} FROM per GROUP BY condition")
def c07(spark, d):
    return rounded(block_metrics(spark, d).groupBy("condition").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


PAIRED = f"""{ABLATED}, lg AS ({' UNION ALL '.join(f"SELECT condition, agent, '{m}' AS metric, {m} AS value FROM per WHERE {m} IS NOT NULL" for m in ablation.COMPARED)}),
 bo AS (SELECT x.condition, x.metric, x.agent, x.value, y.value AS base, round(x.value - y.value, 9) AS delta FROM lg x JOIN lg y ON y.condition = 'all' AND y.agent = x.agent AND y.metric = x.metric WHERE x.condition <> 'all'),
 sh AS (SELECT condition, metric, count(*) AS n_agents, avg(base) AS mean_all, avg(value) AS mean_cond, avg(delta) AS mean_delta, median(delta) AS median_delta FROM bo GROUP BY 1, 2 HAVING count(*) >= 10),
 x AS (SELECT condition, metric, agent AS o, delta AS v FROM bo), {sql_bootstrap('condition, metric', 1, 'median')}, iv AS (SELECT condition, metric, {SQL_INTERVAL} FROM b GROUP BY 1, 2),
 rk AS (SELECT condition, metric, delta, rank() OVER (PARTITION BY condition, metric ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY condition, metric, abs(delta)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY condition, metric, abs(delta)) AS t FROM bo WHERE delta <> 0),
 ws AS (SELECT condition, metric, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS wm, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY 1, 2),
 wz AS (SELECT condition, metric, least(wp, wm) AS w, abs(wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM ws), wt AS (SELECT condition, metric, w, least(1.0, 2 * ({sql_tail('z')})) AS p FROM wz),
 ho AS (SELECT sh.*, lo, hi, w, p, row_number() OVER v AS k, count(*) OVER (PARTITION BY metric) AS n FROM sh JOIN iv USING (condition, metric) LEFT JOIN wt USING (condition, metric) WINDOW v AS (PARTITION BY metric ORDER BY round(coalesce(p, 1.0), 12), condition))
SELECT condition, metric, n_agents, round(mean_all, 6) AS mean_all, round(mean_cond, 6) AS mean_cond, round(mean_delta, 6) AS mean_delta, round(median_delta, 6) AS median_delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(w, 6) AS w, round(p, 6) AS p,
 min((round(coalesce(p, 1.0), 12) <= 0.05 / (n - k + 1))::INT) OVER (PARTITION BY metric ORDER BY k) = 1 AS sig_holm FROM ho"""


@C.add("C07_ablation_statistics", PAIRED)
def c07_statistics(spark, d):
    """Twelve conditions by four metrics against all columns. The normal p, as SQL has it."""
    return rounded(ablation.paired_statistics(staged(block_metrics(spark, d), "ablation"), exact=False))


OLS_SQL = """reg AS (SELECT {parts} FROM features), z0 AS (SELECT id, {res} FROM features, reg)"""
RES = [c for c in FEATURES if c not in ("p_size", "n_lines")]


def _coef(y: str) -> str:
    a, b = "p_size", "n_lines"
    det = f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b}))"
    ca = f"((covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b})) / {det})"
    cb = f"((covar_pop({b}, {y}) * var_pop({a}) - covar_pop({a}, {y}) * covar_pop({a}, {b})) / {det})"
    return f"{ca} AS ca_{y}, {cb} AS cb_{y}, avg({y}) - {ca} * avg({a}) - {cb} * avg({b}) AS c0_{y}"


OLS = OLS_SQL.format(parts=", ".join(map(_coef, RES)), res=", ".join(f"{y} - (c0_{y} + ca_{y} * p_size + cb_{y} * n_lines) AS {y}" for y in RES))


def residualised(spark, d) -> DataFrame:
    f = features(spark, d)
    fit = vectors.plane_fit(f, RES, "p_size", "n_lines")
    return f.crossJoin(F.broadcast(fit)).select("id", *((F.col(y) - (F.col(f"r_{y}.c0") + F.col(f"r_{y}.ca") * F.col("p_size") + F.col(f"r_{y}.cb") * F.col("n_lines"))).alias(y) for y in RES))


@C.add("B12_size_residuals", f"WITH {SQL_FEATURES}, {OLS} SELECT id, {', '.join(f'round({y}, 6) AS {y}' for y in RES)} FROM z0")
def b12(spark, d):
    return rounded(residualised(spark, d))


RZ = ["z_" + c for c in RES]
SIZE = BLOCKS["size"]
RESIDUAL = {"raw": ZCOLS, "size_only": SIZE, "residualized": [*SIZE, *(f"r{c}" for c in RZ)], "non_size_only": [c for c in ZCOLS if c not in SIZE], "residuals_alone": [f"r{c}" for c in RZ]}


def residual_metrics(spark, d, *conditions: str) -> DataFrame:
    """(condition, agent, metrics): raw and residualised columns are standardised side by side in one table of candidates."""
    f = staged(features(spark, d).select("id", *FEATURES), "features")
    fit = vectors.plane_fit(f, RES, "p_size", "n_lines")
    plane = lambda y: F.col(f"r_{y}.c0") + F.col(f"r_{y}.ca") * F.col("p_size") + F.col(f"r_{y}.cb") * F.col("n_lines")
    both = f.crossJoin(F.broadcast(fit)).select("id", *FEATURES, *((F.col(y) - plane(y)).alias(f"res_{y}") for y in RES))
    z = vectors.zscore(both, [*FEATURES, *(f"res_{y}" for y in RES)]).withColumnsRenamed({f"z_res_{y}": f"rz_{y}" for y in RES})
    return ablation.condition_metrics(z, pairs(spark, d), {c: RESIDUAL[c] for c in conditions})


@C.add("C08_residual_ranking", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {OLS}, {sql_z(RES, 'z0', 'z')}, {sql_wide(['z_' + c for c in RES])}, {sql_ranked('agent')}, per AS ({FULL.format(g='agent')}) SELECT count(*) AS agents, {MACRO} FROM per")
def c08(spark, d):
    return rounded(ranking.macro(residual_metrics(spark, d, "residuals_alone"), METRICS))


FOUR = ["raw", "size_only", "residualized", "non_size_only"]
RESIDUALS = f"""WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {OLS}, {sql_z(RES, 'z0', 'zr')}, zz AS (SELECT z.*, {', '.join(f'zr.z_{c} AS rz_{c}' for c in RES)} FROM z JOIN zr USING (id)),
 {', '.join(sql_wide(RESIDUAL[k], z='zz', out=f'k_{k}') for k in FOUR)}, scored AS ({' UNION ALL '.join(f"SELECT '{k}' AS condition, * FROM k_{k}" for k in FOUR)}), {sql_ranked('condition, agent')}, per AS ({FULL.format(g='condition, agent')} HAVING count(*) >= 2)"""


@C.add("C08_residualisation", f"{RESIDUALS} SELECT condition, count(*) AS agents, {MACRO} FROM per GROUP BY condition")
def c08_conditions(spark, d):
    """Raw columns, size alone, size with the others' residuals on it, and the others alone."""
    return rounded(residual_metrics(spark, d, *FOUR).groupBy("condition").agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in METRICS)))


DELTA = "SELECT agent, '{m}' AS metric, round(x.{m}, 6) AS val_residualized, round(y.{m}, 6) AS val_raw, round(w.{m}, 6) AS val_size_only, round(x.{m} - y.{m}, 6) AS delta_raw, round(x.{m} - w.{m}, 6) AS delta_size_only FROM per x JOIN per y USING (agent) JOIN per w USING (agent) WHERE x.condition = 'residualized' AND y.condition = 'raw' AND w.condition = 'size_only'"


@C.add("C08_deltas", f"{RESIDUALS} {' UNION ALL '.join(DELTA.format(m=m) for m in ablation.COMPARED)}")
def c08_deltas(spark, d):
    return rounded(ablation.condition_deltas(residual_metrics(spark, d, *FOUR[:3]), "residualized", ["raw", "size_only"]))


@C.add("B03_nearest_positive", "WITH q AS (SELECT vec_id AS a, label AS agent, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL) SELECT agent, vec_id AS id, round(max(list_cosine_similarity(e, embedding::DOUBLE[])), 6) AS score FROM q JOIN embeddings ON TRUE GROUP BY agent, vec_id")
def b03(spark, d):
    e = doubles(spark, d)
    best = vectors.block_extremes(e, e.filter("label is not null").select(F.col("label").alias("group"), "e"), "cosine")
    return best.select(F.col("group").alias("agent"), "id", F.round("value", 6).alias("score"))


def doubles(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def nearest_train(spark, d, folds: int) -> DataFrame:
    """(id, dist): distance of each test row (the fold of ids divisible by `folds`) to its nearest training row."""
    e = doubles(spark, d)
    train = e.filter(F.col("id") % folds != 0).select(F.lit(0).alias("group"), "e")
    return vectors.block_extremes(e.filter(F.col("id") % folds == 0), train, "distance").select("id", F.col("value").alias("dist"))


# The test fold of the next query is one tenth of the ids, as in ten-fold evaluation.
@C.add("B09_distance_to_train", "WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT t.id, round(min(list_distance(t.e, s.e)), 6) AS nearest FROM x t, x s WHERE t.id % 10 = 0 AND s.id % 10 <> 0 GROUP BY t.id")
def b09(spark, d):
    return nearest_train(spark, d, 10).select("id", F.round("dist", 6).alias("nearest"))


@C.add("X25_distances", "SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclid, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS cityblock, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x25(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    o = e.select((F.col("id") - 1).alias("id"), F.col("e").alias("o"))
    a, b = F.col("e"), F.col("o")
    return e.join(o, "id").select("id", F.round(euclidean(a, b), 6).alias("euclid"), F.round(cityblock(a, b), 6).alias("cityblock"), F.round(1 - cosine(a, b), 6).alias("cosine"))


@C.add("X24_cosine_zero_norm", "SELECT vec_id AS id, round(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) END, 6) AS score FROM embeddings")
def x24(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    a = F.when(F.col("vec_id") % 7 == 0, F.transform(e, lambda x: x * 0.0)).otherwise(e)
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(cosine(a, F.reverse(e)), 6).alias("score"))


@C.add("P04_zscore", f"WITH {SQL_FEATURES}, {ZF} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in ZCOLS)} FROM z")
def p04(spark, d):
    return rounded(wide(spark, d).select("id", *ZCOLS))


@C.add("P03_median_imputation", "WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS a, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS b FROM part) SELECT id, round(coalesce(a, (SELECT median(a) FROM x), 0.0), 6) AS a, round(coalesce(b, (SELECT median(b) FROM x), 0.0), 6) AS b, 0.0::DOUBLE AS c FROM x")
def p03(spark, d):
    p = read(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, float("nan")).otherwise(F.col("p_size").cast("double")).alias("a"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("b"), F.lit(None).cast("double").alias("c"))
    return rounded(vectors.impute_median(x, ["a", "b", "c"]))


@C.add("M08_fold_evaluation", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, train AS (SELECT * FROM pairs WHERE id % 5 <> 0), test AS (SELECT * FROM pairs WHERE id % 5 = 0), {sql_wide(ZCOLS, labels='train', out='s')}, scored AS (SELECT s.agent, s.id, s.score, t.id IS NOT NULL AS positive FROM s LEFT JOIN test t ON t.agent = s.agent AND t.id = s.id WHERE s.id % 5 = 0), {sql_ranked('agent')} {SQL_METRICS.format(g='agent')}")
def m08(spark, d):
    labels = pairs(spark, d)
    s = wide_scores(wide(spark, d), labels.filter("id % 5 <> 0"), ZCOLS).drop("positive").filter("id % 5 = 0")
    test = labels.filter("id % 5 = 0").withColumn("positive", F.lit(True))
    scored = s.join(test, ["agent", "id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    return rounded(ranking.metrics(ranking.ranked(scored, ["agent"]), ["agent"]))


LOPO = f"""SELECT agent, count(*) AS n_pos, round((sum(1.0 / rank) - max(1.0 / rank)) / (count(*) - 1), 6) AS mrr_without_best, round(avg(1.0 / rank), 6) AS mrr_lopo, round(stddev_samp(1.0 / rank), 6) AS sd_lopo, round(avg(rank), 6) AS mean_rank FROM ranked WHERE positive GROUP BY agent HAVING count(*) > 1"""


@C.add("M10_leave_one_positive_out", f"WITH {SQL_FEATURES}, {SQL_PAIRS}, {ZF}, {sql_wide(ZCOLS)}, {sql_ranked('agent')} {LOPO}")
def m10(spark, d):
    r = ranking.ranked(wide_scores(wide(spark, d), pairs(spark, d), ZCOLS), ["agent"]).filter("positive").withColumn("x", 1.0 / F.col("rank"))
    mean, sd = ranking.leave_one_out("x")
    a = r.groupBy("agent").agg(F.count("*").alias("n_pos"), ((F.sum("x") - F.max("x")) / (F.count("*") - 1)).alias("mrr_without_best"), mean.alias("mrr_lopo"), sd.alias("sd_lopo"), F.avg(F.col("rank").cast("double")).alias("mean_rank"))
    return rounded(a.filter("n_pos > 1"))


@C.add("M07_external_scores", f"WITH {SQL_PAIRS}, agents AS (SELECT DISTINCT agent FROM pairs), scored AS (SELECT a.agent, p_partkey AS id, round(p_retailprice / 10000.0, 9) AS score, l.id IS NOT NULL AS positive FROM part CROSS JOIN agents a LEFT JOIN pairs l ON l.agent = a.agent AND l.id = p_partkey), {sql_ranked('agent')} {SQL_METRICS.format(g='agent')}")
def m07(spark, d):
    labels = pairs(spark, d)
    x = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") / 10000.0, 9).alias("score")).crossJoin(labels.select("agent").distinct())
    scored = x.join(labels.withColumn("positive", F.lit(True)), ["agent", "id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    return rounded(ranking.metrics(ranking.ranked(scored, ["agent"], low=0.0), ["agent"]))


@C.add("W05_top_n_global", "SELECT p_partkey AS id, round(p_retailprice, 6) AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def w05(spark, d):
    return read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_partkey").alias("id"), F.round("p_retailprice", 6).alias("price"))


@C.add("W06_best_per_category", "SELECT p_brand, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1 ORDER BY p_brand LIMIT 10")
def w06(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r = 1").orderBy("p_brand").limit(10).select("p_brand", F.col("p_partkey").alias("id"))


@C.add("W10_average_ranks", "SELECT p_partkey AS id, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r FROM part")
def w10(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", ranking.average_rank("p_size", "p_brand").alias("r"))


@C.add("W11_cumulative_sizes", "SELECT p_brand, n, sum(n) OVER (ORDER BY n, p_brand ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def w11(spark, d):
    n = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.withColumn("cum", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("n", "p_brand").rowsBetween(Window.unboundedPreceding, 0)))


@C.add("W12_first_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def w12(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("o_custkey", F.col("f.o_orderkey").alias("o_orderkey"))


@C.add("W13_argmax_row", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, round(max(o_totalprice), 6) AS top FROM orders GROUP BY 1")
def w13(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("o_orderkey"), F.round(F.max("o_totalprice"), 6).alias("top"))
