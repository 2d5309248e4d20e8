"""Ablation and residualisation: prototype rankings under many subsets of columns, and paired statistics of their metrics.

All conditions share one table of standardised columns. A condition is a mask; a positive's rank under it counts the scores above,
so neither conditions nor agents multiply the candidates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, stats
from tidemark.operators.counting import positive_ranks
from tidemark.sources.scratch import staged

COMPARED = ["mrr_best", "recall_5", "recall_10", "ap"]


def condition_metrics(z: DataFrame, labels: DataFrame, conditions: Mapping[str, Sequence[str]], least: int = 2) -> DataFrame:
    """(condition, agent, metrics) of agents with at least `least` positives (id, agent), by cosine with the mean of the positives'
    rows over the condition's columns of `z` (id, columns). `z` is staged: positives and candidates are the very same numbers, which
    statistics summed up anew for each reader, in another order, would part."""
    # In the order of their first condition, so that a sum over a condition's columns runs in the condition's own order.
    every = list(dict.fromkeys(c for cols in conditions.values() for c in cols))
    base = staged(z.select("id", *every), "conditions")
    own = labels.select("id", "agent").distinct().join(base, "id")
    proto = own.groupBy("agent").agg(*(F.avg(c).alias(f"p_{c}") for c in every), F.count("*").alias("__n")).filter(F.col("__n") >= least)
    mask = lambda cols: F.array(*(F.lit(1.0 if c in cols else 0.0) for c in every))
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("condition"), mask(cols).alias("w")) for k, cols in conditions.items())))
    groups = proto.select("agent", F.array(*(f"p_{c}" for c in every)).alias("p"), made.alias("c")).select("c.condition", "agent", "p", "c.w")
    rows = base.select(F.col("id").alias("at"), F.array(*every).alias("z"))
    agents = labels.select("agent").distinct().count()
    positives = own.select("agent", F.col("id").alias("at"), F.array(*every).alias("z"))
    return positive_ranks(groups, positives, rows, ["agent"], base.count(), len(conditions) * agents, summed=True)


def block_conditions(blocks: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """All columns, all but each block's, and each block's alone."""
    every = [c for cols in blocks.values() for c in cols]
    return {"all": every} | {f"drop_{b}": [c for c in every if c not in cols] for b, cols in blocks.items()} | {f"only_{b}": list(cols) for b, cols in blocks.items()}


def paired_statistics(per: DataFrame, baseline: str = "all", least: int = 10, repeats: int = 1000, seed: int = 1, exact: bool = True, compared: Sequence[str] = COMPARED) -> DataFrame:
    """Each condition's metrics against the baseline's over the agents that have both: means, mean and median difference with a
    bootstrap interval of the median, Wilcoxon's signed-rank p (two-sided) and Holm's step-down flag among the conditions of a metric.
    Agents are integers. Conditions with fewer than `least` common agents are left out."""
    long = per.unpivot(["condition", "agent"], list(compared), "metric", "value").filter("value is not null")
    base = long.filter(F.col("condition") == baseline).select("agent", "metric", F.col("value").alias("base"))
    both = long.filter(F.col("condition") != baseline).join(base, ["agent", "metric"]).withColumn("delta", F.round(F.col("value") - F.col("base"), 9))
    keys = ["condition", "metric"]
    shape = both.groupBy(*keys).agg(F.count("*").alias("n_agents"), F.avg("base").alias("mean_all"), F.avg("value").alias("mean_cond"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta")).filter(F.col("n_agents") >= least)
    spread = bootstrap.interval(bootstrap.bootstrap(both, "delta", "agent", repeats, seed, keys, median=True), keys).select(*keys, F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    tested = stats.wilcoxon(both, "delta", keys, "two-sided", exact=exact)
    tested = tested.select(*keys, F.least("w_plus", "w_minus").alias("w"), "p")
    out = shape.join(spread, keys).join(tested, keys, "left")
    ordered = stats.corrections(out.withColumn("__p", F.round(F.coalesce("p", F.lit(1.0)), 12)), "__p", "condition", groups=["metric"])
    return ordered.select(*keys, "n_agents", "mean_all", "mean_cond", "mean_delta", "median_delta", "ci_low", "ci_high", "w", "p", F.col("holm_step").alias("sig_holm"))


def condition_deltas(per: DataFrame, of: str, against: Sequence[str], compared: Sequence[str] = COMPARED) -> DataFrame:
    """(agent, metric, val_…, delta_…): one condition's metrics less those of others, over the agents that have all of them."""
    long = per.unpivot(["condition", "agent"], list(compared), "metric", "value")
    wide = long.groupBy("agent", "metric").agg(*(F.max(F.when(F.col("condition") == c, F.col("value"))).alias(f"val_{c}") for c in (of, *against)), F.countDistinct(F.when(F.col("condition").isin(of, *against), F.col("condition"))).alias("__c"))
    return wide.filter(F.col("__c") == 1 + len(against)).drop("__c").withColumns({f"delta_{c}": F.col(f"val_{of}") - F.col(f"val_{c}") for c in against})
