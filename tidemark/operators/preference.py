"""What the first rows of each agent's ranking have in common: means, effect sizes and permutation p by feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import resampling, stats


def preferences(z: DataFrame, scores: DataFrame, cols: Sequence[str], ks: Sequence[int] = (10, 20), min_pos: int = 2) -> DataFrame:
    """(agent, k, feature, score, delta, n_positives, n_candidates): mean of each of `cols` over the agent's first `k` rows, and Cliff's
    delta of those rows against the rest. `scores` holds (agent, id, score, positive) for each row of `z` (id, cols).

    Pairs of two first rows cancel out in the sum of signs, so delta follows from how many of all rows lie below and above a value,
    which is counted once for all agents. A `k` above the number of rows is left out; at that number delta is null.
    Agents with fewer than `min_pos` positives are left out.
    """
    long = z.select("id", *cols).unpivot("id", list(cols), "feature", "value").withColumn("value", F.round("value", 9))
    before = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    sizes = long.groupBy("feature", "value").agg(F.count("*").alias("t"))
    n = F.sum("t").over(Window.partitionBy("feature"))
    places = sizes.select("feature", "value", (2 * F.coalesce(F.sum("t").over(before), F.lit(0)) + F.col("t") - n).alias("balance"), n.alias("n_candidates"))
    order = Window.partitionBy("agent").orderBy(F.desc("score"), "id")
    first = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(ks)).select("agent", "id", "rank")
    top = first.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k").select("agent", "k", "id")
    known = scores.filter("positive").groupBy("agent").agg(F.count("*").alias("n_positives")).filter(F.col("n_positives") >= min_pos)
    met = top.join(known, "agent").join(long, "id").join(places, ["feature", "value"])
    per = met.groupBy("agent", "k", "feature", "n_positives", "n_candidates").agg(F.avg("value").alias("score"), F.sum("balance").alias("b"))
    rest = F.col("n_candidates") - F.col("k")
    return per.filter(rest >= 0).select("agent", "k", "feature", "score", F.when(rest > 0, F.col("b") / (F.col("k") * rest)).alias("delta"), "n_positives", "n_candidates")


def preference_tests(z: DataFrame, seen: DataFrame, cols: Sequence[str], ks: Sequence[int] = (10, 20), repeats: int = 10_000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """`seen`, of `preferences`, with p (two-sided, against `repeats` draws of k rows that all agents share), Holm's adjusted p and
    flags, and Benjamini-Hochberg flags over the features of an (agent, k)."""
    sizes = None
    for k in ks:
        null = resampling.top_k_null(z.select("id", *cols), list(cols), k, repeats, seed)
        one = null.groupBy("feature").agg(F.collect_list(F.abs("null")).alias("sizes")).withColumn("k", F.lit(k))  # `repeats` numbers a column
        sizes = one if sizes is None else sizes.unionByName(one)
    hits = F.size(F.filter("sizes", lambda v: v >= F.abs("score")))
    p = seen.join(F.broadcast(sizes), ["k", "feature"]).withColumn("p", (1 + hits) / (1 + F.size("sizes"))).drop("sizes")
    flagged = stats.corrections(p.withColumnRenamed("k", "first"), "p", "feature", alpha, ["agent", "first"])  # it has a `k` of its own
    return flagged.withColumnRenamed("first", "k").drop("holm_step")
