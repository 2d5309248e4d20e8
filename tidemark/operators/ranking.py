"""Positive-unlabelled ranking: prototypes, scores, ranks and metrics.

Ranks are exact at any size without one sort a group: scores are dealt into ranges, counts of the
ranges before give an offset, and windows run inside (group, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cosine, norm
from tidemark.operators.vectors import mean_vector, zscore_array
from tidemark.sources.scratch import staged


def _range(score: str, low: float, high: float, ranges: int) -> Column:
    part = F.floor((F.lit(high) - F.col(score)) / (high - low) * ranges).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(ranges), part))


def ranked(scored: DataFrame, groups: Sequence[str], score: str = "score", key: str = "id", positive: str = "positive", low: float = -1.0, high: float = 1.0, ranges: int = 256) -> DataFrame:
    """`scored` with rank (1 is the highest score, ties by key), n_above and tp_above (rows and positives at or above the
    score), and n_rows, the rows of the group.

    Counts and windows read one and the same exchange by (groups, range), so scores are made once.
    """
    x = scored.withColumn("__range", _range(score, low, high, ranges)).repartition(*groups, "__range")
    counts = x.groupBy(*groups, "__range").agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    group = Window.partitionBy(*groups)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("__p"), F.sum("n").over(group).alias("n_rows"))
    own = Window.partitionBy(*groups, "__range").orderBy(F.desc(score), key)
    ties = Window.partitionBy(*groups, "__range").orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    local = x.withColumns({"rank": F.row_number().over(own).cast("long"), "n_above": F.count("*").over(ties), "tp_above": F.sum(F.col(positive).cast("long")).over(ties)})
    out = local.join(offsets, [*groups, "__range"])
    return out.withColumns({"rank": F.col("rank") + F.col("__n"), "n_above": F.col("n_above") + F.col("__n"), "tp_above": F.col("tp_above") + F.col("__p")}).drop("__range", "__n", "__p")


def best_ranked(scored: DataFrame, groups: Sequence[str], wanted: Column, score: str = "score", key: str = "id", positive: str = "positive", low: float = -1.0, high: float = 1.0, ranges: int = 4096) -> DataFrame:
    """The first rows of `ranked`, with rank, p_before (positives ranked before the row) and n_pos (positives of the group).

    A group goes down to the range of scores that holds its first positive and `wanted` rows that are not positive (an expression that
    may use n_pos), or to its end. Ranks are exact, as all rows above are there. Ranges are counted first, and only rows of those
    ranges move, so `scored` is made twice and should be cheap to make.
    """
    x = scored.withColumn("__range", _range(score, low, high, ranges))
    counts = x.groupBy(*groups, "__range").agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    group = Window.partitionBy(*groups)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("__p"), F.sum("p").over(group).alias("n_pos"))
    needed = (F.col("__n") - F.col("__p") < wanted) | ((F.col("__p") == 0) & (F.col("n_pos") > 0))
    own = Window.partitionBy(*groups, "__range").orderBy(F.desc(score), key)
    first = F.coalesce(F.sum(F.col(positive).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = x.join(staged(offsets.filter(needed), "ranges"), [*groups, "__range"])
    out = kept.withColumns({"rank": F.row_number().over(own).cast("long"), "p_before": first})
    return out.withColumns({"rank": F.col("rank") + F.col("__n"), "p_before": F.col("p_before") + F.col("__p")}).drop("__range", "__n", "__p")


def metrics(rows: DataFrame, groups: Sequence[str], positive: str = "positive", ks: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Per group, from the rows of `ranked`: positives, best and mean reciprocal rank, recall at `ks`, mean and median rank,
    average precision (null if all rows are positive)."""
    per = rows.filter(F.col(positive)).groupBy(*groups).agg(
        F.count("*").alias("n_pos"),
        F.max("n_rows").alias("__n"),
        (1.0 / F.min("rank")).alias("mrr_best"),
        F.avg(1.0 / F.col("rank")).alias("mrr_mean"),
        *(F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks),
        F.avg(F.col("rank").cast("double")).alias("mean_rank"),
        F.median("rank").alias("median_rank"),
        F.avg(F.col("tp_above") / F.col("n_above")).alias("ap"),
    )
    return per.withColumn("ap", F.when(F.col("n_pos") < F.col("__n"), F.col("ap"))).drop("__n")


def prototype_scores(df: DataFrame, vector: str, key: str, agent: str, digits: int = 9) -> DataFrame:
    """(agent, id, score, positive): cosine of every row with the mean standardised vector of each agent's rows.

    Prototypes are one row an agent; agents are a small dimension, and their table is broadcast only by
    Spark's own size check.
    """
    z = zscore_array(df, vector).select(F.col(key).alias("id"), F.col(agent).alias("own"), "z")
    z = z.withColumn("nz", norm(F.col("z")))
    proto = mean_vector(z.filter("own is not null"), "z", "own").withColumnRenamed("own", "agent").withColumn("np", norm(F.col("prototype")))
    score = F.round(cosine(F.col("z"), F.col("prototype"), F.col("nz"), F.col("np")), digits)
    return z.crossJoin(proto).select("agent", "id", score.alias("score"), F.coalesce(F.col("own") == F.col("agent"), F.lit(False)).alias("positive"))


def macro(per_agent: DataFrame, cols: Sequence[str]) -> DataFrame:
    return per_agent.agg(F.count("*").alias("agents"), *(F.avg(c).alias(c) for c in cols))


def micro(per_agent: DataFrame, cols: Sequence[str], weight: str = "n_pos") -> DataFrame:
    return per_agent.agg(F.sum(weight).alias("weight"), *((F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in cols))


def leave_one_out(x: Column | str) -> tuple[Column, Column]:
    """Mean and sample deviation over a group's held-out values."""
    return F.avg(x), F.stddev_samp(x)


def average_rank(value: str, *groups: str) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*groups).orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2.0
