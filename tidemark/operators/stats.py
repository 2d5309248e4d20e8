"""Non-parametric tests, effect sizes and multiple-testing corrections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


EXACT_ROWS = 2000  # above this size of the larger group, exact counts are left for the normal approximation


def rank_sum_p(u: float, n1: int, n2: int, sigma: float | None, ties: float, alternative: str, exact: bool = True) -> float | None:
    """p of U: exact where a group has at most 8 rows and no value is tied, else normal with ties and a continuity of one half."""
    if not n1 or not n2:
        return None
    top = max(u, n1 * n2 - u) if alternative == "two-sided" else u if alternative == "greater" else n1 * n2 - u
    k, m = sorted((n1, n2))
    if exact and k <= 8 and not ties and m <= EXACT_ROWS:
        ways = np.zeros((k + 1, k * m + 1))  # choices of j of the first ranks, by the sum of their excess over 1..j
        ways[0, 0] = 1
        for r in range(n1 + n2):
            for j in range(min(k, r + 1), 0, -1):
                gap = r - j + 1
                if gap <= k * m:
                    ways[j, gap:] += ways[j - 1, : k * m + 1 - gap]
        share = float(ways[k, math.ceil(top) :].sum() / ways[k].sum())
    elif not sigma:
        return 1.0
    else:
        share = normal_tail((top - n1 * n2 / 2 - 0.5) / sigma)
    return min(1.0, 2 * share if alternative == "two-sided" else share)


def signed_rank_p(w: float, n: int, sigma: float | None, ties: float, alternative: str, exact: bool = True) -> float | None:
    """p of W+: exact up to 50 differences without ties, else normal."""
    if not n:
        return None
    if exact and n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        low, high = float(ways[: int(w) + 1].sum() / 2.0**n), float(ways[int(w) :].sum() / 2.0**n)
    elif not sigma:
        return 1.0
    else:
        z = (w - n * (n + 1) / 4) / sigma
        low, high = normal_tail(-z), normal_tail(z)
    return low if alternative == "less" else high if alternative == "greater" else min(1.0, 2 * min(low, high))


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for i in range(400, 0, -1):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = step / (1 + value)
    return front / (1 + value)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation (of values or ranks) by Student's t with n - 2 degrees of freedom."""
    if r is None or math.isnan(r) or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_share((n - 2) / 2, 0.5, 1 - r * r)


def with_p(rows: DataFrame, p_of: Callable[[dict], float | None], needs: list[str], out: str = "p") -> DataFrame:
    """`rows` (one a test, so few) with a column for p, which SQL functions cannot express."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p_of(r) for r in b.select(needs).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def mann_whitney(df: DataFrame, value: str, first: str, groups: Sequence[str], alternative: str | None = None, exact: bool = True, times: str | None = None) -> DataFrame:
    """Per group: n1, n2, U of the rows where `first` holds, z (tie-corrected, continuity one half) and Cliff's delta.
    With an `alternative` (two-sided, greater, less), p as well; `exact` lets small groups without ties be counted out.
    A row counts as often as the column `times` tells, or once.

    Works on counts of distinct values, so one row a value reaches the window, not one a row.
    """
    times_of = F.col(times) if times else F.lit(1)
    counts = df.groupBy(*groups, value).agg(F.sum(F.when(F.col(first), times_of).otherwise(0)).alias("a"), F.sum(F.when(~F.col(first), times_of).otherwise(0)).alias("b"))
    before = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("t", F.col("a") + F.col("b")).withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2.0)
    sums = ranks.groupBy(*groups).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(sigma > 0, (u - n1 * n2 / 2 - F.signum(u - n1 * n2 / 2) * 0.5) / sigma)
    delta = F.when((n1 > 0) & (n2 > 0), 2 * u / (n1 * n2) - 1)
    out = sums.select(*groups, "n1", "n2", u.alias("u"), z.alias("z"), delta.alias("delta"), sigma.alias("sigma"), F.col("ties"))
    if alternative is None:
        return out.drop("sigma", "ties")
    return with_p(out, lambda r: rank_sum_p(r["u"], r["n1"], r["n2"], r["sigma"], r["ties"], alternative, exact), ["u", "n1", "n2", "sigma", "ties"]).drop("sigma", "ties")


def wilcoxon(df: DataFrame, diff: str, groups: Sequence[str], alternative: str | None = None, exact: bool = True) -> DataFrame:
    """Per group: non-zero differences, W+, W-, and z of W+ by the normal approximation, tie-corrected.
    With an `alternative` (two-sided, greater, less), p as well; `exact` lets small groups without ties be counted out."""
    d = df.filter(F.col(diff) != 0).groupBy(*groups, F.abs(diff).alias("m")).agg(F.sum((F.col(diff) > 0).cast("long")).alias("up"), F.sum((F.col(diff) < 0).cast("long")).alias("down"))
    before = Window.partitionBy(*groups).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    r = d.withColumn("t", F.col("up") + F.col("down")).withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2.0)
    s = r.groupBy(*groups).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("down") * F.col("rank")).alias("w_minus"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = s.select(*groups, "n", "w_plus", "w_minus", F.when(sigma > 0, (F.col("w_plus") - n * (n + 1) / 4) / sigma).alias("z"), sigma.alias("sigma"), "ties")
    if alternative is None:
        return out.drop("sigma", "ties")
    return with_p(out, lambda r: signed_rank_p(r["w_plus"], r["n"], r["sigma"], r["ties"], alternative, exact), ["w_plus", "n", "sigma", "ties"]).drop("sigma", "ties")


def placement(df: DataFrame, base: str, other: str, groups: Sequence[str]) -> DataFrame:
    """Per group, where a comparison of two methods is told: n pairs, percent of them improved by over 5 %, percent of gain of
    the mean, two-sided p of the signed ranks, and the decision by all three. Pairs with a null do not count; without a p
    (no pair differs) or a gain (mean of nought) the decision is BRIEF_MENTION.
    """
    x = df.filter(F.col(base).isNotNull() & F.col(other).isNotNull()).withColumn("__d", F.round(F.col(other) - F.col(base), 9))
    better = (F.round(F.col(other) - 1.05 * F.col(base), 9) > 0).cast("int")
    gain = 100 * (F.try_divide(F.avg(other), F.avg(base)) - 1)
    per = x.groupBy(*groups).agg(F.count("*").alias("n"), (100 * F.avg(better)).alias("pct_improved"), gain.alias("relative_gain"))
    p = wilcoxon(x, "__d", groups, "two-sided", exact=False).select(*groups, "p")
    met = lambda pct, rel, level: (F.round("pct_improved", 9) > pct) & (F.round("relative_gain", 9) > rel) & (F.col("p") < level)
    # The limits of the two rules.
    decision = F.when(met(30, 20, 0.01), "MAIN_TEXT").when(met(15, 10, 0.05), "SUPPLEMENTARY").otherwise("BRIEF_MENTION")
    return per.join(p, list(groups), "left").withColumn("decision", decision)


def spearman(df: DataFrame, a: str, b: str, groups: Sequence[str]) -> DataFrame:
    """Per group: n, rank correlation (ties averaged) and its two-sided p."""
    from tidemark.operators.ranking import average_rank

    ranks = df.select(*groups, average_rank(a, *groups).alias("a"), average_rank(b, *groups).alias("b"))
    rho = ranks.groupBy(*groups).agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho"))
    return with_p(rho, lambda r: correlation_p(r["rho"], r["n"]), ["rho", "n"])


def cohens_d(df: DataFrame, value: str, first: str, groups: Sequence[str]) -> DataFrame:
    """Difference of means over the pooled sample deviation; null below two rows a side or without deviation."""
    x, y = F.when(F.col(first), F.col(value)), F.when(~F.col(first), F.col(value))
    a = df.groupBy(*groups).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return a.select(*groups, F.when((F.col("n1") > 1) & (F.col("n2") > 1) & (pooled > 0), (F.col("m1") - F.col("m2")) / pooled).alias("d"))


def corrections(df: DataFrame, p: str, key: str, alpha: float = 0.05, groups: Sequence[str] = ()) -> DataFrame:
    """Holm's adjusted p, Holm by rank without a stop, Holm with a stop, and Benjamini-Hochberg flags."""
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    order = part.orderBy(p, key)
    x = df.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(part)})
    ok = F.col(p) <= alpha / (F.col("n") - F.col("k") + 1)
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("n") - F.col("k") + 1) * F.col(p)).over(up)))
    x = x.withColumn("holm_rank", ok).withColumn("holm_step", F.min(ok.cast("int")).over(up) == 1)
    # From the last row back: a frame that reaches to the end of its group is summed up anew for each row.
    down = part.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    bh = F.max((F.col(p) <= alpha * F.col("k") / F.col("n")).cast("int")).over(down) == 1
    return x.withColumn("bh", bh).drop("k", "n")


def empirical_p(null: DataFrame, observed: DataFrame, groups: Sequence[str], value: str, seen: str, greater: bool = True) -> DataFrame:
    """(1 + null values at least as extreme) / (1 + null values)."""
    hit = F.col(value) >= F.col(seen) if greater else F.col(value) <= F.col(seen)
    both = null.join(observed, list(groups)) if groups else null.crossJoin(F.broadcast(observed))
    return both.groupBy(*groups).agg(((1 + F.count_if(hit)) / (1 + F.count("*"))).alias("p"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Group sizes: groups, mean, largest, share of singletons, Herfindahl index, Gini coefficient, shares of the top 1, 5 and 10.

    The Gini sum runs over counts of equal sizes, of which there are few, not over groups.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("s"))
    per = sizes.groupBy("s").agg(F.count("*").alias("g"))
    w = Window.partitionBy(F.lit(1)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    r = per.withColumns({"lo": F.coalesce(F.sum("g").over(w), F.lit(0)), "hi": F.coalesce(F.sum("g").over(down), F.lit(0))})
    top = lambda k: F.sum(F.col("s") * F.greatest(F.lit(0), F.least(F.col("g"), F.lit(k) - F.col("hi"))))
    a = r.agg(
        F.sum("g").alias("n"), F.sum(F.col("s") * F.col("g")).alias("t"), F.max("s").alias("largest"), F.sum(F.when(F.col("s") == 1, F.col("g")).otherwise(0)).alias("ones"),
        F.sum(F.col("s").cast("double") * F.col("s") * F.col("g")).alias("sq"), F.sum(F.col("s") * (F.col("g") * F.col("lo") + F.col("g") * (F.col("g") + 1) / 2.0)).alias("ranked"),
        *(top(k).alias(f"top{k}") for k in (1, 5, 10)),
    )
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    return a.select(F.col("n").alias("groups"), (t / n).alias("mean_size"), "largest", (F.col("ones") / n).alias("singletons"), (F.col("sq") / (t * t)).alias("hhi"), (2 * F.col("ranked") / (n * t) - (n + 1) / n).alias("gini"), *((F.col(f"top{k}") / t).alias(f"top{k}_share") for k in (1, 5, 10)))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], margin: float = 0.0005) -> DataFrame:
    """One row with the exact quantiles q0, q1, … of `value` at `shares`, between neighbours in proportion; null without values.

    Approximate quantiles (off by a ten-thousandth of the rows at most) bound a band of `margin` on both sides of each share. Rows below a
    band are only counted and those above left out, so a thousandth of the distinct values is ordered, and no task holds them all.
    """
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-margin, margin)]
    known = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.percentile_approx(value, F.array(*map(F.lit, ends)), 10_000).alias("at")).first()
    n, at = known["n"], known["at"]
    if n * margin < 10:  # a band of few rows may lack a neighbour
        at = [known["lo"], known["hi"]] * len(shares)
    low = [(n - 1) * p // 1 if n else 0 for p in shares]
    part = [(n - 1) * p - x if n else 0.0 for p, x in zip(shares, low)]
    v = F.col(value)
    near = [F.when(v <= hi, F.struct(F.lit(i).alias("i"), F.when(v >= lo, v).alias("v"))) for i, (lo, hi) in enumerate(zip(at[::2], at[1::2]))]
    counts = df.select(F.explode(F.array(*near)).alias("x")).filter("x is not null").groupBy("x.i", "x.v").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("i").orderBy(F.asc_nulls_first("v"))))
    own = lambda i, x: F.min(F.when((F.col("i") == i) & (F.col("upto") > x), F.col("v")))
    found = upto.agg(*(own(i, x + k).alias(f"{name}{i}") for i, x in enumerate(low) for k, name in ((0, "a"), (1, "b"))))
    mid = [F.col(f"a{i}") if not w else F.col(f"a{i}") * (1 - w) + F.col(f"b{i}") * w for i, w in enumerate(part)]
    return found.select(*(m.alias(f"q{i}") for i, m in enumerate(mid)))
