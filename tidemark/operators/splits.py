"""Train/test splits by hash order, by agent, by source and by greedy group folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iid_split(ids: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """(key, side): the first max(1, int(n * share)) ids in hash order are the test side.

    The order is found without one global sort: hash ranges are counted, the range that holds the border
    is found from their running sum, and only its ids are ordered.
    """
    x = ids.select(key).distinct().withColumn("__u", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    x = x.withColumn("__r", F.substring("__u", 1, 3))
    counts = x.groupBy("__r").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("__r")
    before = counts.select("__r", (F.sum("n").over(w) - F.col("n")).alias("__before"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy("__u", key)) + F.col("__before")
    take = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(test_share) + 1e-9).cast("long"))
    return x.join(before, "__r").select(key, F.when(rank <= take, "test").otherwise("train").alias("side"))


def agent_holdout(pairs: DataFrame, agent: str, test_share: float, min_pos: int, seed: int) -> DataFrame:
    """Sides of the agents with at least `min_pos` pairs."""
    return iid_split(pairs.groupBy(agent).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pos), agent, test_share, seed)


def dealt_runs(runs: Iterable[tuple[int, int]], folds: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(size, first, cycle) for each (size, count) in falling order of size: `count` groups of one size go, each in turn, to
    the lightest fold. Once loads lie within one size of each other, the order of folds repeats; `first` holds the steps before."""
    load = [0] * folds
    for size, count in runs:
        first = []
        while count > len(first) and max(load) - min(load) >= size:
            at = load.index(min(load))
            load[at] += size
            first.append(at)
        cycle = sorted(range(folds), key=lambda f: (load[f], f))
        rest, extra = divmod(count - len(first), folds)
        for place, f in enumerate(cycle):
            load[f] += size * (rest + (place < extra))
        yield size, first, cycle


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): groups by size, largest first (ties in hash order), each to the lightest fold (ties to the lower).

    Greedy balance is sequential over sizes only: groups of one size are a run whose folds repeat. So one task walks the
    distinct sizes, at most sqrt(2 x rows) of them, and groups find their fold by their number inside their size.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    x = sizes.withColumn("__u", F.xxhash64(group)).withColumn("__r", F.pmod("__u", F.lit(1024)))
    counts = x.groupBy("n", "__r").agg(F.count("*").alias("c"))
    before = counts.select("n", "__r", (F.sum("c").over(Window.partitionBy("n").orderBy("__r")) - F.col("c")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("n", "__r").orderBy("__u", group)) - 1 + F.col("__before")
    numbered = x.join(before, ["n", "__r"]).withColumn("__i", number)

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending")])
        rows = list(dealt_runs(zip(t["n"].to_pylist(), t["c"].to_pylist()), folds))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2))], names=["n", "__first", "__cycle"])

    runs = counts.groupBy("n").agg(F.sum("c").alias("c")).groupBy().applyInArrow(walk, "n bigint, __first array<int>, __cycle array<int>")
    ahead = F.size("__first")
    fold = F.when(F.col("__i") < ahead, F.get("__first", F.col("__i").cast("int"))).otherwise(F.get("__cycle", F.pmod(F.col("__i") - ahead, F.lit(folds)).cast("int")))
    return numbered.join(runs, "n").select(group, "n", fold.alias("fold"))


def tercile_key(size: Column, low: Column, high: Column) -> Column:
    return F.when(size <= low, "S").when(size <= high, "M").otherwise("L")


def cross_source(pairs: DataFrame, train: str, test: str, source: str = "data_source", min_pos: int = 2) -> DataFrame:
    """(id, agent, side): pairs of two sources; test pairs only of agents that the training side has `min_pos` ids for."""
    a = pairs.filter(F.col(source) == train).select("id", "agent").distinct()
    b = pairs.filter(F.col(source) == test).select("id", "agent").distinct()
    known = a.groupBy("agent").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pos)
    return a.withColumn("side", F.lit("train")).unionByName(b.join(known, "agent", "left_semi").select("id", "agent").withColumn("side", F.lit("test")))
