"""Bootstrap of groups by counts: rows are packed once by group and block, draws are made where the packed values lie.

A repeat of a group of n rows draws n of them with replacement. In a group of several blocks, a repeat first splits its n draws over the
blocks by a tree of binomial numbers whose seeds depend on (seed, repeat, group, node) only, so that each block finds its own share
from its own path; the shares are those of one multinomial draw. Inside a block, draws are hash numbers of (group, seed, repeat, draw).
What leaves a block is one sum for a repeat (or counts of drawn values, for medians of groups beyond a block), never a row a draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
RANGES = 256


def numbered(df: DataFrame, order: str, groups: Sequence[str]) -> DataFrame:
    """`df` with `at` (0..n-1 inside a group, in the order of (order mod RANGES, order)) and `n`: a hot group is RANGES windows."""
    x = df.withColumn("__r", F.pmod(F.col(order), F.lit(RANGES)).cast("int"))
    counts = x.groupBy(*groups, "__r").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*groups)
    before = counts.select(*groups, "__r", (F.sum("c").over(group.orderBy("__r")) - F.col("c")).alias("__b"), F.sum("c").over(group).alias("n"))
    inside = x.withColumn("__i", F.row_number().over(Window.partitionBy(*groups, "__r").orderBy(order)) - 1)
    return inside.join(before, [*groups, "__r"]).withColumn("at", F.col("__i") + F.col("__b")).drop("__r", "__i", "__b")


def hash_of(*parts: object) -> int:
    """The first 32 bits of the MD5 of the parts joined by bars."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def mixed32(x: np.ndarray) -> np.ndarray:
    """The finaliser of 32-bit murmur hashes, on unsigned 64-bit numbers below 2**32."""
    low = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return x ^ (x >> np.uint64(16))


def places(key: int, seed: int, reps: np.ndarray, first: int, count: int, n: int) -> np.ndarray:
    """For each repeat of a group, `count` places below `n`: draws `first` to `first + count - 1`."""
    low = np.uint64(0xFFFFFFFF)
    a = mixed32(np.uint64(key) ^ mixed32(np.uint64(seed * 100_000) + reps.astype(np.uint64)))
    h = mixed32((a + np.uint64(0x9E3779B9)) & low)
    draw = np.uint64(first & 0xFFFFFFFF) + np.arange(count, dtype=np.uint64)
    x = mixed32(mixed32((a[:, None] + draw[None, :]) & low) ^ h[:, None])
    return ((x * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def share_of(at: int, blocks: int, n: int, key: int, seed: int, rep: int, size: int = BLOCK) -> int:
    """How many of a repeat's `n` draws fall into block `at` of `blocks` (all of `size` rows but the last)."""
    low, high, left = 0, blocks, n
    while high - low > 1 and left:
        mid = (low + high) // 2
        rows = lambda a, b: min(b * size, n) - a * size
        rng = np.random.Generator(np.random.Philox(key=[(key << 32) ^ (seed * 100_000 + rep), (low << 32) | high]))
        lower = int(rng.binomial(left, rows(low, mid) / rows(low, high)))
        low, high, left = (low, mid, lower) if at < mid else (mid, high, left - lower)
    return left


def bootstrap(df: DataFrame, value: str, order: str, repeats: int, seed: int, groups: Sequence[str], median: bool = False, size: int = BLOCK) -> DataFrame:
    """(groups, rep, stat): the mean (or median) of each repeat of each group; null values are left out, `order` is an integer
    that tells rows of a group apart."""
    clean = df.filter(F.col(value).isNotNull()).select(*groups, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"))
    x = numbered(clean, "__o", groups)
    block = F.floor(F.col("at") / size).cast("int")
    packed = x.groupBy(*groups, block.alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "__v"))).alias("rows")).withColumn("v", F.col("rows.__v")).drop("rows")
    kinds = dict(df.dtypes)
    names = list(groups)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "rep int, total double, draws bigint, drawn double, whole boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                v = b.column("v")[i].values.to_numpy()
                n, at = b.column("n")[i].as_py(), b.column("block")[i].as_py()
                key = hash_of(*(b.column(c)[i].as_py() for c in names))
                blocks = -(-n // size)
                step = max(1, 2_000_000 // len(v))
                for s in range(0, repeats, step):
                    reps = np.arange(s, min(repeats, s + step))
                    share = np.full(len(reps), n) if blocks == 1 else np.array([share_of(at, blocks, n, key, seed, int(r), size) for r in reps])
                    to = places(key, seed, reps, at * size, int(share.max(initial=0)), len(v))
                    drawn = v[to]
                    if blocks > 1:
                        inside = np.arange(to.shape[1])[None, :] < share[:, None]
                    if median and blocks > 1:  # counts of drawn values go on
                        code = (np.arange(len(reps))[:, None] * len(v) + to)[inside]
                        code, count = np.unique(code, return_counts=True)
                        rep, j = np.divmod(code, len(v))
                        cols, which = (np.zeros(len(rep)), count, v[j], np.zeros(len(rep), bool)), reps[rep]
                    elif median:
                        cols, which = (np.median(drawn, axis=1), np.ones(len(reps), np.int64), np.zeros(len(reps)), np.ones(len(reps), bool)), reps
                    else:
                        total = drawn.sum(1) if blocks == 1 else np.where(inside, drawn, 0.0).sum(1)
                        cols, which = (total, share, np.zeros(len(reps)), np.zeros(len(reps), bool)), reps
                    keys = [pa.array([b.column(c)[i].as_py()] * len(which), b.column(c).type) for c in names]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(which, pa.int32()), pa.array(cols[0]), pa.array(cols[1].astype(np.int64)), pa.array(cols[2]), pa.array(cols[3])], names=[*names, "rep", "total", "draws", "drawn", "whole"])

    spread = packed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *groups, "block")
    parts = spread.mapInArrow(run, schema)
    if median:
        stat = F.coalesce(F.max(F.when(F.col("whole"), F.col("total"))), F.percentile("drawn", F.lit(0.5), F.col("draws")))
    else:
        stat = F.sum("total") / F.sum("draws")
    return parts.groupBy(*groups, "rep").agg(stat.alias("stat"))


def interval(drawn: DataFrame, groups: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(groups, mean, std, lo, hi, cv) over the repeats."""
    a = drawn.groupBy(*groups).agg(F.avg("stat").alias("mean"), F.stddev_pop("stat").alias("std"), F.percentile("stat", F.lit(low)).alias("lo"), F.percentile("stat", F.lit(high)).alias("hi"))
    return a.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0))


def size_bands(df: DataFrame, size: str, enough: int = 5) -> DataFrame:
    """(band, size, rows): the size classes that a class's band holds: itself where it has `enough` rows, else those within one too.

    Classes meet classes, not rows: a range self-join over distinct sizes.
    """
    classes = df.groupBy(F.col(size).cast("long").alias("size")).agg(F.count("*").alias("rows"))
    reach = F.when(F.col("rows") >= enough, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    wanted = classes.select(F.col("size").alias("band"), F.explode(reach).alias("step")).select("band", (F.col("band") + F.col("step")).alias("size"))
    return wanted.join(classes, "size").select("band", "size", "rows")


def band_bootstrap(df: DataFrame, key: str, size: str, cols: Sequence[str], repeats: int = 1000, seed: int = 42, enough: int = 5, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Stability of features among rows of similar size: (band, feature, n, mean, std, lo, hi, within_var) of each size class, and
    the feature's summary (feature, rows, mean_value, median_std, mean_std, cv).

    Bands of fewer than `least` rows have no draws: their rows' own values stand for the interval (null here), and no deviation.
    Every row of a size has its class's figures, so rows are joined to them, not resampled one by one.
    """
    long = df.select(key, F.col(size).cast("long").alias("size"), *(F.col(c).cast("double").alias(c) for c in cols)).unpivot([key, "size"], list(cols), "feature", "value").filter("value is not null")
    members = long.join(size_bands(df, size, enough).select("band", "size"), "size")
    width = members.groupBy("band", "feature").agg(F.count("*").alias("n"), F.var_pop("value").alias("within_var"))
    drawn = interval(bootstrap(members, "value", key, repeats, seed, ["band", "feature"]), ["band", "feature"]).drop("cv")
    real = F.col("n") >= least
    bands = width.join(drawn, ["band", "feature"])
    bands = bands.select("band", "feature", "n", *(F.when(real, F.col(c)).alias(c) for c in ("mean", "lo", "hi")), *(F.when(real, F.col(c)).otherwise(0.0).alias(c) for c in ("std", "within_var")))
    per_row = long.join(bands.select(F.col("band").alias("size"), "feature", "std"), ["size", "feature"])
    summary = per_row.groupBy("feature").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value"), F.median("std").alias("median_std"), F.avg("std").alias("mean_std"))
    return bands, summary.withColumn("cv", F.when(F.col("mean_value") != 0, F.col("mean_std") / F.abs("mean_value")).otherwise(0.0))
