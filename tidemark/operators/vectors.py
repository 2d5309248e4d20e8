"""Standardisation and imputation of feature columns, wide or as arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, cols: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Population z-scores of `cols` (0 for a constant column). One aggregate row is broadcast."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"__s_{c}") for c in cols))
    z = {f"{prefix}{c}": F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c in cols}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns, *z)


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact medians in place of null and NaN; 0 where a column has no value."""
    clean = df.withColumns({c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in cols})
    mid = clean.agg(*(F.median(c).alias(f"__d_{c}") for c in cols))
    return clean.crossJoin(F.broadcast(mid)).withColumns({c: F.coalesce(c, f"__d_{c}", F.lit(0.0)) for c in cols}).select(*df.columns)


def long_form(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(keep…, j, x): one row for each component."""
    return df.select(*keep, F.posexplode(vector).alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def zscore_array(df: DataFrame, vector: str, out: str = "z") -> DataFrame:
    """`df` with a column of standardised arrays. The statistics are one row, broadcast."""
    per = long_form(df, vector).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = per.agg(F.sort_array(F.collect_list(F.struct("j", "m", "s"))).alias("__stats"))
    z = F.zip_with(vector, "__stats", lambda x, t: F.when(t["s"] == 0, 0.0).otherwise((x.cast("double") - t["m"]) / t["s"]))
    return df.crossJoin(F.broadcast(row)).withColumn(out, z).drop("__stats")


def mean_vector(df: DataFrame, vector: str, key: str, out: str = "prototype") -> DataFrame:
    """The mean of the vectors of each key."""
    per = long_form(df, vector, key).groupBy(key, "j").agg(F.avg("x").alias("m"))
    return per.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda t: t["m"]).alias(out))


def plane_fit(df: DataFrame, targets: Sequence[str], a: str, b: str) -> DataFrame:
    """One row with a struct (c0, ca, cb) for each target: the least-squares plane y ~ 1 + a + b.

    One pass gathers the moments; coefficients follow from them in a second projection.
    """
    moments = [F.var_pop(a).alias("saa"), F.var_pop(b).alias("sbb"), F.covar_pop(a, b).alias("sab"), F.avg(a).alias("ma"), F.avg(b).alias("mb")]
    for y in targets:
        moments += [F.covar_pop(a, y).alias(f"sa_{y}"), F.covar_pop(b, y).alias(f"sb_{y}"), F.avg(y).alias(f"m_{y}")]
    row = df.agg(*moments).withColumn("det", F.expr("saa * sbb - sab * sab"))
    for y in targets:
        row = row.withColumns({f"ca_{y}": F.expr(f"(sa_{y} * sbb - sb_{y} * sab) / det"), f"cb_{y}": F.expr(f"(sb_{y} * saa - sa_{y} * sab) / det")})
    return row.select(*(F.struct((F.col(f"m_{y}") - F.col(f"ca_{y}") * F.col("ma") - F.col(f"cb_{y}") * F.col("mb")).alias("c0"), F.col(f"ca_{y}").alias("ca"), F.col(f"cb_{y}").alias("cb")).alias(f"r_{y}") for y in targets))


def block_extremes(left: DataFrame, right: DataFrame, measure: str, block: int = 16_384, tile: int = 2048) -> DataFrame:
    """(id, group, value): for each row (id, e) of `left` the best value over the rows (group, e) of `right` in each group.

    `measure` is "cosine" (the greatest; 0 for zero vectors) or "distance" (the least Euclidean). Both sides are dealt into
    blocks by hash; each pair of blocks is a unit of work of bounded size, compared tile by tile, whose partial values are then
    aggregated. All pairs are compared, so work grows with the square of the rows; traffic is a row once a block of the other side.
    """
    blocks = lambda df: max(1, -(-df.count() // block))
    nl, nr = blocks(left), blocks(right)
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = left.select("id", "e", F.pmod(F.xxhash64("id"), F.lit(nl)).cast("int").alias("i"), spread(nr, "j"))
    b = right.select("group", "e", spread(nl, "i"), F.pmod(F.xxhash64("e"), F.lit(nr)).cast("int").alias("j"))
    kind, group = dict(left.dtypes)["id"], dict(right.dtypes)["group"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return pa.table({"id": x["id"].slice(0, 0), "group": y["group"].slice(0, 0), "value": pa.array([], pa.float64())})
        p, q = (t["e"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (x, y))
        codes = y["group"].combine_chunks().dictionary_encode()
        place = codes.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(place[order]) > 0))
        q, of = q[order], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        best = np.full((len(p), len(starts)), -np.inf if measure == "cosine" else np.inf)
        extreme = np.maximum if measure == "cosine" else np.minimum
        for i in range(0, len(p), tile):
            a = p[i : i + tile]
            for j in range(0, len(q), tile):
                b, mine = q[j : j + tile], of[j : j + tile]
                edge = np.flatnonzero(np.append(True, np.diff(mine) > 0))
                if measure == "cosine":
                    n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                    value = np.divide(a @ b.T, n, out=np.zeros(n.shape), where=n > 0)
                else:
                    value = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
                part = best[i : i + tile]
                part[:, mine[edge]] = extreme(part[:, mine[edge]], extreme.reduceat(value, edge, axis=1))
        if measure == "distance":
            best = np.sqrt(np.maximum(best, 0))
        ids = np.repeat(np.arange(len(p)), len(starts))
        return pa.table({"id": x["id"].combine_chunks().take(pa.array(ids)), "group": codes.dictionary.take(pa.array(np.tile(place[order][starts], len(p)))), "value": pa.array(best.reshape(-1))})

    part = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, f"id {kind}, group {group}, value double")
    return part.groupBy("id", "group").agg((F.max if measure == "cosine" else F.min)("value").alias("value"))
