"""Point-set kernels: size, shape, contacts and graph figures of molecules given as atoms (mol, res, seq, x, y, z).

Distances come from a cell grid: a point meets its own cell and the neighbouring ones, so work grows with the
number of pairs inside the cutoff, not with the square of the atoms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR = "(x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)"


def close_pairs(points: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Ordered pairs (mol, a…, b…, d2) of points of one molecule closer than `cutoff`; `keys` tell points apart."""
    cell = {f"c{a}": F.floor(F.col(a) / cutoff) for a in "xyz"}
    home = points.withColumns(cell)
    near = points.select("mol", *(F.col(k).alias(f"{k}2") for k in keys), *(F.col(a).alias(f"{a}2") for a in "xyz"))
    for a in "xyz":
        own = F.floor(F.col(f"{a}2") / cutoff)
        near = near.withColumn(f"c{a}", F.explode(F.array(own - 1, own, own + 1)))
    # Spark takes the exploded side to be as small as its source and would broadcast it.
    both = home.join(near.hint("merge"), ["mol", "cx", "cy", "cz"]).withColumn("d2", F.expr(FAR))
    return both.filter((F.col("d2") < cutoff * cutoff) & (F.col(keys[0]) != F.col(f"{keys[0]}2"))).select("mol", *keys, *(f"{k}2" for k in keys), "d2")


def shape(points: DataFrame, atom: str) -> DataFrame:
    """n_atoms, radius of gyration, greatest pair distance (exact) and compactness of each molecule."""
    size = points.groupBy("mol").agg(F.count("*").alias("n_atoms"), F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"))
    o = points.select("mol", F.col(atom).alias("a2"), *(F.col(a).alias(f"{a}2") for a in "xyz"))
    far = points.join(o, "mol").filter(F.col(atom) < F.col("a2")).groupBy("mol").agg(F.sqrt(F.max(F.expr(FAR))).alias("max_d"))
    x = size.join(far, "mol", "left").withColumn("max_d", F.coalesce("max_d", F.lit(0.0)))
    return x.withColumn("compactness", F.when(F.col("max_d") > 0, F.col("rg") / F.col("max_d")).otherwise(0.0))


def exposure(points: DataFrame, atom: str, cutoff: float) -> DataFrame:
    """Mean number of other points strictly nearer than `cutoff` and not at the same place."""
    n = close_pairs(points, [atom], cutoff).filter("d2 > 0").groupBy("mol", atom).agg(F.count("*").alias("n"))
    return points.select("mol", atom).join(n, ["mol", atom], "left").groupBy("mol").agg(F.avg(F.coalesce("n", F.lit(0))).alias("exposure"))


def centres(points: DataFrame) -> DataFrame:
    return points.groupBy("mol", "res", "seq").agg(*(F.avg(a).alias(a) for a in "xyz"))


def contacts(points: DataFrame, cutoff: float) -> DataFrame:
    """Edges (mol, u, v, gap), u < v, of residues whose centres are nearer than `cutoff`."""
    e = close_pairs(centres(points), ["res", "seq"], cutoff).filter("res < res2")
    return e.select("mol", F.col("res").alias("u"), F.col("res2").alias("v"), F.abs(F.col("seq") - F.col("seq2")).alias("gap"))


def graph_figures(edges: DataFrame, residues: DataFrame) -> DataFrame:
    """Density, share of long-range contacts, greatest gap, and core share of each molecule's contact graph."""
    n = residues.groupBy("mol").agg(F.countDistinct("res").alias("n_res"))
    e = edges.groupBy("mol").agg(F.count("*").alias("n_edges"), F.avg((F.col("gap") >= 3).cast("int")).alias("long_range"), F.max("gap").alias("max_gap"))
    d = degrees(edges)
    m = d.groupBy("mol").agg(F.avg("deg").alias("mu"), F.stddev_pop("deg").alias("sd"))
    core = d.join(m, "mol").groupBy("mol").agg(F.sum((F.col("deg") >= F.col("mu") + 0.5 * F.col("sd")).cast("int")).alias("c"), F.sum((F.col("deg") <= F.col("mu") - 0.5 * F.col("sd")).cast("int")).alias("p"), F.max("sd").alias("sd"))
    core = core.select("mol", F.when((F.col("sd") == 0) | (F.col("c") + F.col("p") == 0), 0.5).otherwise(F.col("c") / (F.col("c") + F.col("p"))).alias("core"))
    x = n.join(e, "mol", "left").join(core, "mol", "left")
    zero = F.lit(0)
    return x.select("mol", "n_res", F.coalesce("n_edges", zero).alias("n_edges"), (F.coalesce("n_edges", zero) / F.col("n_res")).alias("density"), F.coalesce("long_range", F.lit(0.0)).alias("long_range"), F.coalesce("max_gap", zero).alias("max_gap"), F.coalesce("core", F.lit(0.5)).alias("core"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select("mol", F.explode(F.array("u", "v")).alias("node"))
    return both.groupBy("mol", "node").agg(F.count("*").alias("deg"))


def spectral_gap(edges: DataFrame) -> DataFrame:
    """Second-least eigenvalue of each contact graph's Laplacian, over nodes with a contact; 0 below two nodes.

    Eigenvalues have no SQL form; one molecule's edges are a small group, solved in Arrow batches.
    """

    def solve(t: pa.Table) -> pa.Table:
        u, v = t["u"].to_numpy(), t["v"].to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        n, e = len(nodes), len(u)
        a = np.zeros((n, n))
        a[at[:e], at[e:]] = a[at[e:], at[:e]] = 1
        value = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1] if n > 1 else 0.0
        return pa.table({"mol": t["mol"].slice(0, 1), "gap": pa.array([float(value)])})

    kind = dict(edges.dtypes)["mol"]
    return edges.select("mol", "u", "v").groupBy("mol").applyInArrow(solve, f"mol {kind}, gap double")


def torsion_diversity(points: DataFrame) -> DataFrame:
    """Deviation over mean of all pair distances of residue centres; 0 below two centres."""
    c = centres(points)
    o = c.select("mol", F.col("res").alias("res2"), *(F.col(a).alias(f"{a}2") for a in "xyz"))
    d = c.join(o, "mol").filter("res < res2").select("mol", F.sqrt(F.expr(FAR)).alias("d"))
    return c.select("mol").distinct().join(d.groupBy("mol").agg((F.stddev_pop("d") / F.avg("d")).alias("t")), "mol", "left").select("mol", F.coalesce("t", F.lit(0.0)).alias("diversity"))
