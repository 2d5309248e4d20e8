"""The feature job over molecule files: one pass over the files, then structure and contact features and coverage flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import structure
from tidemark.sources.molecules import read_molecules
from tidemark.sources.scratch import scratch

BOND, NEIGHBOUR, CONTACT = 2.0, 4.0, 4.5


def _bonded(points: DataFrame) -> DataFrame:
    """(mol, branch_proxy, terminal_proxy): residues bonded to three or more others, and to one; without bonds up to two ends."""
    e = structure.close_pairs(points, ["atom", "res"], BOND).filter("res <> res2").select("mol", "res", "res2").distinct()
    degree = e.groupBy("mol", "res").agg(F.count("*").alias("d"))
    n = points.groupBy("mol").agg(F.countDistinct("res").alias("n_residues"))
    x = n.join(degree, "mol", "left").groupBy("mol").agg(F.max("n_residues").alias("n_residues"), F.count_if(F.col("d") >= 3).alias("branch_proxy"), F.count("d").alias("c"), F.count_if(F.col("d") == 1).alias("t"))
    return x.select("mol", "n_residues", "branch_proxy", F.when(F.col("c") == 0, F.least(F.lit(2), F.col("n_residues"))).otherwise(F.col("t")).alias("terminal_proxy"))


def structure_features(points: DataFrame) -> DataFrame:
    """Size, shape, branching and exposure of each molecule's atoms (mol, atom, res, seq, x, y, z)."""
    x = structure.shape(points, "atom").join(_bonded(points), "mol").join(structure.exposure(points, "atom", NEIGHBOUR), "mol")
    return x.select("mol", "n_atoms", "n_residues", F.round("rg", 3).alias("radius_of_gyration"), F.round("max_d", 3).alias("max_pair_distance"), F.round("compactness", 4).alias("compactness"), "branch_proxy", "terminal_proxy", F.round("exposure", 3).alias("exposure_proxy"))


def contact_features(points: DataFrame) -> DataFrame:
    """Contact-graph figures, neighbour counts, diversity of distances and spectral gap of each molecule."""
    edges = structure.contacts(points, CONTACT)
    close = structure.close_pairs(points, ["atom", "res"], NEIGHBOUR).filter("res <> res2").groupBy("mol", "res").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    around = points.select("mol", "res").distinct().join(close, ["mol", "res"], "left").groupBy("mol").agg(F.round(F.avg(n), 3).alias("mean_residue_neighbor_count"), F.round(F.stddev_pop(n), 3).alias("sd_residue_neighbor_count"))
    figures = structure.graph_figures(edges, points).select(
        "mol", F.round("density", 4).alias("contact_density"), F.round("long_range", 4).alias("long_range_contact_fraction"), F.round("core", 4).alias("core_periphery_ratio"),
        F.col("max_gap").alias("max_contact_distance_seq"), F.col("n_res").alias("n_residues"), F.col("n_edges").alias("n_contacts"),
    )
    gap = structure.spectral_gap(edges).select("mol", F.round("gap", 4).alias("gap"))
    diversity = structure.torsion_diversity(points).select("mol", F.round("diversity", 4).alias("torsion_diversity"))
    x = figures.join(around, "mol").join(diversity, "mol").join(gap, "mol", "left")
    return x.withColumn("graph_laplacian_spectral_gap", F.coalesce("gap", F.lit(0.0))).drop("gap")


def coverage_flags(rows: DataFrame) -> DataFrame:
    """(mol, status, failure_reason, source_dir), one row a molecule that has a usable file."""
    per = rows.groupBy("mol", "source_dir").agg(F.max("failure_reason").alias("reason"))
    return per.select("mol", F.when(F.col("reason").isNull(), "OK").otherwise("FAILED").alias("status"), F.coalesce("reason", F.lit("")).alias("failure_reason"), "source_dir")


def feature_tables(spark: SparkSession, roots: list[str], least: int = 100, target: int = 16_000_000) -> dict[str, DataFrame]:
    """`ssv`, `gcv` and `coverage_flags` of the molecules below `roots`.

    Files are read once, into a table of atoms; features read its columns. A failed file costs only its own molecule.
    """
    path = scratch(spark, "atoms")
    read_molecules(spark, roots, least, target).write.parquet(path)
    rows = spark.read.parquet(path)
    points = rows.filter("failure_reason is null").select("mol", "atom", "res", "seq", "x", "y", "z")
    named = rows.filter("atom = 0").select("mol", "source_dir", "source_file")
    return {"ssv": structure_features(points).join(named, "mol"), "gcv": contact_features(points).join(named, "mol"), "coverage_flags": coverage_flags(rows)}


def run(spark: SparkSession, roots: list[str], out: str) -> None:
    """Write the three tables below `out` as CSV with headers."""
    for name, table in feature_tables(spark, roots).items():
        table.write.mode("overwrite").csv(f"{out}/{name}", header=True)
