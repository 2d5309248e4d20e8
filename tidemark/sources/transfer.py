"""Manifests of transfers between sources: members as a Parquet table, counts and metadata as one JSON row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("n_train_ids", "n_test_ids", "n_id_overlap", "n_train_agents", "n_test_agents", "n_agent_overlap")


def _counts(members: DataFrame) -> DataFrame:
    """One row of COUNTS."""
    both = F.col("in_train") & F.col("in_test")
    cols = [F.coalesce(F.count_if((F.col("kind") == kind) & c), F.lit(0)) for kind in ("id", "agent") for c in (F.col("in_train"), F.col("in_test"), both)]
    return members.agg(*(c.alias(n) for c, n in zip(cols, COUNTS)))


def save_transfer(sides: DataFrame, path: str, train: str, test: str, seed: int = 42, meta: Mapping[str, str] | None = None) -> None:
    """Write `sides` (id, agent, side) as a manifest at `path`.

    Members (kind, member, in_train, in_test) grow with the data, so they are a table, partitioned by kind; ids and agents are
    found in one shuffle of partial results, so a hot agent is one row a task. Null ids or agents are no members.
    """
    member = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("member")) for k in ("id", "agent"))))
    rows = sides.select(member.alias("m"), "side").select("m.*", "side").filter("member is not null")
    members = rows.groupBy("kind", "member").agg(*(F.coalesce(F.bool_or(F.col("side") == s), F.lit(False)).alias(f"in_{s}") for s in ("train", "test")))
    members.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/members")
    pairs = [F.lit(x) for kv in sorted((meta or {}).items()) for x in kv]
    row = _counts(_members(sides.sparkSession, path)).select(F.lit(train).alias("source_train"), F.lit(test).alias("source_test"), F.lit(seed).alias("seed"), *COUNTS, F.to_json(F.create_map(*pairs) if pairs else F.expr("map()")).alias("metadata"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("member string, in_train boolean, in_test boolean, kind string").parquet(f"{path}/members")


def load_transfer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, manifest); the manifest is a frame of one row. Members that do not agree with its counts are an error when they are read."""
    schema = ", ".join(["source_train string", "source_test string", "seed bigint", *(f"{n} bigint" for n in COUNTS), "metadata string"])
    manifest = spark.read.schema(schema).json(f"{path}/manifest").withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    have = _counts(_members(spark, path)).select(*(F.col(n).alias(f"__{n}") for n in COUNTS))
    same = F.lit(True)
    for n in COUNTS:
        same = same & F.col(n).eqNullSafe(F.col(f"__{n}"))
    checked = manifest.join(have, F.lit(True), "left")  # one row each
    checked = checked.withColumn("source_train", F.when(same, F.col("source_train")).otherwise(F.raise_error(F.lit(f"members and counts differ: {path}")).cast("string")))
    return _members(spark, path), checked.select(*manifest.columns)
