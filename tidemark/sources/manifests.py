"""Split and sensitivity manifests as one JSON document beside Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_split(sides: DataFrame, key: str, path: str, meta: Mapping[str, str]) -> None:
    """Sides as a table partitioned by side (id lists grow with the data) and one JSON row of counts and metadata."""
    sides.select(key, "side").write.mode("overwrite").partitionBy("side").parquet(f"{path}/sides")
    counts = sides.groupBy("side").agg(F.count("*").alias("n"))
    row = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "n")))).alias("counts"))
    row.withColumn("metadata", F.create_map(*(F.lit(x) for kv in sorted(meta.items()) for x in kv)) if meta else F.lit(None)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = spark.read.json(f"{path}/manifest").first().asDict(recursive=True)
    return spark.read.parquet(f"{path}/sides"), meta


def validate_split(sides: DataFrame, key: str, may_overlap: bool = False) -> dict[str, object]:
    """Whether both sides have ids and, unless they may, share none."""
    per = sides.groupBy(key).agg(F.max((F.col("side") == "train").cast("int")).alias("a"), F.max((F.col("side") == "test").cast("int")).alias("b"))
    r = per.agg(F.sum("a").alias("train"), F.sum("b").alias("test"), F.sum(F.col("a") * F.col("b")).alias("shared")).first()
    train, test, shared = (int(x or 0) for x in r)
    return {"train": train, "test": test, "shared": shared, "valid": train > 0 and test > 0 and (may_overlap or not shared)}


def save_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each frame as CSV with a header and as Parquet, which readers prefer."""
    for name, df in tables.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
        flat.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
