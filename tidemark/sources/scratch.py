"""Folders for tables that a job writes and reads again, where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below `spark.checkpoint.dir`; a temporary folder of this machine only where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the scratch folder and read back: several readers share it, and a lost executor costs its own tasks only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
