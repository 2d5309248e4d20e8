"""Readers and writers of mirrored records: logs, manifests, registry exports and molecule files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.audit import canonical

LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "source_item_id", "item_type", "url", "local_path", "sha256", "bytes", "downloaded_at", "status", "error", "extra_json", "glytoucan_id", "timestamp", "file_path", "file_size", "failure_reason")])


def download_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a download log under current field names; blank lines are skipped, `bytes` is a number."""
    rows = spark.read.schema(LOG).json(path).filter(F.coalesce("source", "source_item_id", "glytoucan_id").isNotNull())
    return canonical(rows).withColumn("bytes", F.expr("try_cast(bytes AS bigint)"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; quoted values may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def write_manifest(df: DataFrame, path: str, first: Sequence[str]) -> None:
    """CSV with the columns of `first` in order, then all others by name."""
    have = [c for c in first if c in df.columns]
    df.select(*have, *sorted(c for c in df.columns if c not in have)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def bindings(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Rows of a registry's query result in JSON: one column a variable, null where it is not bound."""
    value = T.StructType([T.StructField("value", T.StringType())])
    row = T.StructType([T.StructField(n, value) for n in names])
    schema = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(row))]))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.col(f"b.{n}.value").alias(n) for n in names))


def molecule_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed-column molecule files: (mol, chain, res, seq, x, y, z). Lines of other kinds are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mol"), F.explode(F.split("value", "\r?\n")).alias("line"))
    at = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = files.filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    number = lambda c: F.try_to_number(c, F.lit("S99999.999")).cast("double")
    seq = F.expr("try_cast(trim(substring(line, 23, 4)) AS int)")
    return atoms.select("mol", at(22, 1).alias("chain"), F.concat_ws(":", at(22, 1), at(23, 4), at(18, 3)).alias("res"), seq.alias("seq"), *(number(at(a, 8)).alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z")))).filter("x is not null and y is not null and z is not null")


def usable_files(spark: SparkSession, folders: Sequence[str], least: int = 100) -> DataFrame:
    """(id, path, length, sha256): each id's file from the first folder that has one of at least `least` bytes."""
    found = None
    for i, folder in enumerate(folders):
        f = spark.read.format("binaryFile").load(folder).filter(F.col("length") >= least)
        f = f.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.lit(i).alias("place"), "path", "length", F.sha2("content", 256).alias("sha256"))
        found = f if found is None else found.unionByName(f)
    first = found.groupBy("id").agg(F.min(F.struct("place", "path", "length", "sha256")).alias("f"))
    return first.select("id", "f.path", "f.length", "f.sha256")
