"""Readers of result files of other runs: files that may be absent, with values whose types drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers that JSON does not know but writers emit; they count as null.
NOT_A_NUMBER = r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])"


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at `path`; only its name is looked up."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return False
        raise
    return True


def _document(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row of strings from a JSON document; keys with dots lead into nested objects."""
    text = spark.read.text(path, wholetext=True).filter("length(trim(value)) > 0").select(F.input_file_name().alias("f"), "value")
    one = text.agg(F.min_by(F.regexp_replace("value", NOT_A_NUMBER, "$1null"), "f").alias("value"))
    return one.select(*(F.get_json_object("value", "$." + k).alias(f"k{i}") for i, k in enumerate(keys)))


def _first_row(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row of strings from the first row of a CSV file with a header, nulls where it has no row or no such column."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    have = [F.col(f"`{k}`") if k in rows.columns else F.lit(None).cast("string") for k in keys]
    return rows.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(have))).alias("r")).limit(1).agg(F.first("r").alias("r")).select("r.*")


def results(spark: SparkSession, sources: Mapping[str, Sequence[str]], fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(source, file, *fields): one row for each source, read from the first of its files that exists.

    `fields` maps a column to its key in the files and its type. JSON files are one document each (keys with dots lead into
    nested objects); names that end with `.csv` are tables with a header, of which the first row counts. An absent file, a
    missing key, a broken document, an empty table, NaN and a value that is not of the type give nulls; numbers in
    quotes are numbers. A file or a folder of parts may stand at each path. The sources are few: one small plan each.
    """
    keys = [k for k, _ in fields.values()]
    out = None
    for source, paths in sources.items():
        path = next((p for p in paths if present(spark, p)), None)
        if path is None:
            row = spark.range(1).select(*(F.lit(None).cast("string").alias(f"k{i}") for i in range(len(keys))))
        else:
            row = (_first_row if path.rstrip("/").endswith(".csv") else _document)(spark, path, keys)
        typed = [F.expr(f"nullif(try_cast(trim(k{i}) AS {t}), try_cast('NaN' AS {t}))").alias(name) for i, (name, (_, t)) in enumerate(fields.items())]
        row = row.select(F.lit(source).alias("source"), F.lit(path).cast("string").alias("file"), *typed)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no sources")
    return out
