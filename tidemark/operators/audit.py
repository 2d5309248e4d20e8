"""Record audit: aliases, summaries of a download index, error groups, funnels and taxonomies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import falsy

# Older names of fields of a download record.
ALIASES = {"source_item_id": "glytoucan_id", "downloaded_at": "timestamp", "local_path": "file_path", "bytes": "file_size", "error": "failure_reason"}


def canonical(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Fields under their current names; a field that is null or empty takes its older name's value."""
    out = df
    for new, old in aliases.items():
        have = [F.col(c).cast("string") for c in (new, old) if c in df.columns]
        if have:
            out = out.withColumn(new, falsy(*have))
    return out.drop(*(o for o in aliases.values() if o in df.columns))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in `order`, by a partial aggregate."""
    rest = [c for c in df.columns if c not in (key, *order)]
    top = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("__t"))
    return top.select(key, *(F.col(f"__t.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def index_summary(df: DataFrame, source: str, status: str, size: str) -> DataFrame:
    """Totals by source and, with source null, over all."""
    count = lambda s: F.count_if(F.col(status) == s)
    return df.rollup(source).agg(F.count("*").alias("records"), F.sum(F.coalesce(F.col(size), F.lit(0.0))).alias("bytes"), count("ok").alias("ok"), count("failed").alias("failed"), count("skipped").alias("skipped"))


def top_errors(df: DataFrame, error: str, n: int = 10, width: int = 100) -> DataFrame:
    text = F.coalesce(error, F.lit("Unknown error"))
    short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return df.groupBy(short.alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row a stage: how many rows pass it, and their share of the first stage; one pass over the data."""
    one = df.agg(*(F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(stages)))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("n"), (F.col(f"s{i}") / F.nullif(F.col("s0"), F.lit(0))).alias("share")) for i, (name, _) in enumerate(stages)))).alias("r")
    return one.select(rows).select("r.*")


def taxonomy(df: DataFrame, reason: Column, key: str, examples: int = 5) -> DataFrame:
    """Rows by reason, their share, and the first keys of each; the examples are bounded before they are collected."""
    x = df.withColumn("reason", reason)
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy(key))).filter(F.col("r") <= examples)
    shown = first.groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", key))), lambda s: s[key].cast("string")), ",").alias("examples"))
    counts = x.groupBy("reason").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(shown, "reason").crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("t")).alias("share"), "examples")


# Words of an error message and the category each stands for, in order.
ERROR_RULES = [("timeout", "timeout"), ("404", "not_found"), ("403", "forbidden"), ("connection", "network"), ("parse", "parse"), ("memory", "resource"), ("unsupported", "unsupported")]


def classify(text: Column, rules: Sequence[tuple[str, str]] = ERROR_RULES, other: str = "unknown") -> Column:
    """Category of the first rule whose word the text holds, in any case."""
    low, out = F.lower(text), None
    for word, name in rules:
        out = F.when(low.contains(word), name) if out is None else out.when(low.contains(word), name)
    return out.otherwise(other)


def acquisition_route(done: Column, existing: Column, api: Column, library: Column, sequence: Column) -> Column:
    """The first route that is open, in the order of preference."""
    return F.when(done, "already_ok").when(existing, "existing").when(api, "api").when(library, "library").when(sequence, "generate").otherwise("none")


def download_policy(policy: str, size_mb: Column, total_mb: Column, limit_mb: float, confirm: bool = False) -> Column:
    """Whether a file may be fetched under a policy by its size and its project's size."""
    if policy == "metadata_only":
        return F.lit(False)
    if policy == "small_files_only":
        return F.coalesce(size_mb <= limit_mb, F.lit(False))
    return F.lit(True) if confirm else F.coalesce(total_mb <= limit_mb, F.lit(False))
