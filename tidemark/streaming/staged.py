"""Staged runs over arriving item files: each item is fetched once, every attempt is logged once, and a killed run resumes.

Items arrive as JSON lines in a growing folder. A micro-batch leaves out what earlier batches fetched (an anti-join with their
manifest), processes the rest and writes its log, manifest and counts into folders that carry the batch's number. A batch that is
run again after a crash overwrites its own folders and reads only those of smaller numbers, so the tables are those of a run that
was never interrupted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "source string, source_item_id string, item_type string, url string, payload string, listed_at timestamp"
LOGGED = "source string, source_item_id string, item_type string, url string, status string, bytes bigint, sha256 string, error string"
KEY = ["source", "source_item_id"]


def stored(items: DataFrame, least: int = 1) -> DataFrame:
    """Items with status, bytes, SHA-256 and error of their payload: a missing or too short one fails."""
    size = F.octet_length("payload").cast("long")
    error = F.when(F.col("payload").isNull(), "not found").when(size < least, F.format_string("%d bytes, fewer than %d", size, F.lit(least)))
    kept = error.isNull()
    return items.select(
        *KEY, "item_type", "url", F.when(kept, "ok").otherwise("failed").alias("status"), F.when(kept, size).otherwise(F.lit(0).cast("long")).alias("bytes"), F.when(kept, F.sha2("payload", 256)).alias("sha256"), error.alias("error")
    )


def _before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """Rows of the batches before `batch`; none where there is no table yet."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(F.col("batch") < batch)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch bigint")


def run_batch(items: DataFrame, batch: int, out: str, sources: Sequence[str], process: Callable[[DataFrame], DataFrame], refused: Sequence[str] = ()) -> None:
    """One micro-batch of `run_stage`: `manifest/batch=N` holds what was fetched, `log/batch=N` all attempts, `stats/batch=N` counts."""
    spark = items.sparkSession
    own = items.filter(F.col("source").isin(list(sources)))
    # The item that was listed first stands for an id that a batch holds more than once.
    first = own.groupBy(*KEY).agg(F.min(F.struct("listed_at", "item_type", "url", "payload")).alias("i"), F.count("*").alias("seen")).select(*KEY, "i.*", "seen")
    done = _before(spark, f"{out}/manifest", batch, LOGGED)
    fresh = first.join(done.select(*KEY), KEY, "left_anti")
    allowed = ~F.col("source").isin(list(refused)) if refused else F.lit(True)
    made = process(fresh.filter(allowed).select(*items.columns))
    made.write.mode("overwrite").parquet(f"{out}/manifest-all/batch={batch}")
    made = spark.read.schema(LOGGED).parquet(f"{out}/manifest-all/batch={batch}")
    made.write.mode("overwrite").json(f"{out}/log/batch={batch}")
    counts = made.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("bytes").alias("bytes"))
    counts = first.groupBy("source").agg(F.count("*").alias("items")).join(counts, "source", "left").na.fill(0)
    counts.withColumn("skipped", F.col("items") - F.col("ok") - F.col("failed")).drop("items").write.mode("overwrite").parquet(f"{out}/stats/batch={batch}")
    # The manifest comes last: what it names is logged and counted.
    made.filter("status = 'ok'").write.mode("overwrite").parquet(f"{out}/manifest/batch={batch}")


def run_stage(spark: SparkSession, incoming: str, out: str, sources: Sequence[str], process: Callable[[DataFrame], DataFrame] = stored, refused: Sequence[str] = (), files: int = 10) -> None:
    """Process all files that wait in `incoming`, `files` a batch, then stop; the next call goes on where this one ended.

    Items of other sources are left alone; sources in `refused` (those that ask for a login) are counted as skipped.
    """
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files).json(incoming)
    write = stream.writeStream.foreachBatch(lambda items, batch: run_batch(items, batch, out, sources, process, refused))
    query = write.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def attempts(spark: SparkSession, out: str) -> DataFrame:
    """All logged attempts, with the number of their batch."""
    return spark.read.schema(f"{LOGGED}, batch bigint").json(f"{out}/log")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """What was fetched: one row an item."""
    return spark.read.schema(f"{LOGGED}, batch bigint").parquet(f"{out}/manifest")


def run_totals(spark: SparkSession, out: str) -> DataFrame:
    """(source, ok, failed, skipped, bytes) over all batches."""
    return spark.read.parquet(f"{out}/stats").groupBy("source").agg(*(F.sum(c).alias(c) for c in ("ok", "failed", "skipped", "bytes")))


def checksums(spark: SparkSession, out: str) -> DataFrame:
    """(source_item_id, sha256): the checksum file's content, the last batch's where an id was fetched by several sources."""
    return manifest(spark, out).groupBy("source_item_id").agg(F.max_by("sha256", F.struct("batch", "source")).alias("sha256"))
