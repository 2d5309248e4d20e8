"""Helpers that the corpus operators share.

Staging: `stage` cuts lineage by writing Parquet (zstd) below the folder that
`spark.checkpoint.dir` names, so that any executor can re-read it when another
is lost. A folder of our own is used only where that setting is missing, which
is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # of staged frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIR[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    return read


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made from them must be staged itself."""
    for df in staged:
        path = _PATHS.pop(df, None)
        if path:
            _STAGED[df.sparkSession.sparkContext.applicationId].remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove the tables that this process staged for the session's application; frames that read them are void then."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def free_column(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores put before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def buckets_for(rows: int, per_bucket: int, least: int = 12, most: int = 100_000) -> int:
    """A partition count that follows the input: `rows / per_bucket`, within bounds."""
    return int(max(least, min(most, -(-rows // max(1, per_bucket)))))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str, max_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `max_chars` bytes of text at most (one text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // max_chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array, lower: str = "utf8", split: str = "utf8") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and offsets: text i has words offsets[i]:offsets[i+1].

    Splitting and lower-casing run in Arrow; each distinct word of the batch is hashed once.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.utf8_lower(texts) if lower == "utf8" else pc.ascii_lower(texts)
    words = pc.utf8_split_whitespace(texts) if split == "utf8" else pc.ascii_split_whitespace(texts)
    words = words.filter(pc.is_valid(words))
    offsets = words.offsets.to_numpy()
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    keep = np.ones(len(hashes), bool)
    if len(flat):
        empty = digest("")
        keep = hashes != np.uint64(empty)
        if not keep.all():
            before = np.concatenate([[0], np.cumsum(keep)])
            hashes, offsets = hashes[keep], before[offsets]
    return hashes, offsets.astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words inside one text; a shorter text that is not empty has one run, of all its words."""
    count = np.diff(offsets)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    total = int(runs.sum())
    out_offsets = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    start = np.repeat(offsets[:-1] - out_offsets[:-1], runs) + np.arange(total)
    end = np.repeat(offsets[1:], runs)
    acc = np.full(total, 0x51ED270B0F0F0F0F, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = start + k
            inside = at < end
            word = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(k + 1))
            acc = mix64(acc * MIX + word)
    return acc, out_offsets


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """`df` with `key` as a new expression of the same value: a join on it shuffles both sides, so that Spark may split a
    hot key's partition, which it cannot where an aggregate below already has the join's partitioning."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def components(edges: DataFrame, spark: SparkSession, name: str, max_rounds: int = 60) -> DataFrame:
    """Smallest node that each node reaches, for undirected `edges` (u, v: long): rows (node, root).

    Large-star and small-star steps over staged tables: each round groups by node with
    partial minima, so a node with many edges is joined, never gathered. Nodes without edges
    and self-loops get no row. Only counts come to the driver.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, f"{name}-edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), f"{name}-large")
        least = dealt_anew(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = stage(new.filter("u <> v").distinct(), f"{name}-edges")
        # At the fixed point every node has one edge, to its root, and no root has an edge of its own.
        loose = new.groupBy("u").count().filter("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        discard(e, large)
        e = new
        if not loose:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
