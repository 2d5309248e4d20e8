"""The corpus pipeline: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; the driver, and
`run`, write its rows as Parquet and read them again for the next. All but the last return the columns of
`documents`. No stage drops a row for another reason than its own decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, packing, quality, secrets
from tidemark.llm.common import stage, table

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled rows that are not held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.score(docs, model, out="__score").filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and `n_chars` as the new text has them."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable]] = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

# Classifier, shingle classes, lexer and packing are not expressible in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
