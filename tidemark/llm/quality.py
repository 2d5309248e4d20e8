"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are words and pairs of neighbouring words (lower-cased, hashed into `LEXICON` and `PAIRS` bins, so
that their number does not grow with the corpus), bigrams of character classes, trigrams of class runs,
and repeats of words, counted over the whole text; labels, language, source and ids are no inputs. A term-document matrix of a bounded sample of
labelled rows (`per_class` rows of each label, the only data that comes to the driver) is weighted by
tf-idf and reduced by a truncated singular value decomposition. The labelled latent vectors, at most
2 x `per_class` x `rank` numbers whatever the input, are broadcast. Every document is projected, its
cosines with all labelled vectors are computed exactly, block by block, and the labels of its nearest
neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_words, slices, table

# Character classes. Below MARK0 are kinds of characters, then one class for each ASCII mark.
LOWER, UPPER, DIGIT, BLANK, LINE, WORD, CONTROL, WIDE, MARK0 = range(9)
CLASSES = MARK0 + 33
RUN_TERMS = 4096
WORD_TERMS = 24
LEXICON, PAIRS = 1 << 12, 1 << 11  # bins by the upper 12 and 11 bits of a hash
TERMS = CLASSES * CLASSES + RUN_TERMS + WORD_TERMS + LEXICON + PAIRS
_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        found = np.full(0x110000, WIDE, np.uint16)
        for c in range(0x250):
            s = chr(c)
            found[c] = LOWER if s.islower() else UPPER if s.isupper() else DIGIT if s.isdigit() else LINE if s in "\n\r" else BLANK if s.isspace() else WORD if s.isalpha() else CONTROL
        marks = [c for c in range(33, 127) if not chr(c).isalnum()]
        found[marks] = MARK0 + np.arange(len(marks))
        _TABLE.append(found)
    return _TABLE[0]


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of terms, one row a text."""
    n = len(texts)
    length = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), length)
    c = class_table()[points].astype(np.int32)
    out = np.zeros((n, TERMS), np.float32)
    same = doc[1:] == doc[:-1]
    if len(c) > 1:
        pair = (c[:-1] * CLASSES + c[1:])[same]
        out[:, : CLASSES**2] = np.bincount(doc[1:][same].astype(np.int64) * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1)
        first = np.append(True, (c[1:] != c[:-1]) | ~same)
        r, d = c[first], doc[first]
        if len(r) > 2:
            inside = d[2:] == d[:-2]
            r = r.astype(np.int64)
            triple = (((r[:-2] * 1009 + r[1:-1]) * 1009 + r[2:]) * 2654435761 >> 7) % RUN_TERMS
            out[:, CLASSES**2 : CLASSES**2 + RUN_TERMS] = np.bincount(d[2:][inside].astype(np.int64) * RUN_TERMS + triple[inside], minlength=n * RUN_TERMS).reshape(n, -1)
    words, offsets = hashed_words(pa.array(texts, pa.string()))
    count = np.diff(offsets)
    owner = np.repeat(np.arange(n), count)
    base = CLASSES**2 + RUN_TERMS
    for lag in (1, 2, 3):
        if len(words) > lag:
            again = (words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])
            out[:, base + lag] = np.bincount(owner[lag:][again], minlength=n)
    # Share of distinct words, as one of ten terms that weighs like the text's words.
    key = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (words >> np.uint64(20))) >> np.uint64(44)
    distinct = np.bincount(key.astype(np.int64), minlength=n)
    share = np.where(count > 0, distinct / np.maximum(count, 1), 0)
    has = count > 0
    out[np.arange(n)[has], base + 8 + np.minimum((share[has] * 10).astype(int), 10)] = count[has]
    # The words themselves and pairs of neighbours, by the upper bits of their hashes.
    base += WORD_TERMS
    bin_ = (words >> np.uint64(52)).astype(np.int64)
    out[:, base : base + LEXICON] = np.bincount(owner * LEXICON + bin_, minlength=n * LEXICON).reshape(n, -1)
    if len(words) > 1:
        inside = owner[1:] == owner[:-1]
        with np.errstate(over="ignore"):
            both = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(53)
        out[:, base + LEXICON :] = np.bincount(owner[1:][inside] * PAIRS + both[inside].astype(np.int64), minlength=n * PAIRS).reshape(n, -1)
    return out


@dataclass
class Model:
    terms: np.ndarray  # which terms are used
    idf: np.ndarray
    axes: np.ndarray  # [terms, rank]
    vectors: np.ndarray  # unit latent vectors of labelled rows
    labels: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = counts[:, self.terms]
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
        np.sqrt(x, out=x)
        x *= self.idf
        return x

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self.unit(self.weigh(counts))

    def unit(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; the prior for a text without terms."""
        z = self.latent(counts)
        k = min(neighbours, len(self.labels))
        out = np.full(len(z), self.prior)
        if not k:
            return out
        for at in range(0, len(z), 1024):
            cosine = z[at : at + 1024] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[at : at + 1024] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_matrix(counts: np.ndarray, labels: np.ndarray, prior: float, rank: int, seed: int = 11) -> Model:
    """Latent space of labelled rows by a randomised truncated decomposition with power steps."""
    df = (counts > 0).sum(axis=0)
    terms = np.flatnonzero(df >= 2)
    idf = np.log((1 + len(counts)) / (1 + df[terms])) + 0.3
    model = Model(terms, idf.astype(np.float32), np.zeros((len(terms), 0), np.float32), np.zeros((0, 0)), labels.astype(np.float64), prior)
    if not len(terms) or not len(counts):
        return Model(terms, idf.astype(np.float32), np.zeros((len(terms), 1), np.float32), np.zeros((0, 1), np.float32), labels[:0].astype(np.float64), prior)
    x = model.weigh(counts)
    k = min(rank, *x.shape)
    q = np.random.default_rng(seed).normal(size=(x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = q @ np.linalg.svd(x @ q, full_matrices=False)[2][:k].T
    model.axes = axes.astype(np.float32)
    model.vectors = model.unit(x)
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = 2000, rank: int = 48) -> Model:
    """Fit on at most `per_class` rows of each label, chosen by a hash of the id; null labels and ids are left out."""
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    first = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
    chosen = first(0).unionByName(first(1))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            counts = term_counts([t or "" for t in b.column("text").to_pylist()])
            at = [np.flatnonzero(r) for r in counts]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(counts, at)], pa.list_(pa.float32()))], names=["id", "label", "at", "n"])

    # One row an id, so at most 2 x `per_class` rows of sparse counts reach the driver, as Arrow.
    found = rows.mapInArrow(run, "id long, label int, at array<int>, n array<float>")
    got = found.groupBy("id").agg(F.min(F.struct("at", "n", "label")).alias("r")).select("id", "r.*").toArrow().sort_by("id").combine_chunks()
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    for i, (at, n) in enumerate(zip(got["at"].combine_chunks(), got["n"].combine_chunks())):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    return fit_matrix(counts, got["label"].to_numpy().astype(np.float64), 0.5 if share is None else float(share), rank)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", neighbours: int = 15, power: float = 8.0) -> DataFrame:
    """`docs` with a column `out` from 0 to 1 (higher: label 1 likelier), computed over whole texts.

    A map without a shuffle. Null and empty texts get the share of label 1 among all labels. A column
    named `out` is replaced; others stay; repeated rows get equal scores; an empty table stays empty.
    """
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1_000_000):
            texts = [t or "" for t in b.column(text).to_pylist()]
            parts = [held.value.score(term_counts(texts[i : i + 512]), neighbours, power) for i in range(0, len(texts), 512)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts), pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the query and of the pipeline: labelled rows that are not held out, over all documents."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return fit(table(spark, sf_dir, "documents"), labels)


THRESHOLD = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op2_quality": op2_quality}
