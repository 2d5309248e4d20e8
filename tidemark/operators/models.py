"""Baseline rankers: linear, forest, multi-prototype, random, permutation, nearest and prototype models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _balanced(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Features as a vector, and weights n / (2 n_class)."""
    x = VectorAssembler(inputCols=list(cols), outputCol="__f").transform(df.withColumn("__y", F.col(label).cast("double")))
    n = x.agg(F.count("*").alias("n"), F.sum("__y").alias("p"))
    weight = F.col("n") / (2 * F.when(F.col("__y") == 1, F.col("p")).otherwise(F.col("n") - F.col("p")))
    return x.crossJoin(F.broadcast(n)).withColumn("__w", weight).drop("n", "p")


def _fitted(df: DataFrame, cols: Sequence[str], label: str, model: object, key: str) -> DataFrame:
    x = _balanced(df, cols, label)
    out = model.fit(x).transform(x)
    return out.select(key, vector_to_array("probability")[1].alias("score"))


def linear(df: DataFrame, cols: Sequence[str], label: str, key: str = "id", rounds: int = 100) -> DataFrame:
    """(key, score) of a class-balanced logistic regression with an L2 penalty."""
    n = df.count()
    return _fitted(df, cols, label, LogisticRegression(featuresCol="__f", labelCol="__y", weightCol="__w", maxIter=rounds, regParam=1.0 / max(n, 1)), key)


def forest(df: DataFrame, cols: Sequence[str], label: str, key: str = "id", trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """(key, score) of a class-balanced random forest."""
    return _fitted(df, cols, label, RandomForestClassifier(featuresCol="__f", labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed), key)


def multi_prototypes(df: DataFrame, vector: str, agent: str, k: int = 3, starts: int = 10, rounds: int = 50, batch: int = 500, seed: int = 42) -> DataFrame:
    """(agent, c, prototype): k means of each agent's vectors, the best of `starts`; one mean for an agent with fewer than k rows.

    Lloyd's rounds cover all rows: each is one pass whose partial sums are added up by (agent, start, centre), for `batch`
    agents at a time. Only centres come to the driver, at most batch x starts x k vectors. Starts are the first rows in
    hash order. Null vectors and agents are left out.
    """
    rows = df.filter(F.col(agent).isNotNull() & F.col(vector).isNotNull()).select(agent, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    kind = dict(df.dtypes)[agent]
    schema = f"{agent} {kind}, c int, prototype array<double>"
    parts, out = -(-rows.select(agent).distinct().count() // batch), None
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64(agent), F.lit(parts)) == part).persist()
        try:
            found = _lloyd(own, agent, kind, k, starts, rounds, seed)
        finally:
            own.unpersist()
        one = df.sparkSession.createDataFrame([(a, i, v.tolist()) for a, c in found.items() for i, v in enumerate(c)], schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def _lloyd(rows: DataFrame, agent: str, kind: str, k: int, starts: int, rounds: int, seed: int) -> dict[object, np.ndarray]:
    """The centres of each agent with the least sum of squares over all starts."""
    w = Window.partitionBy(agent, "s").orderBy(F.xxhash64(F.lit(seed), "s", "v"), "v")
    drawn = rows.distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    size = {r[agent]: r["n"] for r in rows.groupBy(agent).agg(F.count("*").alias("n")).collect()}
    first: dict = {}
    for r in drawn.orderBy(agent, "s", "r").collect():
        first.setdefault(r[agent], {}).setdefault(r["s"], []).append(r["v"])
    # Equal rows are one start only; where fewer than k differ, centres repeat and stay where they are.
    centres = {a: np.array([(c * k)[:k] for c in s.values()]) for a, s in first.items()}
    dim = len(next(iter(centres.values()))[0][0]) if centres else 0
    for turn in range(rounds + 1):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, agent_type = {}, None
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
                coded, agent_type = b.column(agent).dictionary_encode(), b.column(agent).type
                code = coded.indices.to_numpy()
                for i, a in enumerate(coded.dictionary.to_pylist()):
                    own, c = x[code == i], now[a]
                    for s in range(len(c)):
                        d = (own**2).sum(1)[:, None] - 2 * own @ c[s].T + (c[s] ** 2).sum(1)[None]
                        at = d.argmin(1)
                        hit = (at[:, None] == np.arange(k)[None]).astype(float)
                        add = np.hstack([hit.T @ own, hit.sum(0)[:, None], (hit * np.maximum(d, 0)).sum(0)[:, None]])
                        total[a, s] = total.get((a, s), 0) + add
            flat = [(a, s, i, row) for (a, s), t in total.items() for i, row in enumerate(t.tolist())]
            if flat:
                types = (agent_type, pa.int32(), pa.int32(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), types)], names=["a", "s", "i", "t"])

        part = rows.mapInArrow(sums, f"a {kind}, s int, i int, t array<double>")
        got = part.groupBy("a", "s", "i").agg(F.array(*(F.sum(F.col("t")[j]) for j in range(dim + 2))).alias("t")).collect()
        total = {a: np.zeros((len(c), k, dim + 2)) for a, c in now.items()}
        for r in got:
            total[r["a"]][r["s"], r["i"]] = r["t"]
        cost = {a: t[:, :, -1].sum(1) for a, t in total.items()}
        centres = {a: np.where(t[:, :, -2:-1] > 0, t[:, :, :-2] / np.maximum(t[:, :, -2:-1], 1), now[a]) for a, t in total.items()}
        moved = {a: ((centres[a] - c) ** 2).sum((1, 2)).max() for a, c in now.items()}
        if turn == rounds or all(m <= 1e-4 * cost[a].min() / (size[a] * dim) for a, m in moved.items()):
            break
    best = {a: centres[a][cost[a].argmin()] for a in centres}
    return {a: c if size[a] >= k else total[a][0, :, :-2].sum(0, keepdims=True) / size[a] for a, c in best.items()}


def agent_map(df: DataFrame, cols: Sequence[str], key: str, clusters: int = 5, seed: int = 42) -> DataFrame:
    """(key, x, y, cluster): two principal components of agent profiles and their k-means cluster."""
    v = VectorAssembler(inputCols=list(cols), outputCol="__f").transform(df)
    p = PCA(k=2, inputCol="__f", outputCol="__p").fit(v).transform(v)
    c = KMeans(k=clusters, featuresCol="__f", predictionCol="cluster", seed=seed).fit(v).transform(p)
    at = vector_to_array("__p")
    return c.select(key, at[0].alias("x"), at[1].alias("y"), "cluster")


REGISTRY: dict[str, Callable] = {"linear": linear, "random_forest": forest, "multi_prototype": multi_prototypes}


def get_model(name: str) -> Callable:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; available: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
