"""Class-balanced logistic regressions of all agents at once over shared rows.

Newton's method: a pass over the rows adds up the loss, gradient and Hessian of every agent's model, so its cost does not depend on
how a model's positives are spread, and only sums of agents x columns squared numbers reach the driver, `batch` agents at a time.
The models are those of the usual solvers: weights n / (2 n_class), half the squared norm of the coefficients as a penalty, none on
the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import staged


def _design(batch: pa.RecordBatch, agents: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a one at their end, and a matrix of 0 and 1: is the row a positive of the agent?"""
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
    own = batch.column("own")
    at = {a: i for i, a in enumerate(agents)}
    of = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy())) if batch.num_rows else np.zeros(0, np.int64)
    col = np.array([at.get(a, -1) for a in own.flatten().to_pylist()], np.int64)
    y = np.zeros((batch.num_rows, len(agents)))
    y[of[col >= 0], col[col >= 0]] = 1.0
    return np.hstack([x, np.ones((len(x), 1))]), y


def fit(rows: DataFrame, agents: list, positives: dict, n: int, dim: int, rounds: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients (agents, dim + 1), the intercept last, over `rows` (x, own: the agents that the row is a positive of)."""
    p = np.array([positives[a] for a in agents], float)
    up, down = n / (2 * p), n / (2 * np.maximum(n - p, 1))
    free = np.r_[np.ones(dim), 0.0]  # the penalty spares the intercept
    w, step, best, base = np.zeros((len(agents), dim + 1)), None, np.full(len(agents), np.inf), None
    for _ in range(rounds):
        now = w

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(agents), 1 + (dim + 1) + (dim + 1) ** 2))
            for b in batches:
                for s in range(0, b.num_rows, 4096):
                    x, y = _design(b.slice(s, 4096), agents)
                    m = x @ now.T
                    weight = np.where(y > 0, up, down)
                    q = 0.5 * (1 + np.tanh(m / 2))
                    total[:, 0] += (weight * (np.logaddexp(0, m) - y * m)).sum(0)
                    total[:, 1 : dim + 2] += (weight * (q - y)).T @ x
                    curve = weight * q * (1 - q)
                    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                    total[:, dim + 2 :] += curve.T @ outer
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(agents)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "t"])

        part = rows.mapInArrow(sums, "k int, t array<double>")
        width = 1 + (dim + 1) + (dim + 1) ** 2
        got = part.groupBy("k").agg(F.array(*(F.sum(F.col("t")[j]) for j in range(width))).alias("t")).collect()
        total = np.zeros((len(agents), width))
        for r in got:
            total[r["k"]] = r["t"]
        loss = total[:, 0] + 0.5 * (now[:, :dim] ** 2).sum(1)
        worse = loss > best + 1e-9 * np.abs(best)
        if step is not None and worse.any():  # half the step where it went too far
            step = np.where(worse[:, None], step / 2, 0.0)
            w = np.where(worse[:, None], base + step, now)
            continue
        best, base = loss, now
        slope = total[:, 1 : dim + 2] + now * free
        if np.abs(slope).max() <= tolerance * n:
            break
        curve = total[:, dim + 2 :].reshape(len(agents), dim + 1, dim + 1) + np.diag(free)
        step = -np.linalg.solve(curve + 1e-12 * np.eye(dim + 1), slope[:, :, None])[:, :, 0]
        w = base + step
    return base


def linear_scores(vectors: DataFrame, labels: DataFrame, batch: int = 200) -> DataFrame:
    """(agent, id, score): the probability by each agent's model, for every agent of `labels` (agent, id) and every row (id, x)."""
    own = labels.select("agent", "id").distinct().join(vectors.select("id"), "id", "left_semi")
    lists = own.groupBy("id").agg(F.collect_list("agent").alias("own"))
    kinds = dict(labels.dtypes)
    empty = F.array().cast(f"array<{kinds['agent']}>")
    rows = staged(vectors.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")).join(lists, "id", "left").withColumn("own", F.coalesce("own", empty)), "linear-rows")
    positives = {r["agent"]: r["n"] for r in own.groupBy("agent").agg(F.count("*").alias("n")).collect()}
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    models = []
    order = sorted(positives)
    for s in range(0, len(order), batch):
        some = order[s : s + batch]
        models.append((some, fit(rows.select("x", "own"), some, positives, size["n"], size["d"])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            for some, w in models:
                q = 0.5 * (1 + np.tanh((x @ w[:, :-1].T + w[:, -1]) / 2))
                ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), len(some))))
                yield pa.RecordBatch.from_arrays([pa.array(some * b.num_rows, agent_type), ids, pa.array(q.ravel())], names=["agent", "id", "score"])

    agent_type = labels.limit(0).select("agent").toArrow().schema.field("agent").type
    return rows.select("id", "x").mapInArrow(score, f"agent {kinds['agent']}, id {dict(vectors.dtypes)['id']}, score double")
