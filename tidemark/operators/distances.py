"""Ranks of all distances between queries and rows, made where the rows stream by.

Pairs are as many as queries x rows, and so is the result. They do not travel: a unit of work holds some queries, rows come to it in blocks,
and the distances stay where they are made until they are ordered, a query at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.counting import UNITS, array_at, by_unit, dealt, packed, scores, to_all
from tidemark.operators.resampling import dense_index

LOAD = 64_000_000  # distances of a unit, of eight bytes each, beyond which there are more units
BATCH = 65_536
NAMES = ["q", "id", "dist", "rank"]


def _sized(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, len, at, z) of rows (id, e): vectors that are null or hold nulls have length -1 and no components."""
    whole = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull())
    kind = dict(rows.dtypes)["e"]
    return rows.filter("id is not null").select(*keep, F.when(whole, F.size("e")).otherwise(-1).alias("len"), F.col("id").alias("at"), F.when(whole, F.col("e")).otherwise(F.array().cast(kind)).alias("z"))


def _order(far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions by (distance, id), numbers that are none last; only equal distances are ordered by id."""
    order = np.argsort(far)
    now = far[order]
    same = (now[1:] == now[:-1]) | (np.isnan(now[1:]) & np.isnan(now[:-1]))
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(now) else np.zeros(0, np.int64)
    some = order[tied]
    order[tied] = some[np.lexsort((ids[some], far[some]))]
    return order


class _Queries:
    """Queries of one unit, by length of their vectors, and the distances of the blocks met."""

    def __init__(self, digits: int) -> None:
        self.digits = digits
        self.asked: list[tuple[int, np.ndarray, np.ndarray, list]] = []

    def ask(self, length: int, ids: np.ndarray, v: np.ndarray) -> None:
        self.asked.append((length, ids, v.reshape(len(ids), -1).astype(float), []))

    def meet(self, length: int, ids: np.ndarray, v: np.ndarray) -> None:
        cols = np.ascontiguousarray(v.reshape(len(ids), -1).T, dtype=float)
        for own, at, e, met in self.asked:
            if own != length or own < 0:
                met.append((ids, None))
            elif own == 0:
                met.append((ids, np.zeros((len(at), len(ids)))))
            else:
                far = np.empty((len(at), len(ids)))
                for s in range(0, len(at), 4):
                    np.negative(scores(cols, e[s : s + 4], measure="distance"), out=far[s : s + 4])
                met.append((ids, far))

    def ranked(self) -> Iterator[pa.RecordBatch]:
        for q in np.unique(np.concatenate([at for _, at, _, _ in self.asked])).tolist():
            known, far, none = [], [], []
            for _, at, _, met in self.asked:
                for i in np.flatnonzero(at == q):
                    for ids, d in met:
                        keep = ids != q
                        (none if d is None else known).append(ids[keep])
                        if d is not None:
                            far.append(d[i][keep])
            ids, dist, last = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((np.int64, known), (float, far), (np.int64, none)))
            order = _order(dist, ids)
            at = np.append(ids[order], np.sort(last))
            value = np.append(dist[order], np.zeros(len(last))) / 1e9
            value = np.trunc(value * 10.0**self.digits + 0.5) / 10.0**self.digits
            unknown = np.arange(len(at)) >= len(order)
            for s in range(0, len(at), BATCH):
                e = min(len(at), s + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, q)), pa.array(at[s:e]), pa.array(value[s:e], mask=unknown[s:e], from_pandas=False), pa.array(np.arange(s + 1, e + 1))], names=NAMES)


def distance_ranks(rows: DataFrame, queries: DataFrame, units: int | None = None, block: int = 8192, digits: int = 9) -> DataFrame:
    """(q, id, dist, rank): Euclidean distances of each query (id, e) from all `rows` (id, e) of other ids, and their rank, from the least
    at nine digits, ties by id; `digits` of them are shown, rounded as DuckDB rounds doubles. Distances from vectors that are null, hold nulls or have another length are null and rank last.

    Rows travel once a unit, in their own type, and pairs not at all. A unit holds eight bytes a pair of its queries: there are 24 units, and
    more beyond 64 million pairs in a unit, so traffic grows with the rows until then. One query's distances are always in one unit.
    """
    index = dense_index(queries, "id")
    n, many = rows.count(), queries.count()
    units = units or max(1, min(many, max(UNITS, -(-many * n // LOAD))))
    dealt_out = queries.join(index, "id").withColumn("unit", F.pmod("index", F.lit(units)).cast("int"))
    asked = packed(_sized(dealt_out, "unit"), 1, "unit", "len").withColumn("tag", F.lit(0))
    blocks = packed(_sized(rows), max(1, -(-n // block)), "len")
    stream = dealt([asked, to_all(blocks, units, 1)], units).select("unit", "tag", "len", "at", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Queries(digits)
        for number, b, i in by_unit(batches):
            if number != now:
                if held.asked:
                    yield from held.ranked()
                now, held = number, _Queries(digits)
            put = held.ask if b.column("tag")[i].as_py() == 0 else held.meet
            put(b.column("len")[i].as_py(), array_at(b, "at", i), array_at(b, "v", i))
        if held.asked:
            yield from held.ranked()

    kind = dict(rows.dtypes)["id"]
    out = stream.mapInArrow(run, "q bigint, id bigint, dist double, rank bigint")
    return out.select(F.col("q").cast(kind).alias("q"), F.col("id").cast(kind).alias("id"), "dist", "rank")
