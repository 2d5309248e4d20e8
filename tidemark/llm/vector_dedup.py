"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more have a squared distance of at most D = 2 - 2c. A rotation along the
principal axes of a bounded sample, which leaves distances alone, comes before a split into `parts`
blocks of axes. If budgets add up to D, one block of a close pair stays within its own budget; budgets
are in proportion to each block's share of the variance. So each block is a range join in few
dimensions: a grid over the block's first two axes, with cells as wide as the block's radius, brings
together all pairs within it (a point meets its own cell and, once, each neighbour). In each unit of
work block distances filter the pairs, a pair counts only in the first block whose budget it keeps,
and its cosine is then computed in double precision from the original vectors.

Rows come to units of work by label, cut into blocks of rows that meet pair by pair, and the grids of all
blocks of axes are laid inside a unit: a vector travels once for each block of rows of its label. Where that
is more often than the places a vector has in the grids, rows may come by cells instead (crowded
cells cut in the same way), if the label's cells then send fewer rows. Equal vectors of one label are one node from
the start. Pairs stay where they are found, tile by tile; counts and a spanning forest are the output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table
from tidemark.llm.jaccard_join import classes, forest, numbered, runs, unit_keys

TILE = 1024  # rows of either side that are compared at a time


def clean_vectors(rows: DataFrame, vector: str) -> F.Column:
    """Whether a vector can take part: not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & usable & F.exists(v, lambda x: x != 0), F.lit(False))


def numbers(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """[n, dim] doubles from a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def rotation(nodes: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of unit vectors (one an axis), dealt over the blocks later, and the variance along each.

    Fitted on at most `sample` vectors, taken by the order of a hash of their node. The fit only
    places borders; results do not depend on it.
    """
    got = nodes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    x = np.array([r["vector"] for r in got], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)) if len(x) > 1 else np.eye(x.shape[1]))
    return axes.T[::-1], np.maximum(values[::-1], 1e-9)


def vector_dedup(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", threshold: float = 0.93, parts: int = 4, block: int = 16_384, sample: int = 2000) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    Two rows link if their labels are equal and not null and their cosine, in double precision, is
    `threshold` or more. Vectors that are null, zero, or hold null or non-finite components link
    with nothing, nor do rows of another dimension than the common one of their label pair.
    Equal vectors count each. Rows without an id get component_id null and kept false. An empty
    table gives an empty table; other columns are not read. All links of all pairs are found.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("label", F.when(clean_vectors(rows, "vector") & F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("label")))
    used = rows.filter("label is not null")
    nodes, apart = numbered(used.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("w")), "vectors")
    sizes = [r[0] for r in nodes.groupBy(F.size("vector")).count().select(F.col("size(vector)")).collect()]
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "u long, v long, w long")
    found = empty
    for dim in sizes:
        own = nodes.filter(F.size("vector") == dim)
        found = found.unionByName(links(own, dim, threshold, min(parts, dim), block, sample))
    keyed = rows.withColumnRenamed("label", "k1").select("id", "k1", "vector")
    out = classes(found, nodes.withColumnRenamed("label", "k1"), keyed, ["k1", "vector"], "vectors", apart)
    return out.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def links(nodes: DataFrame, dim: int, threshold: float, parts: int, block: int, sample: int) -> DataFrame:
    axes, variance = rotation(nodes, sample)
    dealt = [list(range(p, dim, parts)) for p in range(parts)]
    distance = 2 - 2 * threshold + 1e-9
    budget = np.array([distance * variance[d].sum() / variance.sum() for d in dealt])
    side = np.sqrt(budget) * (1 + 1e-9)
    turned = np.concatenate([axes[d] for d in dealt])
    edges = np.cumsum([0, *map(len, dealt)])
    labels = dict(nodes.dtypes)["label"]
    block = min(block, max(2048, 2**20 // dim))  # a unit holds the vectors of two blocks

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = numbers(b.column("vector"), dim)
            y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turned.T
            every = np.arange(len(x))
            for p in range(parts):
                cx = np.floor(y[:, edges[p]] / side[p]).astype(np.int64)
                cy = np.floor(y[:, edges[p] + 1] / side[p]).astype(np.int64) if edges[p + 1] - edges[p] > 1 else np.zeros(len(x), np.int64)
                for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)):
                    new = [pa.array(c) for c in (np.full(len(x), p), cx + dx, cy + dy, np.full(len(x), not (dx or dy)))]
                    yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), *new], names=["node", "label", "part", "cx", "cy", "home"])

    # Places travel without vectors; a vector joins its units of work last, so that one shuffle carries it.
    many = nodes.groupBy("label").agg(F.count("*").alias("m")).filter("m > 1").select("label", "m", F.ceil(F.col("m") / block).cast("long").alias("nb"))
    whole = many
    places = None
    large = many.filter(F.col("nb") > 5 * parts)
    if large.limit(1).count():
        places = nodes.join(large.select("label"), "label").select("node", "label", "vector").mapInArrow(cells, f"node long, label {labels}, part long, cx long, cy long, home boolean")
        places = places.withColumn("root", F.xxhash64("label", "part", "cx", "cy"))
        sizes = places.groupBy("root", "label").agg(F.count("*").alias("m"), F.sum(F.col("home").cast("long")).alias("at_home")).filter("m > 1 and at_home > 0")
        sizes = stage(sizes.select("root", "label", "m", F.ceil(F.col("m") / block).cast("long").alias("nb")), "vector-cells")
        sent = sizes.groupBy("label").agg(F.sum(F.col("m") * F.col("nb")).alias("sent"))
        by_cell = large.join(sent, "label", "left").filter(F.coalesce("sent", F.lit(0)) < F.col("m") * F.col("nb")).select("label")
        whole = many.join(by_cell, "label", "left_anti")
        places = places.join(sizes.join(by_cell, "label", "left_semi").drop("m"), ["root", "label"])
    none = F.lit(0).cast("long")
    blocked = nodes.select("node", "label").join(whole.select("label", "nb"), "label")
    blocked = blocked.select("node", "label", F.lit(-1).cast("long").alias("part"), none.alias("cx"), none.alias("cy"), F.lit(True).alias("home"), F.xxhash64("label").alias("root"), "nb")
    if places is not None:
        blocked = blocked.unionByName(places)
    blocked = blocked.withColumn("blk", F.pmod(F.xxhash64("node", "home"), F.col("nb")))
    units = unit_keys(blocked).drop("label", "nb").join(nodes, "node").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")

    def tiles(y: np.ndarray, p: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Rows (a, b) of which the cells in block p of axes are the same or neighbours, and the first diagonal of a x b that counts:
        there each pair is in one tile, or in none."""
        cell = np.floor(y[:, edges[p] : min(edges[p] + 2, edges[p + 1])] / side[p]).astype(np.int64)
        cell = cell - cell.min(axis=0) + 1
        width = int(cell[:, 1].max()) + 2 if cell.shape[1] > 1 else 3
        code = cell[:, 0] * width + (cell[:, 1] if cell.shape[1] > 1 else 1)
        order = np.argsort(code, kind="stable")
        one, other = (order[order < split], order[order >= split]) if split else (order, order)
        keys, starts = np.unique(code[one], return_index=True)
        there = code[other]
        for key, s, e in zip(keys.tolist(), starts.tolist(), [*starts[1:].tolist(), len(one)]):
            for step in (-width, 0, width):
                lo, hi = np.searchsorted(there, (key + step - 1, key + step + 2)).tolist()
                for k in range(s, e, TILE):
                    a = one[k : min(e, k + TILE)]
                    # Inside one block of rows a pair is met from its first row, in the order of the cells.
                    for at in range(lo if split else max(lo, k), hi, TILE):
                        yield a, other[at : min(hi, at + TILE)], -TILE if split else k - at + 1

    def close(group: pa.Table, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that link, some at a time, each once."""
        x = numbers(group["vector"], dim)
        y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turned.T
        home = group["home"].to_numpy(zero_copy_only=False)
        part, label = group["part"].to_numpy(), np.unique(group["label"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        cell = np.stack([group["cx"].to_numpy(), group["cy"].to_numpy(), part, label])
        for p in range(parts) if part[0] < 0 else (int(part[0]),):
            for a, b, diagonal in tiles(y, p, split):
                ya, yb = y[a, edges[p] : edges[p + 1]], y[b, edges[p] : edges[p + 1]]
                gap = (ya**2).sum(1)[:, None] + (yb**2).sum(1)[None, :] - 2 * ya @ yb.T
                # A rim so narrow that only rounding could cross it is settled by direct sums below.
                near = gap <= budget[p] + 1e-7
                i, j = np.nonzero(near if diagonal <= 1 - len(a) else np.triu(near, diagonal))
                i, j = a[i], b[j]
                same = (cell[:, i] == cell[:, j]).all(axis=0) & (home[i] | home[j])
                i, j = i[same], j[same]
                # A pair belongs to the first block of axes whose budget it keeps.
                for q in range(p + 1):
                    gaps = ((y[i, edges[q] : edges[q + 1]] - y[j, edges[q] : edges[q + 1]]) ** 2).sum(1)
                    mine = gaps <= budget[q] if q == p else gaps > budget[q]
                    i, j = i[mine], j[mine]
                good = (x[i] * x[j]).sum(1) / np.sqrt((x[i] ** 2).sum(1) * (x[j] ** 2).sum(1)) >= threshold
                if good.any():
                    yield i[good], j[good]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (u, v, w): with v null, w rows link with node u inside this unit; otherwise u and v are one tree."""
        for group in runs(batches, ["root", "bi", "bj"]):
            bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
            block = group["blk"].to_numpy()
            split = int((block == bi).sum()) if bi != bj else 0
            if group.num_rows < 2 or (bi != bj and split in (0, group.num_rows)):
                continue
            group = group.take(pa.array(np.argsort(block, kind="stable")))
            node, weight = group["node"].to_numpy(), group["w"].to_numpy()
            n = len(node)
            count, root = np.zeros(n, np.int64), np.arange(n)
            for i, j in close(group, split):
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                apart = root[i] != root[j]
                if apart.any():
                    roots, ends = np.unique(np.unique(np.stack([root[i[apart]], root[j[apart]]]), axis=1), return_inverse=True)
                    least = np.arange(n)
                    least[roots] = roots[forest(len(roots), *ends.reshape(2, -1))]
                    root = least[root]
            if not count.any():
                continue
            some, tied = np.flatnonzero(count), np.flatnonzero(node[root] != node)
            cols = [node[np.append(some, tied)], pa.array([None] * len(some) + node[root[tied]].tolist(), pa.int64()), np.append(count[some], np.zeros(len(tied), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v", "w"])

    return stage(units.select("root", "bi", "bj", "blk", "node", "w", "label", "vector", "part", "cx", "cy", "home").mapInArrow(linked, "u long, v long, w long"), "vector-links")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable] = {"op6_vector_dedup": op6_vector_dedup}

SQL = {
    "op6_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT vec_id AS d, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.d)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(root) FROM r WHERE d = vec_id) AS component_id, vec_id = (SELECT min(root) FROM r WHERE d = vec_id) AS kept FROM embeddings"""
}
