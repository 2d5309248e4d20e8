"""Class-balanced random forests of all agents at once over shared binned columns.

Columns are cut once into at most 32 bins by approximate quantiles, so a row is a few bytes that all trees of all agents share. Trees grow
level by level: a pass over the rows finds each row's node in each tree and counts positives and others by (tree, node, column, bin);
the counts of all tasks add up by node, and the best cuts, one a node, come to the driver. A pass covers at most `slots` nodes and
a batch at most `trees` x `batch` trees, which bound a task's counts and the driver's trees whatever the number of rows.

A row's weight in a tree is a Poisson number with mean 1 keyed by (row, tree), as bootstrap counts are for many rows, so a tree does not
depend on how rows are dealt over partitions, and counts are whole numbers, so sums do not either. A node looks at the square root
of the number of columns, drawn by (tree, node). Cuts take the largest gain in Gini's impurity under weights n / (2 n_class), ties the
first column, then the lowest bin. A score is the mean over trees of the weighted share of positives in the row's leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import staged

BINS = 32
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))
LIMITS = np.ceil(POISSON * 2.0**53).astype(np.uint64)
ROWS = 1 << 16  # rows that are sent down a tree at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers (xorshift and multiply)."""
    x = np.asarray(x).astype(np.uint64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """How often each row (its hash) is in the sample of each tree (its key)."""
    u = (mixed(keys.astype(np.uint64)[:, None] ^ trees[None, :]) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(POISSON, u, side="right")


def columns_of(tree: np.ndarray, node: np.ndarray, dim: int, k: int) -> np.ndarray:
    """The `k` columns, in order, that each node of a tree (its key) looks at."""
    order = mixed(mixed(tree ^ (node.astype(np.uint64) + np.uint64(1)))[:, None] + np.arange(dim, dtype=np.uint64)[None, :]).argsort(1, kind="stable")
    return np.sort(order[:, :k], 1)


def best_cuts(counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (nodes, columns, bins, 2: others and positives) and weights by node: which column, which last bin of the left side;
    -1 for the column where no cut has rows on both sides and a gain."""
    left = counts.cumsum(2)[:, :, :-1].astype(float)
    total = counts.sum(2, keepdims=True).astype(float)
    weight = np.stack([down, up], 1)[:, None, None, :]

    def impure(c: np.ndarray) -> np.ndarray:
        w = c * weight
        both = w.sum(-1)
        return np.where(both > 0, 2 * w[..., 0] * w[..., 1] / np.where(both > 0, both, 1), 0.0)

    right = total - left
    gain = impure(total) - impure(left) - impure(right)
    # Relative to all weight in the node and rounded, so that equal cuts tie.
    gain = np.round(gain / np.maximum((total * weight).sum(-1), 1e-300), 12)
    gain[(left.sum(-1) == 0) | (right.sum(-1) == 0)] = -1.0
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    top = flat[np.arange(len(flat)), at]
    return np.where(top > 0, at // (BINS - 1), -1), at % (BINS - 1)


class Trees:
    """Trees of a batch as heaps: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, keys: np.ndarray, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.keys = keys
        self.column = np.full((len(keys), size), -1, np.int16)
        self.cut = np.zeros((len(keys), size), np.uint8)
        self.value = np.zeros((len(keys), size), np.float32)

    def walk(self, tree: int, bins: np.ndarray, row: np.ndarray, levels: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of rows `row` of `bins` (columns, rows): those that `levels` steps do not lead to a leaf above, and their nodes; with `whole`
        all rows, at their leaf where it is above."""
        column, cut = self.column[tree].astype(np.int64), self.cut[tree]
        flat, size, node = bins.reshape(-1), bins.shape[1], np.zeros(len(row), np.int64)
        for level in range(levels):
            c = column[node]
            # Below a leaf there are leaves only, so a level without leaves has none above.
            ended = column[2**level - 1 : 2 ** (level + 1) - 1].min() < 0
            if ended and not whole:
                kept = c >= 0
                row, node, c = row[kept], node[kept], c[kept]
            step = 2 * node + 1 + (flat[c * size + row] > cut[node])
            node = np.where(c >= 0, step, node) if ended and whole else step
        return row, node


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Bins (columns, rows) of blocks of rows."""
    held, n = [], 0

    def block() -> tuple[np.ndarray, pa.Table]:
        part = pa.Table.from_batches(held).combine_chunks()
        return np.ascontiguousarray(np.frombuffer(b"".join(part["bins"].to_pylist()), np.uint8).reshape(n, dim).T), part

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield block()
            held, n = [], 0
    if n:
        yield block()


def sample(keys: np.ndarray, tree: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are in a tree's sample, and how often: `draws` by whole numbers."""
    y = mixed(keys ^ tree) >> np.uint64(11)
    row = np.flatnonzero(y >= LIMITS[0])
    y = y[row]
    times = np.ones(len(row), np.uint8)
    for limit in LIMITS[1:]:
        times += y >= limit
    return row, times


def _level(rows: DataFrame, grown: Trees, level: int, nodes: np.ndarray, agents: list, per: int, dim: int, k: int, weights: dict) -> list:
    """The best cut of each of `nodes` (tree, node) of a level: rows (slot, column, cut, counts left and right)."""
    slot = np.full(grown.column.shape, -1, np.int32)
    slot[nodes[:, 0], nodes[:, 1]] = np.arange(len(nodes))
    some = np.unique(nodes[:, 0])  # trees that still grow
    looked = columns_of(grown.keys[nodes[:, 0]], nodes[:, 1], dim, k)
    of_agent = {a: i for i, a in enumerate(agents)}
    width = k * BINS * 2
    alive = Trees(grown.keys[some], 0)
    alive.column, alive.cut, slot = grown.column[some], grown.cut[some], slot[some]
    first = np.searchsorted(nodes[:, 0], some)  # nodes come by tree
    many = np.diff(np.append(first, len(nodes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(nodes) * width, np.int32)
        for bins, part in _blocks(batches, dim):
            size, flat = bins.shape[1], bins.reshape(-1)
            keys = part["key"].to_numpy().view(np.uint64)
            own = part["own"].combine_chunks()
            positive = np.zeros((len(agents), size), np.int64)
            row = np.repeat(np.arange(size), np.diff(own.offsets.to_numpy()))
            col = np.array([of_agent.get(a, -1) for a in own.flatten().to_pylist()], np.int64)
            positive[col[col >= 0], row[col >= 0]] = 1
            times = np.zeros(size, np.uint8)
            for i, tree in enumerate(some):
                drawn, often = sample(keys, alive.keys[i])
                times[drawn] = often
                r, node = alive.walk(i, bins, drawn, level)
                s = slot[i][node].astype(np.int64)
                if level:
                    kept = s >= 0
                    r, s = r[kept], s[kept]
                side, weight, local = positive[tree // per][r], times[r].astype(float), s - first[i]
                mine = total[first[i] * width : (first[i] + many[i]) * width]
                for j in range(k):
                    where = ((local * k + j) * BINS + flat[looked[s, j] * size + r]) * 2 + side
                    mine += np.bincount(where, weight, len(mine)).astype(np.int32)
        total = total.reshape(len(nodes), width)
        met = np.flatnonzero(total.any(1))
        for s in range(0, len(met), 4096):
            ids = met[s : s + 4096]
            # Counts are small in most nodes: they travel in as few bytes as hold them.
            kind = np.min_scalar_type(total[ids].max())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([c.tobytes() for c in total[ids].astype(kind)], pa.binary())], names=["slot", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = {}, np.zeros((64, width), np.int64)
        for b in batches:
            ids = b.column("slot").to_pylist()
            place = np.array([at.setdefault(i, len(at)) for i in ids], np.int64)
            while len(at) > len(total):
                total = np.vstack([total, np.zeros_like(total)])
            sent = b.column("t").to_pylist()
            held = np.array([len(t) // width for t in sent])
            for size in np.unique(held):
                some_at = np.flatnonzero(held == size)
                np.add.at(total, place[some_at], np.frombuffer(b"".join(sent[i] for i in some_at), f"u{size}").reshape(len(some_at), width).astype(np.int64))
        if not at:
            return
        ids = np.array(list(at), np.int64)
        counts = total[: len(ids)].reshape(len(ids), k, BINS, 2)
        which, last = best_cuts(counts, weights["up"][nodes[ids, 0] // per], weights["down"][nodes[ids, 0] // per])
        left = counts.cumsum(2)[np.arange(len(ids)), np.maximum(which, 0), last]
        column = np.where(which >= 0, looked[ids, np.maximum(which, 0)], -1)
        out = [ids, column, last, *left.T, *(counts[:, 0].sum(1) - left).T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["slot", "column", "cut", "ln", "lp", "rn", "rp"])

    # Each task has added up its own counts, so what is left is one row a task and node, read as a stream.
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(nodes) // 64))
    summed = rows.mapInArrow(count, "slot int, t binary").repartition(tasks, "slot")
    return summed.mapInArrow(cut, "slot long, column long, cut long, ln long, lp long, rn long, rp long").collect()


def grow(rows: DataFrame, agents: list, positives: np.ndarray, n: int, dim: int, trees: int, depth: int, seed: int, slots: int, first: int) -> Trees:
    """The forests of `agents`, tree t of agent i at i x trees + t. `first` numbers the agents over all batches."""
    weights = {"up": n / (2 * np.maximum(positives, 1)), "down": n / (2 * np.maximum(n - positives, 1))}
    number = np.arange(len(agents) * trees, dtype=np.uint64) + np.uint64(first * trees)
    grown = Trees(mixed(mixed(number + np.uint64(seed << 32)) + np.uint64(1)), depth)
    grown.value[:, 0] = 0.5  # a tree whose sample is empty
    k = max(1, int(dim**0.5))
    todo = np.stack([np.arange(len(number)), np.zeros(len(number), np.int64)], 1)
    for level in range(depth):
        after = []
        for s in range(0, len(todo), slots):
            part = todo[s : s + slots]
            for r in _level(rows, grown, level, part, agents, trees, dim, k, weights):
                tree, node = map(int, part[r["slot"]])
                up, down = weights["up"][tree // trees], weights["down"][tree // trees]
                share = lambda neg, pos: up * pos / (up * pos + down * neg)  # noqa: B023, E731
                grown.value[tree, node] = share(r["ln"] + r["rn"], r["lp"] + r["rp"])
                if r["column"] < 0:
                    continue
                grown.column[tree, node], grown.cut[tree, node] = r["column"], r["cut"]
                for child, neg, pos in ((2 * node + 1, r["ln"], r["lp"]), (2 * node + 2, r["rn"], r["rp"])):
                    grown.value[tree, child] = share(neg, pos)
                    if neg and pos:
                        after.append((tree, child))
        todo = np.array(sorted(after), np.int64).reshape(-1, 2)
        if not len(todo):
            break
    return grown


def edges_of(vectors: DataFrame, dim: int) -> list[np.ndarray]:
    """The upper bounds of each column's bins but the last: approximate quantiles over all rows, each once."""
    at = F.array(*(F.lit(i / (BINS - 1)) for i in range(BINS - 1)))
    x = lambda j: F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
    found = vectors.agg(*(F.percentile_approx(x(j), at, 10_000).alias(f"q{j}") for j in range(dim))).first()
    return [np.unique(np.array(found[f"q{j}"] or [], float)) for j in range(dim)]


def forest_scores(vectors: DataFrame, labels: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42, batch: int = 10, slots: int = 60_000) -> DataFrame:
    """(agent, id, score) of each agent's forest for every agent of `labels` (agent, id) that has one of the rows (id, x), and every row.

    Components that are null or not a number lie in the last bin of their column. A row of an id that is there twice counts twice.
    Without rows or without agents the result is empty. `batch` agents are grown at a time and their scores staged.
    """
    spark, kinds, own_kind = vectors.sparkSession, dict(labels.dtypes), dict(vectors.dtypes)["id"]
    schema = f"agent {kinds['agent']}, id {own_kind}, score double"
    doubles = staged(vectors.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")), "forest-rows")
    own = staged(labels.select("agent", "id").filter("agent is not null").distinct().join(doubles.select("id"), "id"), "forest-labels")
    size = doubles.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    positives = {r["agent"]: r["n"] for r in own.groupBy("agent").agg(F.count("*").alias("n")).collect()}
    if not positives or not size["d"] or size["d"] < 1:
        return spark.createDataFrame([], schema)
    dim = size["d"]
    edges = edges_of(doubles, dim)
    lists = own.distinct().groupBy("id").agg(F.collect_list("agent").alias("own"))
    joined = doubles.join(lists, "id", "left").withColumn("own", F.coalesce("own", F.array().cast(f"array<{kinds['agent']}>"))).withColumn("key", F.xxhash64("id"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            bins = np.stack([np.where(np.isnan(x[:, j]), BINS - 1, np.searchsorted(e, x[:, j])) for j, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("own"), pa.array([r.tobytes() for r in bins], pa.binary())], names=["id", "key", "own", "bins"])

    # A row costs a step in each of many trees, so even a small table is spread over all tasks.
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = staged(joined.mapInArrow(binned, f"id {own_kind}, key long, own array<{kinds['agent']}>, bins binary").repartition(spread), "binned")
    agent_type = labels.limit(0).select("agent").toArrow().schema.field("agent").type
    order, out = sorted(positives), None
    for s in range(0, len(order), batch):
        some = order[s : s + batch]
        grown = grow(table.select("key", "own", "bins"), some, np.array([positives[a] for a in some], float), size["n"], dim, trees, depth, seed, slots, s)
        one = staged(table.select("id", "bins").mapInArrow(_scorer(grown, some, trees, depth, dim, agent_type), schema), "forest-scores")
        out = one if out is None else out.unionByName(one)
    return out


def _scorer(grown: Trees, agents: list, trees: int, depth: int, dim: int, agent_type: pa.DataType):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, part in _blocks(batches, dim):
            size = bins.shape[1]
            row, mean = np.arange(size), np.zeros((len(agents), size))
            for t in range(len(grown.keys)):
                mean[t // trees] += grown.value[t][grown.walk(t, bins, row, depth, whole=True)[1]]
            ids, mean = part["id"].combine_chunks(), mean / trees
            for i, a in enumerate(agents):
                yield pa.RecordBatch.from_arrays([pa.array([a] * size, agent_type), ids, pa.array(mean[i])], names=["agent", "id", "score"])

    return score
