"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node (its copies are kept in full order up to one more than any query can return).
The start graph comes from `trees` random hyperplane partitions, whose leaves hold about `leaf` nodes
(crowded leaves are split again by a hash) and are compared inside exactly: a small and, as tables grow, vanishing
share of all pairs. Each round of NN-descent is a Spark join of neighbours of neighbours: every node meets, as a
centre, its neighbours and a sample of the nodes that have it as neighbour; all pairs at a centre with an entry that
is new since the last round are compared, and each node keeps its `k` nearest. Centres near each other are worked off
together, so a vector travels once to each unit of work that needs it. Rounds end when fewer than `settle` of all graph
entries change. Tables of every size go this way.

A query starts at its own node. Each step joins the nearest unvisited nodes of its beam with the graph and
the new neighbours with their vectors, until the nearest of the beam are all visited. The beam grows with the logarithm
of the table. Distances of the result are computed again in double precision from the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buckets_for, discard, mix64, stage, table
from tidemark.llm.jaccard_join import runs
from tidemark.llm.vector_dedup import clean_vectors

GRAPH = "node long, ids array<long>, gaps array<float>"


def graph_batch(nodes, ids, gaps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(gaps, pa.list_(pa.float32()))], names=["node", "ids", "gaps"])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def matrix(column, dim: int) -> np.ndarray:
    """[n, dim] float32 from a binary column of raw vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


LISTS = "bucket long, nodes binary, sizes binary, ids binary, gaps binary"


def lists_batch(nodes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, gaps: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Neighbour lists of many nodes as one row a bucket of nodes."""
    bucket = (mix64(nodes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    flat = np.repeat(bucket, sizes)
    order, inner = np.argsort(bucket, kind="stable"), np.argsort(flat, kind="stable")
    nodes, sizes, ids, gaps = nodes[order], sizes[order], ids[inner], gaps[inner]
    keys, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(nodes))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(int(k), nodes[s:e].tobytes(), sizes[s:e].tobytes(), ids[edge[s] : edge[e]].tobytes(), gaps[edge[s] : edge[e]].tobytes()) for k, s, e in zip(keys, at, ends)]
    kinds = (pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "nodes", "sizes", "ids", "gaps"])


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One row a node: its `k` nearest of all lists' entries, nearest first, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            read = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)  # noqa: B023, E731
            owner = np.repeat(read("nodes", np.int64), read("sizes", np.int64))
            i, g = read("ids", np.int64), read("gaps", np.float32)
            order = np.lexsort((g, i, owner))
            owner, i, g = owner[order], i[order], g[order]
            first = np.append(True, (owner[1:] != owner[:-1]) | (i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
            owner, i, g = owner[first], i[first], g[first]
            order = np.lexsort((i, g, owner))
            owner, i, g = owner[order], i[order], g[order]
            nodes, start = np.unique(owner, return_index=True)
            ends = np.append(start[1:], len(owner))
            yield graph_batch(nodes, [i[s : min(e, s + k)] for s, e in zip(start, ends)], [g[s : min(e, s + k)] for s, e in zip(start, ends)])

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, GRAPH)


def as_lists(graph: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes = np.diff(b.column("ids").offsets.to_numpy()).astype(np.int64)
                yield lists_batch(b.column("node").to_numpy(), sizes, b.column("ids").flatten().to_numpy(), b.column("gaps").flatten().to_numpy(), buckets)

    return graph.mapInArrow(run, LISTS)


def usable(vectors: DataFrame, vector: str, key: str, extra: F.Column) -> tuple[DataFrame, int]:
    """(id, extra, full, vec) of rows that take part: `full` holds the vector's doubles (without negative zeros), `vec` floats.

    All floats are scaled by one power of two, so that no finite double is too large for a float; the order of distances stays.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(extra, F.lit(False)).alias("extra"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.filter("id is not null").filter(clean_vectors(rows, "v"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    dim, most = (dims[0]["d"], dims[0]["m"]) if dims else (1, 1.0)
    scale = 2.0 ** -np.ceil(np.log2(most))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, dim) + 0.0
            full, vec = (pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, (x * scale).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("extra"), full, vec], names=["id", "extra", "full", "vec"])

    return rows.filter(F.size("v") == dim).mapInArrow(raw, "id long, extra boolean, full binary, vec binary"), dim


def nodes_of(rows: DataFrame, copies: int) -> DataFrame:
    """(node, members, full, vec): distinct vectors; `members` are the `copies` least ids."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("full").orderBy("id"))).filter(F.col("r") <= copies)
    grouped = ranked.groupBy("full").agg(F.sort_array(F.collect_list("id")).alias("members"), F.first("vec").alias("vec"))
    # Rows that share an id may hold different vectors: numbers of nodes come from the vectors then.
    first = F.col("members")[0]
    twice = grouped.groupBy(first.alias("node")).count().filter("count > 1").limit(1).count()
    return grouped.select((F.xxhash64("full") if twice else first).alias("node"), "members", "full", "vec")


def placed(nodes: DataFrame, dim: int, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(tree, leaf, sub, node, vec): the leaf of each node in each tree; no leaf part holds much more than `leaf` nodes."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(trees, dim, max(depth, 1))).astype(np.float32)
    sample = nodes.select("vec").orderBy(F.xxhash64("node"), "node").limit(2000).collect()
    x = np.frombuffer(b"".join(r["vec"] for r in sample), np.float32).reshape(-1, dim)
    middle = np.median(x @ planes, axis=1) if len(x) else np.zeros((trees, max(depth, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column("vec"), dim)
            for t in range(trees):
                bits = ((y @ planes[t]) > middle[t])[:, :depth]
                code = bits.astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(y), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), t)), pa.array(code), b.column("node"), b.column("vec")], names=["tree", "leaf", "node", "vec"])

    rows = nodes.select("node", "vec").mapInArrow(run, "tree long, leaf long, node long, vec binary")
    parts = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / leaf).cast("long").alias("parts"))
    return rows.join(parts, ["tree", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("node", "tree"), F.col("parts"))).drop("parts")


def start_graph(leaves: DataFrame, dim: int, k: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["tree", "leaf", "sub"]):
            x, node = matrix(group["vec"], dim), group["node"].to_numpy()
            if len(node) < 2:
                continue
            m = min(k, len(node) - 1)
            for at in range(0, len(node), 1024):
                d = squared(x[at : at + 1024], x)
                d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                own = node[at : at + 1024]
                yield lists_batch(own, np.full(len(own), m), node[near].reshape(-1), np.take_along_axis(d, near, 1).astype(np.float32).reshape(-1), buckets)

    keys = ["tree", "leaf", "sub"]
    return merged(leaves.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LISTS), k)


def descend(graph: DataFrame, homes: DataFrame, dim: int, k: int, reverse: int, buckets: int, drawn: int) -> DataFrame:
    """Candidates of one round that beat the node's farthest entry, `k` a node and unit at most, as lists by bucket.

    As in the paper, pairs of entries that have both met before are left out, and so are centres without a new entry. The
    reverse sample takes new entries first and is drawn anew in each round.
    """
    forward = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("member"), F.col("e.fresh").alias("fresh"))
    backward = forward.select(F.col("member").alias("node"), F.col("node").alias("member"), "fresh")
    order = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("member", "node", F.lit(drawn)), "member")
    backward = backward.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= reverse).drop("r")
    met = forward.unionByName(backward)
    active = met.filter("fresh").select("node").distinct()
    own = graph.select("node", F.col("node").alias("member"), F.lit(False).alias("fresh"))
    met = met.unionByName(own).join(active, "node", "left_semi").join(homes.select("node", "leaf", "sub"), "node")
    farthest = graph.select("node", F.when(F.size("gaps") >= k, F.element_at("gaps", -1)).otherwise(F.lit(float("inf")).cast("float")).alias("worst"))
    known = homes.select("node", "vec").join(farthest, "node")
    needed = met.select("leaf", "sub", F.col("member").alias("node")).distinct().join(known, "node")
    none = F.lit(None)
    units = met.select("leaf", "sub", F.lit(1).alias("kind"), "node", "member", "fresh", none.cast("binary").alias("vec"), none.cast("float").alias("worst")).unionByName(
        needed.select("leaf", "sub", F.lit(0).alias("kind"), "node", none.cast("long").alias("member"), none.cast("boolean").alias("fresh"), "vec", "worst")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["leaf", "sub"]):
            kind = group["kind"].to_numpy()
            vectors, links = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
            ids = vectors["node"].to_numpy()
            order = np.argsort(ids)
            ids, x, worst = ids[order], matrix(vectors["vec"], dim)[order], vectors["worst"].to_numpy()[order]
            centre, member, fresh = links["node"].to_numpy(), np.searchsorted(ids, links["member"].to_numpy()), links["fresh"].to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((~fresh, member, centre))
            centre, member, fresh = centre[order], member[order], fresh[order]
            once = np.append(True, (centre[1:] != centre[:-1]) | (member[1:] != member[:-1]))
            centre, member, fresh = centre[once], member[once], fresh[once]
            cuts = np.append(np.flatnonzero(np.append(True, centre[1:] != centre[:-1])), len(centre))
            square = (x * x).sum(1)
            best: list[np.ndarray] = []

            def pressed() -> np.ndarray:
                a, b, d = (np.concatenate(c) for c in zip(*best))
                o = np.lexsort((b, a))
                a, b, d = a[o], b[o], d[o]
                keep = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                a, b, d = a[keep], b[keep], d[keep]
                o = np.lexsort((d, a))
                a, b, d = a[o], b[o], d[o]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                return a[place < k], b[place < k], d[place < k]

            size = 0
            for s, e in zip(cuts[:-1], cuts[1:]):
                m, new = member[s:e], fresh[s:e]
                y = x[m]
                d = square[m][:, None] + square[m][None, :] - 2 * (y @ y.T)
                d[np.arange(len(m)), np.arange(len(m))] = np.inf
                a, b = np.nonzero((d < worst[m][:, None]) & (new[:, None] | new[None, :]))
                best.append((m[a], m[b], np.maximum(d[a, b], 0)))
                size += len(a)
                if size > 2_000_000:
                    best[:] = [pressed()]
                    size = len(best[0][0])
            if size:
                a, b, d = pressed()
                nodes, sizes = np.unique(a, return_counts=True)
                yield lists_batch(ids[nodes], sizes, ids[b], d.astype(np.float32), buckets)

    return units.repartition("leaf", "sub").sortWithinPartitions("leaf", "sub").mapInArrow(run, LISTS)


def build(nodes: DataFrame, dim: int, k: int = 32, trees: int = 4, leaf: int = 512, unit: int = 4096, reverse: int = 32, settle: float = 0.02, rounds: int = 12, seed: int = 5) -> DataFrame:
    """The neighbour graph (node, ids, gaps) over all nodes. `unit` centres, near each other, are worked off together."""
    n = nodes.count()
    buckets = buckets_for(n, 2048, 64)
    graph = start_graph(placed(nodes, dim, n, trees, leaf, seed), dim, k, buckets)
    graph = stage(graph.select("*", F.transform("ids", lambda x: F.lit(True)).alias("fresh")), "ann-graph")
    homes = stage(placed(nodes, dim, n, 1, unit, seed).drop("tree"), "ann-homes")
    for drawn in range(rounds):
        new = merged(as_lists(graph, buckets).unionByName(descend(graph, homes, dim, k, reverse, buckets, drawn)), k)
        new = new.join(graph.select("node", F.col("ids").alias("before")), "node", "left")
        new = new.withColumn("fresh", F.transform("ids", lambda x: ~F.array_contains(F.coalesce("before", F.array().cast("array<long>")), x))).drop("before")
        new = stage(new, "ann-graph")
        discard(graph)
        graph = new
        changed = graph.select(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if (changed or 0) < settle * n * k:
            break
    discard(homes)
    return graph


STATE = "q long, node long, vec binary, ids array<long>, gaps array<float>, seen array<long>"


def greedy(queries: DataFrame, graph: DataFrame, nodes: DataFrame, dim: int, beam: int, width: int, steps: int) -> DataFrame:
    """Beams (q, node, ids, gaps) of queries (q, node, vec), after a greedy search from each query's node."""
    kind = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("gaps", pa.list_(pa.float32())), ("seen", pa.list_(pa.int64()))])
    state = queries.join(graph, "node", "left").select("q", "node", "vec", F.concat(F.array("node"), F.coalesce("ids", F.array().cast("array<long>"))).alias("ids"), F.concat(F.array(F.lit(0).cast("float")), F.coalesce("gaps", F.array().cast("array<float>"))).alias("gaps"), F.array("node").alias("seen"))
    state = stage(state, "ann-state")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["q"]):
            rows = group.to_pylist()
            own = next(r for r in rows if r["ids"] is not None)
            ids, gaps = np.array(own["ids"], np.int64), np.array(own["gaps"], np.float32)
            new = [r for r in rows if r["ids"] is None]
            seen = own["seen"] + [r["node"] for r in new if r["expanded"]]
            fresh = {r["node"]: r["vec"] for r in new if not r["expanded"]}
            if fresh:
                fresh_ids = np.array(list(fresh), np.int64)
                keep = ~np.isin(fresh_ids, ids)
                y = np.frombuffer(b"".join(fresh.values()), np.float32).reshape(-1, dim)[keep]
                ids = np.concatenate([ids, fresh_ids[keep]])
                gaps = np.concatenate([gaps, squared(np.frombuffer(own["vec"], np.float32)[None], y)[0].astype(np.float32)])
                order = np.lexsort((ids, gaps))[:beam]
                ids, gaps = ids[order], gaps[order]
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((own["q"], own["node"], own["vec"], ids, gaps, seen), kind)], schema=kind)

    for _ in range(steps):
        front = state.select("q", F.explode(F.slice(F.array_except("ids", "seen"), 1, width)).alias("node"))
        front = stage(front, "ann-front")
        if not front.limit(1).count():
            break
        reached = front.join(graph.select("node", F.explode("ids").alias("to")), "node").select("q", F.col("to").alias("node")).distinct()
        fresh = reached.join(nodes.select("node", "vec"), "node").select("q", "node", "vec", F.lit(False).alias("expanded"))
        visited = front.select("q", "node", F.lit(None).cast("binary").alias("vec"), F.lit(True).alias("expanded"))
        rows = state.unionByName(fresh.unionByName(visited), allowMissingColumns=True)
        new = stage(rows.repartition("q").sortWithinPartitions("q").mapInArrow(step, STATE), "ann-state")
        discard(state, front)
        state = new
    return state.select("q", "node", "ids")


def search(vectors: DataFrame, is_query: F.Column, vector: str = "embedding", key: str = "vec_id", top: int = 10, k: int = 32, beam: int = 12, width: int = 32, steps: int = 40, leaf: int = 512) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the `top` nearest rows found for each row that `is_query` holds for.

    Nearest first, ties to the smaller id; a row never finds itself; rows equal to the query count,
    with distance 0. If fewer than `top` other rows exist, all are returned. Vectors that are null,
    zero, or hold null or non-finite components, rows without an id, and rows of another dimension than
    the most common take no part. Rows that share an id are told apart by their vectors; as a query, such an
    id stands for the vector that comes first in byte order. Every row is in the graph; only plane offsets are fitted on a
    sample (2000 vectors). The search runs on floats; scores and the order of the result come from the
    original doubles of four times `top` candidates. The beam has `beam` places for each doubling of the nodes. It is approximate: tests measure its recall against brute force.
    """
    rows, dim = usable(vectors, vector, key, is_query)
    nodes = stage(nodes_of(rows, top + 1), "ann-nodes")
    graph = build(nodes, dim, k, leaf=leaf)
    asked = rows.filter("extra").groupBy(F.col("id").alias("q")).agg(F.min("full").alias("full"))
    queries = stage(asked.join(nodes.select("full", "node", "vec"), "full").select("q", "node", "vec", "full"), "ann-queries")
    places = max(4 * top, beam * max(1, nodes.count().bit_length()))
    beams = greedy(queries.drop("full"), graph, nodes, dim, places, width, steps)
    discard(graph)
    near = beams.select("q", F.explode(F.slice("ids", 1, 4 * top)).alias("node")).join(nodes.select("node", "members", F.col("full").alias("other")), "node").join(queries.select("q", "full"), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(-1, dim) for c in ("full", "other"))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("members"), pa.array(np.sqrt(((x - y) ** 2).sum(1)))], names=["q", "members", "score"])

    found = near.select("q", "members", "full", "other").mapInArrow(exact, "q long, members array<long>, score double")
    found = found.select("q", F.explode("members").alias("vec_id"), "score").filter("vec_id <> q")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("rank") <= top)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable] = {"op8_neighbours": op8_neighbours}
