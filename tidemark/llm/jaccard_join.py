"""Similarity self-join of texts on word n-grams: MinHash banding, then exact verification.

1. Each text becomes its set of hashed n-word shingles. Texts with equal sets are one node (a digest
   of the set is the key), so exact copies cost one row from here on.
2. `bands` x `rows` MinHash values give `bands` band hashes a node. A pair of similarity s shares a
   band with probability 1 - (1 - s^rows)^bands: with 40 x 8 it is 0.9994 at s = 0.8 and above
   0.99999 at 0.85. Each bucket of a band links its nodes to its least node (a star, not all pairs);
   connected components of these stars are the candidate groups.
3. Similar sets are of similar size, so a candidate group is parted by size class (steps of
   1 / threshold), and only neighbouring classes meet. Classes are cut into blocks by the room their sets
   take, and each pair of blocks that can meet is a unit of work of its own with bounded memory: it compares
   the full shingle sets of its pairs and keeps counts of links and a spanning forest, never the pairs. All
   pairs of a group that can link by size are compared, so no link between two texts that share a bucket is lost.
4. Components of the forests are the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MIX, components, dealt_anew, free_column, hashed_words, mix64, shingles, slices, stage, table


def hash_family(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, count, dtype=np.uint32)


def minhash(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 512) -> np.ndarray:
    """Least value of each of the hash functions a * x + b over the shingles `x`."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    folded = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), width):
        np.minimum(low, (a[:, None] * folded[None, at : at + width] + b[:, None]).min(axis=1), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int) -> np.ndarray:
    values = low.reshape(bands, -1).astype(np.uint64)
    acc = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for k in range(values.shape[1]):
            acc = mix64(acc * MIX + values[:, k])
    return acc.view(np.int64)


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two numbers."""
    d = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """(id, hash, k1, k2, size, bands) of rows (id, hash, text); the keys and bands of a text without words are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(bands * per_band)
        for batch in slices(batches, "text", 3_000_000):
            grams, offsets = shingles(*hashed_words(batch.column("text")), n)
            keys, sizes, found = [], [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if s == e:
                    keys.append((None, None))
                    sizes.append(0)
                    found.append(None)
                    continue
                own = np.unique(grams[s:e])
                keys.append(digest(own))
                sizes.append(len(own))
                found.append(band_hashes(minhash(own, a, b), bands))
            k1, k2 = zip(*keys)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "hash", "k1", "k2", "size", "bands"])

    return rows.mapInArrow(run, "id long, hash long, k1 long, k2 long, size long, bands array<long>")


def compare(sets: list[np.ndarray], split: int, threshold: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sets whose Jaccard similarity reaches `threshold`. With `split` > 0, i is below it and j is not."""
    sizes = np.array([len(s) for s in sets], np.float64)
    n = len(sets)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    left = slice(0, split) if split else slice(0, n)
    right = slice(split, n) if split else slice(0, n)
    common = np.zeros((len(range(n)[left]), len(range(n)[right])), np.float64)
    if len(shared):
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        owner, at = owner[hit], at[hit]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for c in range(0, len(shared), columns):
            a, b = np.searchsorted(at, [c, c + columns])
            held = np.zeros((n, min(columns, len(shared) - c)), np.float32)
            held[owner[a:b], at[a:b] - c] = 1
            common += held[left] @ held[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    close = common >= threshold * union - 1e-9
    if not split:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    return i, j + (split or 0)


def compare_by_size(sets: list[np.ndarray], split: int, threshold: float, part: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """As `compare`, part by part: sets are taken by size, and parts whose sizes lie too far apart are not compared."""
    size = np.array([len(s) for s in sets])
    rows = np.arange(split or len(sets))
    left = [a for a in np.array_split(rows[np.argsort(size[rows], kind="stable")], -(-len(rows) // part))]
    if split:
        other = np.arange(split, len(sets))
        right = [a for a in np.array_split(other[np.argsort(size[other], kind="stable")], -(-len(other) // part))]
    else:
        right = left
    found = []
    for x, a in enumerate(left):
        for y, b in enumerate(right):
            if not split and y < x or size[a[-1]] < threshold * size[b[0]] - 1e-9 or size[b[-1]] < threshold * size[a[0]] - 1e-9:
                continue
            if not split and y == x:
                i, j = compare([sets[k] for k in a], 0, threshold)
                found.append((a[i], a[j]))
            else:
                i, j = compare([sets[k] for k in (*a, *b)], len(a), threshold)
                found.append((a[i], b[j - len(a)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(c) for c in zip(*found))
    return np.minimum(i, j), np.maximum(i, j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Root of each of n nodes under links (i, j); the root is the least index of a tree."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, across batch borders; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(cols[:, s].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def verify(threshold: float, sets_of: Callable, repeats: bool = False) -> Callable:
    """Rows (u, v, w): with v null, w rows link with node u inside this unit; otherwise u and v are one tree.

    With `repeats`, a node may arrive more than once, and counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["u", "v", "w"])

        for group in runs(batches, ["root", "bi", "bj"]):
            bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
            block = group["blk"].to_numpy()
            if repeats:
                group = group.take(pa.array(np.unique(group["node"].to_numpy(), return_index=True)[1]))
                block = group["blk"].to_numpy()
            order = np.argsort(block, kind="stable")
            group = group.take(pa.array(order))
            split = int((block == bi).sum()) if bi != bj else 0
            if group.num_rows < 2 or (bi != bj and split in (0, group.num_rows)):
                continue
            node, weight = group["node"].to_numpy(), group["w"].to_numpy()
            i, j = sets_of(group, split, threshold)
            if not len(i):
                continue
            links = np.zeros(len(node), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            out += [(int(u), None, int(w)) for u, w in zip(node, links) if w]
            out += [(int(u), int(node[r]), 0) for u, r in zip(node, forest(len(node), i, j)) if node[r] != u]
            if len(out) > 50_000:
                yield flush()
        if out:
            yield flush()

    return run


def numbered(groups: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """`groups` (with `low`, the least id of each) staged with a number `node` of each, and whether the numbers differ from `low`.

    The number is `low` itself, unless rows of different groups share an id.
    """
    groups = stage(groups, name)
    shared = groups.groupBy("low").count().filter("count > 1").limit(1).count() > 0
    return (stage(groups.withColumn("node", F.monotonically_increasing_id()), name) if shared else groups.withColumn("node", F.col("low"))), shared


def members_of(stars: DataFrame, nodes: DataFrame, threshold: float, room: int, most: int, name: str) -> DataFrame:
    """(node, w, low, k1, k2, root, blk, met): candidate groups of more than one node.

    `blk` is the block of a node (size class and number), `met` all blocks that its block must meet. A block holds about
    `room` shingles, and `most` nodes at most.
    """
    spark = stars.sparkSession
    grouped = components(stars, spark, name)
    every = dealt_anew(grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct()), "node")
    step = float(np.log(1.0001 / threshold))
    own = nodes.select("node", "w", "low", "k1", "k2", "size", F.floor(F.log("size") / step).cast("long").alias("class"))
    every = stage(every.join(own, "node"), f"{name}-groups")
    sizes = every.groupBy("root", "class").agg(F.count("*").alias("m"), F.max("size").alias("size"))
    fits = F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.lit(room) / F.col("size"))))
    near = Window.partitionBy("root").orderBy("class").rangeBetween
    blocks = F.collect_list(F.struct("class", "nb"))
    sizes = sizes.select(F.col("root"), F.col("class"), F.ceil(F.col("m") / fits).cast("long").alias("nb")).withColumn("around", blocks.over(near(-1, 1))).withColumnRenamed("nb", "own")
    code = lambda kind, number: F.shiftleft(kind, 32) + number
    met = F.flatten(F.transform("around", lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["nb"] - 1), lambda i: code(c["class"], i))))
    every = dealt_anew(every, "root").join(sizes, ["root", "class"])
    return every.select("node", "w", "low", "k1", "k2", "root", code(F.col("class"), F.pmod(F.xxhash64("node"), F.col("own"))).alias("blk"), met.alias("met"))


def unit_keys(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its block is part of."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("__j")
    return rows.select("*", other).select("*", F.least("blk", "__j").alias("bi"), F.greatest("blk", "__j").alias("bj")).drop("__j")


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, threshold: float = 0.8, bands: int = 40, per_band: int = 8, room: int = 1_000_000, block: int = 128) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each row of `docs`.

    n_links is the number of other rows whose shingle sets have similarity `threshold` or more
    (copies counted each), class_id the least id that links lead to. Words are lower-cased and
    parted by white space. A text of fewer than `n` words has one shingle, of all its words. Texts
    that are null, empty or white space have no shingles: no links, and class_id is their own id.
    Rows without an id take no part and get class_id null and n_links 0. Rows that share an id count
    as rows of their own. Other columns are not read. No caps.
    """
    return classified(docs, text, key, n, threshold, bands, per_band, room, block).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, text: str, key: str, n: int = 5, threshold: float = 0.8, bands: int = 40, per_band: int = 8, room: int = 1_000_000, block: int = 128) -> DataFrame:
    """As `jaccard_join`, with a hash of each row's text and the number `root` of its class (null for rows that take no part)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    sig = stage(signatures(rows, n, bands, per_band), "signatures")
    with_words = sig.filter("k1 is not null and id is not null")
    groups = with_words.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("w"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes, apart = numbered(groups, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("c")).filter("c > 1")
    stars = banded.join(shared, "band").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    members = stage(members_of(stars, nodes, threshold, room, block, "near"), "members")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "w", "root", "blk", "met"]
        for batch in slices(batches, "text", 3_000_000):
            grams, offsets = shingles(*hashed_words(batch.column("text")), n)
            sets = [np.unique(grams[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if apart:  # rows of one id with other texts than the node's
                same = [digest(own) == key for own, key in zip(sets, zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))]
                batch, sets = batch.filter(pa.array(same)), [own for own, x in zip(sets, same) if x]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([own.tobytes() for own in sets], pa.binary())], names=[*names, "grams"])

    # Both sides grow with the table, so both are shuffled at every size.
    texts = rows.join(members.hint("merge"), rows["id"] == members["low"]).select("node", "w", "root", "blk", "met", "k1", "k2", "text")
    sets = texts.mapInArrow(with_sets, "node long, w long, root long, blk long, met array<long>, grams binary")
    units = sets.select("*", F.explode("met").alias("other")).select("root", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "node", "w", "grams")
    units = units.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    read = lambda group, split, t: compare_by_size([np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()], split, t)
    found = stage(units.mapInArrow(verify(threshold, read, repeats=True), "u long, v long, w long"), "links")
    return classes(found, nodes.select("k1", "k2", "node", "low", "w"), sig, ["k1", "k2"], "near", apart)


def classes(found: DataFrame, nodes: DataFrame, rows: DataFrame, keys: list[str], name: str, apart: bool) -> DataFrame:
    """Classes and link counts of `rows` (id and keys) from verified links between nodes.

    `apart` says that numbers of nodes differ from their least ids, so that a class takes its id from the least of its nodes.
    """
    spark = rows.sparkSession
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("links"))
    roots = components(found.filter("v is not null").select("u", "v"), spark, f"{name}-classes")
    of_node = nodes.join(links, "node", "left").join(roots, "node", "left")
    of_node = of_node.withColumn("root", F.coalesce("root", "node")).withColumn("class_id", F.col("root"))
    if apart:
        least = dealt_anew(of_node.groupBy("root").agg(F.min("low").alias("least")), "root")
        of_node = of_node.join(least, "root").withColumn("class_id", F.col("least"))
    of_node = of_node.select(*keys, "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    part = F.col(keys[0]).isNotNull() & F.col("id").isNotNull()
    more = [c for c in ("hash",) if c in rows.columns]
    linked = rows.filter(part).select("id", *more, *keys).join(of_node, keys).select(F.col("id").alias("doc_id"), *more, "class_id", "root", "n_links")
    alone = rows.filter(~part).select(F.col("id").alias("doc_id"), *more, F.col("id").alias("class_id"), F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with one document of each class of near-duplicates, the one with the least id; columns stay as they are.

    Rows without an id, and rows without words, all stay. Where texts of one class share the least id, one of them stays.
    """
    mark, number = free_column(docs, "__hash"), free_column(docs, "__key")
    found = classified(docs, text, key)
    least = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("m"))
    kept = least.select(F.col("m.doc_id").alias(number), F.col("m.hash").alias(mark)).distinct()
    rows = docs.withColumn(number, F.col(key).cast("long")).withColumn(mark, F.xxhash64(text))
    wordless = found.filter("root is null and doc_id is not null").select(F.col("doc_id").alias(number), F.col("hash").alias(mark)).distinct()
    lead = rows.join(kept, [number, mark], "left_semi").dropDuplicates([number, mark])
    rest = rows.join(wordless, [number, mark], "left_semi").unionByName(rows.filter(F.col(number).isNull()))
    return lead.unionByName(rest).select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op1_jaccard_join": op1_jaccard_join}

SQL = {
    "op1_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS a FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
 r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.d)
SELECT doc_id, (SELECT min(root) FROM r WHERE d = doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM documents"""
}
