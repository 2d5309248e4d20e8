"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

Each document (its ids and one end id) is cut into full sequences from its start and one
remainder. The lengths of all pieces form a histogram in classes of `step` tokens. On that
histogram, whose size does not grow with the data, a linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: a knapsack dynamic program
prices patterns against the dual values, a revised simplex step takes the best one in, until
Farley's bound says that no pattern can save more than `gap`. The solution is rounded down; what
is left, less than one sequence a pattern, is packed first-fit-decreasing. Pieces then get a rank
in their class, and the rank decides pattern, copy and slot.

Ranks need no ordered scan: each class is dealt over hash buckets, pieces are numbered inside a
bucket, and running sums of bucket counts give the bucket's first rank. A class that holds most
pieces is spread like all others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import buckets_for, slices, stage, table
from tidemark.llm.token_counts import byte_alphabet

CAPACITY, STEP = 1024, 4


class Encoder:
    """Token ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Where ids follow merge order, as in files of this kind, the same merges run in tiktoken, which
    is several times as fast; otherwise the tokenizers library itself runs.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        ids = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        if ids == sorted(ids) and len(set(ids)) == len(ids) and (not ids or ids[0] >= 256) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
            import public_tokenizers
            import tiktoken

            ranks = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, path: str, text: str, key: str, end_id: int, capacity: int) -> DataFrame:
    """One row a piece: full pieces from the document's start, then the remainder."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in slices(batches, "__text"):
            out: list[tuple] = []
            end = np.array([end_id], "<u4")
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist()):
                ids = np.concatenate([encode(t or ""), end]).astype("<u4", copy=False)
                raw = memoryview(ids).cast("B")
                n = len(ids)
                out += [(doc, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * min(n, s + capacity)]), n) for s in range(0, n, capacity)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits: unbounded knapsack by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        k = np.searchsorted(s, c, side="right")
        if k:
            gain = best[c - s[:k]] + v[:k]
            j = int(np.argmax(gain))
            if gain[j] > best[c] + 1e-12:
                best[c], pick[c] = gain[j], order[j]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), pattern


def start(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis, one pattern a column: the longest class left, filled up by a knapsack over the
    classes left, as often as demand allows. Each such pattern ends a class, so the columns, with
    patterns of one class for those that end beside another, are triangular."""
    left, basis = demand.astype(float).copy(), np.zeros((len(sizes), len(sizes)))
    open_ = left > 0
    for i in np.flatnonzero(~open_):
        basis[i, i] = capacity // sizes[i]
    while open_.any():
        at = np.flatnonzero(open_)
        longest = at[np.argmax(sizes[at])]
        rest = capacity - sizes[longest]
        pattern = np.zeros(len(sizes))
        if rest:
            pattern[at] = price(sizes[at] * (1 + 0.05 * sizes[at] / capacity), sizes[at], int(rest))[1]
        pattern[longest] += 1
        held = pattern > 0
        share = np.where(held, left / np.where(held, pattern, 1), np.inf)
        ends = int(np.argmin(share))
        left = np.maximum(left - share[ends] * pattern, 0)
        basis[:, ends] = pattern
        open_[ends] = False
        for i in np.flatnonzero(open_ & (left <= 1e-9)):
            basis[i, i], open_[i] = capacity // sizes[i], False
    return basis


def inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. The matrices are small; threads of a BLAS would only wait for each other."""
    n = len(basis)
    a = np.hstack([basis, np.eye(n)])
    for k in range(n):
        top = k + int(np.argmax(np.abs(a[k:, k])))
        if top != k:
            a[[k, top]] = a[[top, k]]
        a[k] /= a[k, k]
        others = np.flatnonzero(a[:, k])
        others = others[others != k]
        a[others] -= a[others, k][:, None] * a[k]
    return a[:, n:]


def patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used in the linear program's solution.

    Stops at Farley's bound: with the greatest pattern value v > 1 under the current duals, no
    solution is below cost / v. `rounds` bounds the pivots; the solution is feasible at any time.
    """
    basis = start(demand, sizes, capacity)
    inverse = inverted(basis)
    x = np.maximum(inverse @ demand, 0)
    for pivot in range(rounds):
        duals = inverse.sum(axis=0)
        value, column = price(duals, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, x / np.where(usable, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out] = column
        if pivot % 200 == 199:
            inverse = inverted(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.T, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class size: pieces} and the number of sequences of each, which hold all pieces of the histogram."""
    made: list[tuple[dict[int, int], int]] = []
    if capacity in histogram:
        made.append(({capacity: 1}, histogram[capacity]))
    sizes = np.array(sorted(s for s in histogram if s < capacity), np.int64)
    if not len(sizes):
        return made
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    unit = int(np.gcd.reduce([*sizes.tolist(), capacity]))
    rows, x = patterns(left.astype(float), sizes // unit, capacity // unit)
    for row, uses in sorted(zip(rows.round().astype(np.int64).tolist(), x), key=lambda p: -p[1]):
        row = np.array(row)
        if not row.any():
            continue
        times = int(min(np.floor(uses + 1e-6), (left[row > 0] // row[row > 0]).min()))
        if times:
            left -= times * row
            made.append(({int(s): int(a) for s, a in zip(sizes, row) if a}, times))
    # Fewer than one sequence a pattern: first fit, longest first; bins of one shape go in together.
    bins: list[tuple[int, dict[int, int]]] = []
    for s, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        while n:
            at = next((i for i, b in enumerate(bins) if b[0] >= s), None)
            if at is None:
                fit = capacity // s
                if n >= fit > 0 and n // fit > 1:
                    made.append(({s: fit}, n // fit))
                    n -= n // fit * fit
                    continue
                bins.append((capacity, {}))
                at = len(bins) - 1
            room, held = bins[at]
            k = min(n, room // s)
            held[s] = held.get(s, 0) + k
            bins[at] = (room - k * s, held)
            n -= k
    return made + [(held, 1) for _, held in bins]


def slots(made: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each class: rows (first rank, first sequence, pieces of the class in the pattern, order in the sequence)."""
    found: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in made:
        for order, (size, a) in enumerate(sorted(pattern.items(), reverse=True)):
            found.setdefault(size, []).append((ranks.get(size, 0), sequence, a, order))
            ranks[size] = ranks.get(size, 0) + a * times
        sequence += times
    return {s: np.array(r, np.int64) for s, r in found.items()}


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece.

    The pieces of a document cover its ids and the end id exactly; offsets in a sequence have no
    gaps; a sequence holds `capacity` tokens at most. Null and empty texts are one piece, the end
    id. Repeated rows are packed each. Ties in rank go by doc_id, start and crc. Other columns are
    not read; an empty table gives an empty table. Only the histogram (capacity / step numbers)
    comes to the driver.
    """
    spark = docs.sparkSession
    pieces = stage(pieces_of(docs, path, text, key, end_id, capacity), "pieces")
    size = (F.ceil(F.col("length") / step) * step).cast("long")
    pieces = pieces.withColumn("size", size)
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    where = slots(plan(histogram, capacity))
    dealt = buckets_for(sum(histogram.values()), 2000, 64)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(dealt)))
    first = pieces.groupBy("size", "bucket").count().withColumn("first", F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("first", F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(first, ["size", "bucket"]).withColumn("rank", F.col("first") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            sequence, order = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                mine = sizes == s
                rows = where[int(s)]
                at = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                inside = rank[mine] - at[:, 0]
                sequence[mine] = at[:, 1] + inside // at[:, 2]
                order[mine] = at[:, 3] * (capacity + 1) + inside % at[:, 2]
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(order)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable] = {"op3_packing": op3_packing}
