"""Document fingerprints by winnowing: rolling k-gram hashes, the least of each window (the rightmost of equal ones), positions kept.

Any run of GRAM + WINDOW - 1 code points that two texts share gives both an entry with the same hash. A text with fewer k-grams
than a window has one entry, their least; a text shorter than a k-gram has one entry, the hash of the whole; an empty text has none.
Null texts count as empty. Equal texts have equal fingerprints, and an empty one is like an empty one only.

The likeness of two fingerprints is twice the number of hashes that both hold over the sum of their numbers of hashes (sets).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, mix64, slices, stage, table, texts_of

GRAM, WINDOW = 12, 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
PART_BYTES, MOST_PARTS = 16_000_000, 20_000
LONG = 2_000_000

ENTRY = np.dtype([("position", "<u4"), ("hash", "<u4")])


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(x, dtype=np.uint64)


def rightmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of `w` neighbours of `h`, the place of its least value, the rightmost of equal ones."""
    at, cover = np.arange(len(h)), 1
    while cover < w:
        step = min(cover, w - cover)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        cover += step
    return at


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[np.ndarray]:
    """The fingerprint of each text, in order of position: an array of ENTRY."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        sums[1:] = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(codes)), dtype=np.uint64)
        back = _powers(pow(BASE, -1, 1 << 64), len(codes) + 1)
        rolled = mix64((sums[gram:] - sums[:-gram]) * back[: len(sums) - gram]) if len(codes) >= gram else np.zeros(0, np.uint64)
        count = np.maximum(size - gram + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(first[-1]) + np.repeat(start[:-1] - first[:-1], count)  # of each k-gram in `codes`
        h = rolled[place]
        short = np.flatnonzero((size > 0) & (size < gram))
        whole = mix64((sums[start[short + 1]] - sums[start[short]]) * back[start[short]] + size[short].astype(np.uint64))
    chosen = [np.zeros(0, np.int64)]
    if len(h) >= window:
        at = rightmost_minima(h, window)
        owner = np.repeat(np.arange(len(texts)), count)
        at = at[owner[: len(at)] == owner[window - 1 :]]
        chosen.append(at[np.append(True, np.diff(at) > 0)] if len(at) else at)
    few = np.flatnonzero((count > 0) & (count < window))
    if len(few):
        inside = np.repeat(first[few] - np.concatenate([[0], np.cumsum(count[few])[:-1]]), count[few]) + np.arange(count[few].sum())
        edges = np.concatenate([[0], np.cumsum(count[few])[:-1]])
        least = np.repeat(np.minimum.reduceat(h[inside], edges), count[few])
        hit, of = inside[h[inside] == least], np.repeat(np.arange(len(few)), count[few])[h[inside] == least]
        chosen.append(hit[np.searchsorted(of, np.arange(len(few)), side="right") - 1])
    at = np.sort(np.concatenate(chosen))
    owner = np.searchsorted(first, at, side="right") - 1
    out = np.zeros(len(at), ENTRY)
    out["position"], out["hash"] = place[at] - start[owner], h[at] >> np.uint64(32)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = [out[cut[i] : cut[i + 1]] for i in range(len(texts))]
    for i, x in zip(short, whole):
        found[i] = np.array([(0, int(x) >> 32)], ENTRY)
    return found


def winnow_long(text: str, gram: int = GRAM, window: int = WINDOW, chunk: int = LONG) -> np.ndarray:
    """`winnow` of one text in chunks that overlap by a window's reach, for texts whose arrays would be large."""
    if len(text) <= chunk + gram + window:
        return winnow([text], gram, window)[0]
    parts = []
    for at in range(0, len(text) - gram - window + 2, chunk):
        got = winnow([text[at : at + chunk + gram + window - 2]], gram, window)[0].copy()
        got["position"] += at
        parts.append(got)
    every = np.concatenate(parts)
    return every[np.unique(every["position"], return_index=True)[1]]


def winnow_all(texts: list[str]) -> list[np.ndarray]:
    if len(texts) == 1 or max(map(len, texts), default=0) > LONG:
        return [winnow_long(t) for t in texts]
    return winnow(texts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def encoded(x: np.ndarray) -> str:
    """Base64 of the entries: position and hash, each a little-endian unsigned 32-bit number."""
    return base64.b64encode(x.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ENTRY)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with a column `out`: array<struct<position: bigint, hash: bigint>>."""
    at = docs.columns.index(text)
    kept = [c for c in docs.columns if c != out]
    places = [docs.columns.index(c) for c in kept]
    schema = ", ".join([*(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept), f"`{out}` array<struct<position:bigint,hash:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1_000_000):
            found = winnow_all(texts_of(b.column(at)))
            flat = np.concatenate(found)
            pairs = pa.StructArray.from_arrays([pa.array(flat[c].astype(np.int64)) for c in ENTRY.names], names=list(ENTRY.names))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), lists], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """`text` with its last third (rounded down) replaced by as many first code points of `other`, or all it has."""
    tail = len(text) // 3
    return text[: len(text) - tail] + other[:tail]


def _bounds(docs: DataFrame, part_bytes: int) -> tuple[list[tuple], dict[tuple, bool]]:
    """First keys (null id, -id, hash) of the parts of about equal text size in descending order of id, and the keys whose copies
    alone exceed a part. Ids and hashes are sorted, not texts. At most MOST_PARTS and one a sorted partition come to the driver."""
    keys = stage(docs.groupBy("__id", "__h").agg(F.count("*").alias("c"), (F.sum("__n") + F.count("*")).alias("bytes")), "winnow-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    most = max(part_bytes, total // MOST_PARTS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = 0
        for b in batches:
            size, copies = b.column("bytes").to_numpy(), b.column("c").to_numpy()
            take = []
            for i in range(b.num_rows):
                hot = copies[i] > 1 and size[i] > most
                if room <= 0 or hot:
                    take.append((i, room <= 0, bool(hot)))
                    if room <= 0:
                        room = most
                room -= size[i] // copies[i] if hot else size[i]
            if take:
                rows, heads, hots = zip(*take)
                yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(rows)), b.column("__h").take(pa.array(rows)), pa.array(heads), pa.array(hots)], names=["id", "h", "head", "hot"])

    found = keys.orderBy(F.desc_nulls_last("__id"), "__h").mapInArrow(mark, "id bigint, h bigint, head boolean, hot boolean").collect()
    discard(keys)
    key = lambda r: (r.id is None, -(r.id or 0), r.h)
    return sorted(key(r) for r in found if r.head), {key(r): True for r in found if r.hot}


def _placed(docs: DataFrame, heads: list[tuple], hot: dict[tuple, bool]) -> DataFrame:
    @F.pandas_udf("part int, head boolean, hot boolean")
    def place(missing: pd.Series, ids: pd.Series, h: pd.Series) -> pd.DataFrame:
        keys = [(bool(m), -int(i), int(x)) for m, i, x in zip(missing, ids, h)]
        part = [bisect.bisect_right(heads, k) - 1 for k in keys]
        return pd.DataFrame({"part": part, "head": [heads[p] == k for p, k in zip(part, keys)], "hot": [k in hot for k in keys]})

    return docs.withColumn("__p", place(F.col("__id").isNull(), F.coalesce("__id", F.lit(0)), F.col("__h")))


def with_next(docs: DataFrame, run: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """`run` over the rows of each part as (id, text, copies, is_next) in descending order of id (nulls last, rows of one id in the
    order of a hash of their texts). After the last row of a part comes the first one of the part that follows, with `is_next` set:
    the first part follows the last.

    Texts cross the network once. Copies of a row (same id and text) that exceed a part are counted before they are moved.
    """
    rows = docs.select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumns({"__h": F.xxhash64("__text"), "__n": F.octet_length("__text").cast("long")})
    heads, hot = _bounds(rows.select("__id", "__h", "__n"), part_bytes)
    if not heads:
        return docs.sparkSession.createDataFrame([], schema)
    placed = _placed(rows, heads, hot).withColumn("__c", F.lit(1).cast("long"))
    cols = ["__id", "__h", "__text", "__c", "__p"]
    if hot:
        copies = placed.filter("__p.hot").groupBy("__id", "__h").agg(F.first("__text").alias("__text"), F.sum("__c").alias("__c"), F.first("__p").alias("__p"))
        placed = placed.filter("not __p.hot").select(cols).unionByName(copies.select(cols))
    n = len(heads)
    home = F.struct(F.col("__p.part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("__p.part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("guest"))
    spread = placed.withColumn("__to", F.explode(F.when(F.col("__p.head"), F.array(home, guest)).otherwise(F.array(home))))
    dealt = spread.select("__id", "__h", "__text", "__c", F.col("__to.part").alias("__part"), F.col("__to.guest").alias("__guest")).repartitionById(n, F.col("__part"))
    ordered = dealt.sortWithinPartitions("__guest", F.desc_nulls_last("__id"), "__h").select("__id", "__text", "__c", "__guest")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, "__text", 1_000_000):
            yield from zip(*(c.to_pylist() for c in b.columns))

    return ordered.mapInArrow(lambda batches: run(each(batches)), schema)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(rows: Iterator[tuple], room: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT: each text's fingerprint beside those of its edited text and of the text that follows."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def finish(held: list[tuple], seen: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
        """All of `held` but the last, which only follows; `seen` is the first one's fingerprint where known."""
        own = winnow_all([r[1] for r in held]) if seen is None else [seen, *winnow_all([r[1] for r in held[1:]])]
        sets = [np.unique(f["hash"]) for f in own]
        jobs = []  # (row, place of the text that follows)
        for i, (_, _, copies, _) in enumerate(held[:-1]):
            jobs += [(i, i + 1, 1)] + ([(i, i, copies - 1)] if copies > 1 else [])
        new = [edited(held[i][1], held[j][1]) for i, j, _ in jobs]
        out = []
        for (i, j, times), text, f in zip(jobs, new, winnow_all(new)):
            row = (held[i][0], len(held[i][1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), encoded(own[i]), encoded(f), likeness(sets[i], np.unique(f["hash"])), likeness(sets[i], sets[j]))
            out += [row] * times
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names), own[-1]

    held, size, seen = [], 0, None
    for r in rows:
        held.append(r)
        size += len(r[1])
        if len(held) > 1 and (size >= room or r[3]):
            batch, seen = finish(held, seen)
            yield batch
            held, size = [r], len(r[1])
        if r[3]:
            return


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"), compared, RESULT)


QUERIES = {"op11_fingerprints": op11_fingerprints}
