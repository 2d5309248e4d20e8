"""Language-model scores: Katz backoff over bigrams with Good-Turing discounts.

The corpus is read once into chunks: distinct word hashes in order, and each document's words as places in
that list. Everything the model needs from all chunks is then gathered by request and reply:

* Unigrams: each chunk sends its words with their training counts to the bucket of their hash range, and gets
  corpus counts and word numbers back. The buckets are the unigram table.
* Bigrams: each chunk sends its distinct pairs, with training counts, to the bucket of the first word's hash
  range, and gets corpus counts back, and for first words that must back off the sums their weight needs. The
  buckets are the bigram table. A first word that occurs more often than a bucket should hold is hot: its pairs
  are dealt over parts of the bucket by the second word, the sums of the parts are added up in a second small
  aggregate, and the chunks that need them get the totals from there.

Counts are added up inside a chunk before they are sent, so a frequent word or pair costs one entry a chunk,
and no bucket sees documents. Counts of counts (a few numbers) give the discounts; backoff weights are exactly
normalised: a context's discounted probabilities and its weight times the unigram probability of all words it
was not seen with, the unknown word among them, add up to one. Chunks then score their documents token by
token: bigram, else weight times unigram, else weight times the mass of unknown words.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_words, mix64, slices, stage, table
from tidemark.llm.jaccard_join import runs

CLASSES = 5  # counts up to this one are discounted
END_HASH = np.uint64(0x9E0F0A0D00000001)  # stands for the end of a text in lists of word hashes


def packed(x: np.ndarray) -> bytes:
    """Little-endian numbers as compressed byte planes."""
    raw = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(f.strip().split(" ") for f in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


CHUNK = "chunk long, tokens long, ids array<long>, train binary, lengths binary, places binary, words binary, counts binary"


def chunks(rows: DataFrame, max_chars: int) -> DataFrame:
    """Rows (id, text, train) as chunks of documents. `places` are indices into `words`; the end of a text is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            hashes, offsets = hashed_words(t["text"].combine_chunks(), lower="ascii", split="ascii")
            n = np.diff(offsets)
            flat = np.insert(hashes, offsets[1:], END_HASH)
            words, places = np.unique(flat, return_inverse=True)
            train = t["train"].to_numpy(zero_copy_only=False).astype(bool)
            counted = np.repeat(train, n + 1)
            counts = np.bincount(places[counted], minlength=len(words)).astype(np.uint32)
            row = ((part << 32) + number, len(flat), t["id"].to_pylist(), packed(train.astype(np.uint8)), packed((n + 1).astype(np.uint32)), packed(places.astype(np.uint32)), packed(words), packed(counts))
            number += 1
            return batch_of(CHUNK, [row])

        for b in slices(batches, "text"):
            grown = b.column("text").nbytes
            if held and size + grown > max_chars:
                yield made()
                held, size = [], 0
            held.append(b)
            size += grown
        if held:
            yield made()

    return rows.mapInArrow(run, CHUNK)


def cuts(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (the first `bits` bits of the hash) begins in a sorted list of hashes; one more for the end."""
    borders = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(words, borders), len(words))


REQUEST = "bucket long, part long, chunk long, a binary, b binary, c binary, d binary"
REPLY = "kind long, bucket long, part long, chunk long, a binary, b binary, c binary, stats array<long>"
ANSWER, FIGURES, PARTIAL, ASKED = 0, 1, 2, 3  # kinds of replies


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, CLASSES + 2), minlength=CLASSES + 3)[1 : CLASSES + 2].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 1 to CLASSES (index 0 is unused), from counts of counts n[0] = n_1 on.

    With k = CLASSES and A = (k + 1) n_(k+1) / n_1: d_r = ((r + 1) n_(r+1) / (r n_r) - A) / (1 - A). Where counts are
    too few or uneven for a factor inside (0, 1), the factor is that of an absolute discount of one half.
    """
    d = np.ones(CLASSES + 1)
    for r in range(1, CLASSES + 1):
        d[r] = (r - 0.5) / r
        if n[0] and n[r - 1]:
            a = (CLASSES + 1) * n[CLASSES] / n[0]
            if a < 1:
                good = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
                d[r] = good if 0 < good < 1 else d[r]
    return d


def unigram_requests(held: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, c in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist()):
                words, counts = unpacked(w, np.uint64), unpacked(c, np.uint32)
                at = cuts(words, bits)
                yield batch_of(REQUEST, [(k, 0, chunk, packed(words[s:e]), packed(counts[s:e]), None, None) for k, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s])

    return held.select("chunk", "words", "counts").mapInArrow(run, REQUEST)


def unigram_replies(requests: DataFrame, bits: int) -> DataFrame:
    """For each chunk, counts and numbers of its words; for each bucket, one row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            bucket, chunk = group["bucket"][0].as_py(), group["chunk"].to_pylist()
            words = [unpacked(x, np.uint64) for x in group["a"].to_pylist()]
            counts = np.concatenate([unpacked(x, np.uint32) for x in group["b"].to_pylist()]).astype(np.float64)
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
            out, s = [], 0
            for k, w in zip(chunk, words):
                own = place[s : s + len(w)]
                s += len(w)
                out.append((ANSWER, bucket, 0, k, packed(total[own]), packed((own.astype(np.int64) << bits) + bucket), None, None))
            known = total[total > 0]
            out.append((FIGURES, bucket, 0, -1, None, None, None, [int(known.sum()), len(known), *counts_of_counts(known)]))
            yield batch_of(REPLY, out)

    return requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY)


class Unigrams:
    """Discounted probabilities of words by training count, as logarithms to base ten."""

    def __init__(self, stats: list[int]):
        self.total, self.distinct = stats[0], stats[1]
        n = stats[2:]
        self.factor = discounts(n)
        lost = sum((1 - self.factor[r]) * r * n[r - 1] for r in range(1, CLASSES + 1))
        # Without discounted mass, one more event is set aside for unknown words.
        self.scale = float(self.total) if lost > 0 else self.total + 1.0
        self.unknown = (lost if lost > 0 else 1.0) / self.scale if self.total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.factor[np.where(counts <= CLASSES, counts, 0)] * counts / self.scale, self.unknown)


def joined(held: DataFrame, *replies: DataFrame) -> DataFrame:
    """Chunks and the replies to them, as rows (chunk, level, bucket, part, …) with the chunk first."""
    none = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    rows = held.select("chunk", zero.alias("level"), zero.alias("bucket"), zero.alias("part"), "ids", "train", "lengths", "places", none("binary").alias("a"), none("binary").alias("b"), none("binary").alias("c"))
    for i, r in enumerate(replies, 1):
        r = r.filter(F.col("kind") == ANSWER).select("chunk", F.lit(i).cast("long").alias("level"), "bucket", "part", none("array<long>").alias("ids"), none("binary").alias("train"), none("binary").alias("lengths"), none("binary").alias("places"), "a", "b", "c")
        rows = rows.unionByName(r)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "level", "bucket", "part")


class Chunk:
    """One chunk with its unigram replies: tokens, training flags and the pairs of all documents.

    `units` are (bucket, part, places of the pairs): part 0 holds all pairs of contexts that are not hot.
    """

    def __init__(self, group: pa.Table, train_docs: int, hot: int):
        level = group["level"].to_numpy()
        first = group.slice(0, 1)
        self.ids = first["ids"].to_pylist()[0]
        self.train = unpacked(first["train"][0].as_py(), np.uint8).astype(bool)
        self.lengths = unpacked(first["lengths"][0].as_py(), np.uint32).astype(np.int64)
        self.places = unpacked(first["places"][0].as_py(), np.uint32).astype(np.int32)
        replies = group.filter(pa.array(level == 1))
        buckets, sizes, c, n = replies["bucket"].to_numpy(), [], [], []
        for x, y in zip(replies["a"].to_pylist(), replies["b"].to_pylist()):
            c.append(unpacked(x, np.int64))
            n.append(unpacked(y, np.int64))
            sizes.append(len(c[-1]))
        self.counts, self.numbers = np.concatenate(c), np.concatenate(n)
        self.answers, self.totals = group.filter(pa.array(level == 2)), group.filter(pa.array(level == 3))
        # Pairs: the context of a text's first token is the begin, which has the place after all words.
        begin = len(self.counts)
        context = np.empty_like(self.places)
        context[1:] = self.places[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        context[starts] = begin
        code = context * np.int64(begin + 1) + self.places
        self.code, pair = np.unique(code, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.first, self.second = np.divmod(self.code, begin + 1)
        self.owner = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.seen_here = np.bincount(self.pair[self.train[self.owner]], minlength=len(self.code)).astype(np.uint32)
        self.context_counts, self.context_numbers = np.append(self.counts, train_docs), np.append(self.numbers, -1)
        # Distinct contexts, the place of each pair's context among them, and what they are called outside.
        self.contexts, self.context = np.unique(self.first, return_inverse=True)
        parts = -(-self.context_counts[self.contexts] // hot)
        self.hot = parts > 1
        of_pair = parts[self.context].astype(np.uint64)
        part = np.where(of_pair > 1, 1 + (mix64(self.numbers[self.second].astype(np.uint64)) % np.maximum(of_pair, 1)).astype(np.int64), 0)
        bucket = np.append(np.repeat(buckets, sizes), -1)[self.first]  # the begin has a bucket of its own
        key = np.stack([bucket, part])
        order = np.lexsort((np.arange(len(part)), part, bucket))
        cut = np.flatnonzero(np.append(True, (np.diff(key[:, order], axis=1) != 0).any(axis=0)))
        self.units = [(int(bucket[order[s]]), int(part[order[s]]), order[s:e]) for s, e in zip(cut, np.append(cut[1:], len(order)))] if len(order) else []

    def runs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts (places in `contexts`) of pairs in order, and how many pairs each has."""
        return np.unique(self.context[places], return_counts=True)


def bigram_requests(rows: DataFrame, train_docs: int, hot: int) -> DataFrame:
    """Distinct pairs of a chunk, by bucket and part: context numbers with run lengths, second words' numbers, counts of pairs
    and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            chunk, c = group["chunk"][0].as_py(), Chunk(group, train_docs, hot)
            out = []
            for bucket, part, at in c.units:
                own, length = c.runs_of(at)
                contexts = np.stack([c.context_numbers[c.contexts[own]], length.astype(np.int64)])
                second = c.second[at]
                out.append((bucket, part, chunk, packed(contexts.reshape(-1)), packed(c.numbers[second]), packed(c.seen_here[at]), packed(c.counts[second])))
            yield batch_of(REQUEST, out)

    return rows.mapInArrow(run, REQUEST)


def bigram_replies(requests: DataFrame, unigrams: Unigrams) -> DataFrame:
    """For each chunk: corpus counts of its pairs; whether each context lost no mass; and, for contexts with a pair that was
    never seen, the numbers of their successors by count and the unigram mass of those successors. In parts of hot contexts,
    both are sums of the part, which go into rows of their own, with rows for the chunks that ask for the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "part"]):
            bucket, part, chunk = group["bucket"][0].as_py(), group["part"][0].as_py(), group["chunk"].to_pylist()
            contexts = [unpacked(x, np.int64).reshape(2, -1) for x in group["a"].to_pylist()]
            second = [unpacked(x, np.int64) for x in group["b"].to_pylist()]
            first = np.concatenate([np.repeat(x[0], x[1]) for x in contexts])
            v, first = np.unique(first, return_inverse=True)
            w, wid = np.unique(np.concatenate(second), return_inverse=True)
            code = first.astype(np.int64) * len(w) + wid
            counts = np.concatenate([unpacked(x, np.uint32) for x in group["c"].to_pylist()])
            word_counts = np.concatenate([unpacked(x, np.int64) for x in group["d"].to_pylist()])
            pairs, at, place = np.unique(code, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(pairs)).astype(np.int64)
            mine = first[at]
            seen = total > 0
            by_count = np.stack([np.bincount(mine[seen & (total == r)], minlength=len(v)) for r in range(1, CLASSES + 1)])
            mass = np.bincount(mine[seen], weights=unigrams.probability(word_counts[at[seen]]), minlength=len(v))
            whole = (by_count.sum(axis=0) == 0).astype(np.uint8)
            out, s = [], 0
            for k, x, y in zip(chunk, contexts, second):
                own = total[place[s : s + len(y)]]
                s += len(y)
                if part:
                    out.append((ANSWER, bucket, part, k, packed(own), None, None, None))
                    out.append((ASKED, bucket, part, k, packed(x[0]), None, None, None))
                    continue
                here = np.searchsorted(v, x[0])
                back = np.add.reduceat((own == 0).astype(np.int64), np.cumsum(x[1]) - x[1]) > 0
                sums = np.concatenate([by_count[:, here[back]].astype(np.float64), mass[None, here[back]]]).reshape(-1)
                out.append((ANSWER, bucket, part, k, packed(own), packed(whole[here]), packed(sums), None))
            if part:
                out.append((PARTIAL, bucket, part, -1, packed(v), packed(np.concatenate([by_count.astype(np.float64), mass[None]]).reshape(-1)), None, None))
            out.append((FIGURES, bucket, part, -1, None, None, None, counts_of_counts(total[seen])))
            yield batch_of(REPLY, out)

    return requests.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, REPLY)


def hot_totals(replies: DataFrame) -> DataFrame:
    """For each chunk that asks, the numbers of its hot contexts and the sums of all their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            bucket, kind = group["bucket"][0].as_py(), group["kind"].to_numpy()
            partial, asked = group.filter(pa.array(kind == PARTIAL)), group.filter(pa.array(kind == ASKED))
            numbers = [unpacked(x, np.int64) for x in partial["a"].to_pylist()]
            sums = np.concatenate([unpacked(x, np.float64).reshape(CLASSES + 1, -1) for x in partial["b"].to_pylist()], axis=1)
            # Parts in the order of their numbers, so that the sums of doubles come out the same each time.
            order = np.argsort(np.repeat(partial["part"].to_numpy(), [len(x) for x in numbers]), kind="stable")
            v, place = np.unique(np.concatenate(numbers)[order], return_inverse=True)
            total = np.stack([np.bincount(place, weights=row, minlength=len(v)) for row in sums[:, order]])
            wanted: dict[int, list[np.ndarray]] = {}
            for k, x in zip(asked["chunk"].to_pylist(), asked["a"].to_pylist()):
                wanted.setdefault(k, []).append(unpacked(x, np.int64))
            out = []
            for k, x in wanted.items():
                own = np.unique(np.concatenate(x))
                out.append((ANSWER, bucket, 0, k, packed(own), packed(total[:, np.searchsorted(v, own)].reshape(-1)), None, None))
            yield batch_of(REPLY, out)

    return replies.filter(F.col("kind").isin(PARTIAL, ASKED)).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(rows: DataFrame, unigrams: Unigrams, factor: np.ndarray, train_docs: int, hot: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            c = Chunk(group, train_docs, hot)
            word_log = np.log10(unigrams.probability(c.counts))
            reply = {(b, p): (x, y, z) for b, p, x, y, z in zip(*(c.answers[k].to_pylist() for k in ("bucket", "part", "a", "b", "c")))}
            own = np.zeros(len(c.code), np.int64)
            sums = np.zeros((CLASSES + 1, len(c.contexts)))
            whole = np.zeros(len(c.contexts), bool)
            for bucket, part, at in c.units:
                x, y, z = reply[bucket, part]
                own[at] = unpacked(x, np.int64)
                if not part:
                    here, length = c.runs_of(at)
                    lacks = np.add.reduceat((own[at] == 0).astype(np.int64), np.cumsum(length) - length) > 0
                    whole[here] = unpacked(y, np.uint8) > 0
                    sums[:, here[lacks]] = unpacked(z, np.float64).reshape(CLASSES + 1, -1)
            if c.hot.any():
                own_hot = np.flatnonzero(c.hot)
                names = c.context_numbers[c.contexts[own_hot]]
                order = np.argsort(names)
                for x, y in zip(c.totals["a"].to_pylist(), c.totals["b"].to_pylist()):
                    at = own_hot[order[np.searchsorted(names[order], unpacked(x, np.int64))]]
                    sums[:, at] = unpacked(y, np.float64).reshape(CLASSES + 1, -1)
                    whole[at] = sums[:CLASSES, at].sum(axis=0) == 0
            seen = c.context_counts[c.contexts]
            # Mass that discounts take away; a context without any gets one more event instead.
            scale = np.where(whole, seen + 1.0, np.maximum(seen, 1))
            lost = ((1 - factor[1:]) * np.arange(1, CLASSES + 1)) @ sums[:CLASSES]
            left = np.where(whole, 1.0, lost) / scale
            weight = np.where(seen > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - sums[CLASSES], 1e-300)), 0.0)
            d = factor[np.where(own <= CLASSES, own, 0)]
            d[own > CLASSES] = 1.0
            hit = np.log10(np.where(own > 0, d * own / scale[c.context], 1.0))
            logs = np.where(own > 0, hit, weight[c.context] + word_log[c.second])
            n = len(c.lengths)
            known = np.bincount(c.owner, weights=c.counts[c.places] > 0, minlength=n).astype(np.int64)
            base = np.bincount(c.owner, weights=np.log10((c.counts[c.places] + 1) / (unigrams.total + unigrams.distinct + 1)), minlength=n)
            total = np.bincount(c.owner, weights=logs[c.pair], minlength=n)
            cols = (c.ids, ~c.train, c.lengths, known, np.full(n, unigrams.total), base, total)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=[f.split(" ")[0] for f in SCORES.split(", ")])

    return rows.mapInArrow(run, SCORES)


def katz_scores(docs: DataFrame, train, text: str = "text", key: str = "doc_id", max_chars: int = 6_000_000, words_per_bucket: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    `train` is a column that holds for rows to learn from (null counts as false). Tokens are words between ASCII white
    space, with A-Z in lower case, and one end a text; null and empty texts have only the end. `score` is the model's
    log10 probability of the text, `base_score` that of unigrams with one added to each count. Repeated rows count each.
    Without training rows both scores are 0. Only counts of counts come to the driver. Other columns are not read.
    A bucket, or a part of one, holds about `words_per_bucket` words of the corpus. With 64-bit hashes, two of a billion
    different words are confused with a probability of 3 %.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    held = stage(chunks(rows, max_chars), "katz-chunks")
    spark = docs.sparkSession
    size = held.agg(F.sum("tokens")).first()[0]
    if not size:
        return spark.createDataFrame([], SCORES)
    bits = max(4, min(20, int(np.ceil(np.log2(max(1, size / words_per_bucket))))))
    one = stage(unigram_replies(unigram_requests(held, bits), bits), "katz-unigrams")
    sums = lambda replies, n: [int(x or 0) for x in replies.filter(F.col("kind") == FIGURES).agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()]
    unigrams = Unigrams(sums(one, CLASSES + 3))
    train_docs = rows.filter("train").count()
    two = stage(bigram_replies(bigram_requests(joined(held, one), train_docs, words_per_bucket), unigrams), "katz-bigrams")
    factor = discounts(sums(two, CLASSES + 1))
    totals = stage(hot_totals(two), "katz-hot")
    return scored(joined(held, one, two, totals), unigrams, factor, train_docs, words_per_bucket)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz_scores(docs, ~F.coalesce(held_out, F.lit(False)))


QUERIES: dict[str, Callable] = {"op7_katz": op7_katz}
