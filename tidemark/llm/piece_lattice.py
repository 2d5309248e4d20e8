"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for each piece of the vocabulary that matches, and one unknown edge for a
character without a piece of its own, which becomes byte pieces. Forward Viterbi scores, the best score of each
prefix, are exact heuristics for an A-star search that runs backward from the end: the first N complete paths it
takes from its queue are the N best segmentations, in order.

A lattice falls apart wherever no piece of the vocabulary holds the two characters at a place side by side. So
each distinct part of a batch is solved once (best path and second-best score); the N best of a text deviate from
its best path in the N - 1 parts with the smallest loss at most, and only these parts get an A-star search, after
which the few lists are merged exactly.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
INF = float("inf")


def fields(raw: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """(field, wire type, value, begin, end) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        begin = at
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = raw[at : at + size]
            at += size
        yield tag >> 3, kind, value, begin, at


class Suffix:
    """Ids of the end of a path, as a chain of edges that suffixes share."""

    __slots__ = ("own", "rest")

    def __init__(self, own: tuple[int, ...], rest: Suffix | None) -> None:
        self.own, self.rest = own, rest

    def ids(self) -> tuple[int, ...]:
        out, at = [], self
        while at is not None:
            out += at.own
            at = at.rest
        return tuple(out)


class Pieces:
    """Vocabulary and normalisation flags of a model file."""

    def __init__(self, model: bytes):
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[bytes] = []
        self.bytes: dict[int, int] = {}
        self.unk = 0
        self.prefix, self.squeeze, escape, charsmap = True, True, True, b""
        normal = 1
        for field, _, value, _, _ in fields(model):
            if field == 1:
                part = {f: v for f, _, v, _, _ in fields(value)}
                piece, kind = part[1].decode(), part.get(3, normal)
                score = float(np.frombuffer(part[2], "<f4")[0]) if 2 in part else 0.0
                number = len(self.text)
                self.text.append(b"" if kind in (2, 3) else piece.encode())
                if kind == 2:
                    self.unk = number
                elif kind == 6:
                    self.bytes[int(piece[3:-1], 16)] = number
                    self.text[-1] = bytes([int(piece[3:-1], 16)])
                elif kind in (normal, 4):
                    self.score[piece], self.id[piece] = score, number
            elif field == 3:
                spec = {f: v for f, _, v, _, _ in fields(value)}
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap or not escape:
            raise ValueError("a model without a character map is needed")
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.prefixes = {p[:i] for p in self.score for i in range(1, len(p))}
        # Scores of pieces (none is positive), None for what only begins a piece.
        self.steps: dict[str, float | None] = {p: None for p in self.prefixes} | {p: min(v, 0.0) for p, v in self.score.items()}
        self.score = {p: min(v, 0.0) for p, v in self.score.items()}
        self.longest = max(map(len, self.score), default=1)
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.solved: dict[str, tuple[float, float, np.ndarray]] = {}
        self.lists: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(t for t in text.split(" ") if t)
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def unknown(self, char: str) -> tuple[int, ...]:
        found = tuple(self.bytes.get(b, self.unk) for b in char.encode())
        return found if self.unk not in found else (self.unk,)

    def edges(self, part: str, i: int) -> Iterator[tuple[int, float]]:
        """Ends and scores of the edges that begin at `i`."""
        score, single = self.score, False
        for j in range(i + 1, len(part) + 1):
            sub = part[i:j]
            s = score.get(sub)
            if s is not None:
                single = single or j == i + 1
                yield j, s
            if sub not in self.prefixes:
                break
        if not single:
            yield i + 1, self.unknown_score

    def edges_into(self, part: str, at: int) -> Iterator[tuple[int, float]]:
        """Begins and scores of the edges that end at `at`."""
        score = self.score
        for i in range(max(0, at - self.longest), at - 1):
            s = score.get(part[i:at])
            if s is not None:
                yield i, s
        yield at - 1, score.get(part[at - 1 : at], self.unknown_score)

    def numbers(self, sub: str) -> tuple[int, ...]:
        n = self.id.get(sub)
        return (n,) if n is not None else self.unknown(sub)

    def solve(self, part: str) -> tuple[float, float, np.ndarray]:
        """Best score, second-best score (minus infinity if there is one path only) and ids of the best path.

        Among paths of equal score, the one that reaches each place by the longest piece wins.
        """
        found = self.solved.get(part)
        if found is not None:
            return found
        n = len(part)
        best, second, back = [-INF] * (n + 1), [-INF] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        get = self.steps.get
        for i in range(n):
            b, s2 = best[i], second[i]
            lone = True
            for j in range(i + 1, n + 1):
                s = get(part[i:j], 1)
                if s == 1:  # neither a piece nor the beginning of one
                    break
                if s is None:
                    continue
                if j == i + 1:
                    lone = False
                v = b + s
                if v > best[j]:
                    if best[j] > second[j]:
                        second[j] = best[j]
                    best[j], back[j] = v, i
                elif v > second[j]:
                    second[j] = v
                v = s2 + s
                if v > second[j]:
                    second[j] = v
            if lone:
                j, v = i + 1, b + self.unknown_score
                if v > best[j]:
                    if best[j] > second[j]:
                        second[j] = best[j]
                    best[j], back[j] = v, i
                elif v > second[j]:
                    second[j] = v
                v = s2 + self.unknown_score
                if v > second[j]:
                    second[j] = v
        ids: list[int] = []
        at, number = n, self.id.get
        while at:
            sub = part[back[at] : at]
            k = number(sub)
            if k is not None:
                ids.append(k)
            else:
                ids += self.unknown(sub)[::-1]
            at = back[at]
        ids.reverse()
        if len(self.solved) > 400_000:
            self.solved.clear()
        found = self.solved[part] = (best[n], second[n], np.array(ids, np.uint32))
        return found

    def nbest(self, part: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """The `count` best segmentations (fewer if there are not as many), best first, as scores and ids.

        Backward A-star: a queue entry is a suffix path; its priority is the suffix's score plus the forward Viterbi score of the
        place where it begins, which is exact, and among equal ones the number of ids, known in the same way. What still ties is
        followed to its end before others, so that a long part full of ties ends; of such paths those met first are returned.
        Memory is linear in the part: suffixes share their ends, edges are found where a suffix is extended, and only as many
        entries are kept as paths are asked for, with some room for rounding.
        """
        n = len(part)
        forward, fewest = [-INF] * (n + 1), [0] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here, ids = forward[i], fewest[i]
            for j, s in self.edges(part, i):
                v = here + s
                if v >= forward[j]:
                    k = ids + len(self.numbers(part[i:j]))
                    if v > forward[j] or k < fewest[j]:
                        forward[j], fewest[j] = v, k
        queue = [(-forward[n], fewest[n], n, 0, 0.0, 0, Suffix((), None))]
        found: list[tuple[float, tuple[int, ...]]] = []
        made, room = 0, 16 * count + 64
        while queue and len(found) < count:
            _, _, at, _, score, length, suffix = heapq.heappop(queue)
            if not at:
                found.append((score, suffix.ids()))
                continue
            for i, s in self.edges_into(part, at):
                own = self.numbers(part[i:at])
                made += 1
                k = length + len(own)
                heapq.heappush(queue, (-(score + s + forward[i]), k + fewest[i], i, made, score + s, k, Suffix(own, suffix)))
            if len(queue) > room:
                # Each entry stands for paths of its own, the best of which has the entry's priority.
                queue = heapq.nsmallest(4 * count + 16, queue)
        return sorted(found, key=lambda x: (-x[0], len(x[1]), x[1]))

    def listed(self, part: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self.lists.get(part)
        if found is None or len(found) < count:
            if len(self.lists) > 50_000:
                self.lists.clear()
            found = self.lists[part] = self.nbest(part, count)
        return found[:count]

    def parts(self, text: str) -> list[str]:
        """A normalised text, cut where no piece can cross."""
        pairs = self.pairs
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]

    def decode(self, ids) -> str:
        text = self.text
        raw = b"".join([text[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


_MODELS: dict[str, tuple[Pieces, np.ndarray]] = {}


def pieces(path: str) -> tuple[Pieces, np.ndarray]:
    """The model, and the sorted codes of character pairs that some piece holds; once in each process."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            model = Pieces(f.read())
        codes = np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in model.pairs), np.int64)
        _MODELS[path] = model, codes
    return _MODELS[path]


def encode_batch(texts: list[str], path: str, count: int) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, str, tuple[int, ...]]]], list[str]]]:
    """For each text: ids of the best segmentation, the N best scores, and how the others deviate: lists of (place of the part, ids)."""
    model, codes = pieces(path)
    texts = [model.normalise(t) for t in texts]
    stream = "\0".join([*texts, ""])
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32).astype(np.int64)
    pair = (points[:-1] << 21) | points[1:]
    at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
    begins = np.append(True, codes[at] != pair)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(length + 1) - 1
    begins[ends] = True
    begins[ends[:-1] + 1] = True
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    starts = np.flatnonzero(begins)
    raw = stream.encode()
    cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(byte[starts], byte[-1])), pa.py_buffer(raw))
    coded = cut.dictionary_encode()
    names = coded.dictionary.to_pylist()
    solved = [model.solve(p) for p in names]  # the filler is solved too, as a text may hold its sign, but belongs to no text
    best, second = np.array([s[0] for s in solved]), np.array([s[1] for s in solved])
    sizes = np.fromiter((len(s[2]) for s in solved), np.int64, len(solved))
    flat, offset = np.concatenate([s[2] for s in solved]), np.cumsum(sizes) - sizes
    code = coded.indices.to_numpy(zero_copy_only=False)
    first = np.searchsorted(starts, ends)  # place of each text's filler among the parts
    loss = best - second
    for a, b in zip([0, *(first[:-1] + 1)], first):
        own = code[a:b]
        n = sizes[own]
        ids = flat[np.repeat(offset[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(own) else flat[:0]
        score = float(best[own].sum())
        kept: list[tuple[float, list]] = [(0.0, [])]
        if count > 1 and len(own):
            gaps = loss[own]
            few = np.argsort(gaps, kind="stable")[: count - 1] if len(own) < 64 else np.sort(np.argpartition(gaps, count - 2)[: count - 1])
            few = few[np.isfinite(gaps[few])]
            for p in sorted(few.tolist()):
                options = model.listed(names[own[p]], count)
                top = options[0][0]
                kept = heapq.nsmallest(count, [(g + (top - s), d if i == 0 else [*d, (p, o)]) for g, d in kept for i, (s, o) in enumerate(options)], key=lambda x: (x[0], len(x[1]), x[1]))
        yield ids, [score - g for g, _ in kept], [d for _, d in kept], [names[c] for c in own] if any(d for _, d in kept) else []


def with_deviation(model: Pieces, parts: list[str], change: list[tuple[int, tuple[int, ...]]]) -> list[int]:
    other = dict(change)
    return [i for p, part in enumerate(parts) for i in (other[p] if p in other else model.solve(part)[2].tolist())]


def encode(docs: DataFrame, path: str, count: int = 1, text: str = "text", out: str = "segmentations") -> DataFrame:
    """`docs` with a column `out`: an array of (score, ids), the `count` best segmentations of each whole text, best first.

    A map without a shuffle. Null and empty texts have one empty segmentation of score 0. There are fewer than `count`
    where a text has fewer. Ties are settled by fewer changed parts, then by place. A column named `out` is replaced.
    """
    docs = docs.drop(out)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{out}` array<struct<score:double,ids:array<int>>>"])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1_000_000):
            model = pieces(path)[0]
            made = []
            for ids, scores, changes, parts in encode_batch([t or "" for t in b.column(text).to_pylist()], path, count):
                made.append([{"score": s, "ids": ids.tolist() if not c else with_deviation(model, parts, c)} for s, c in zip(scores, changes)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """`rows` with a column `out`: the text of each list of ids. Null lists give null; bytes that are no UTF-8 become U+FFFD."""
    rows = rows.drop(out) if out != ids else rows
    names = rows.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = pieces(path)[0]
            texts = [None if x is None else model.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, schema)


DIGEST = "n_pieces bigint, ids_crc32 bigint, score double, scores array<double>, decodes boolean"


def digests(docs: DataFrame, path: str, count: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and figures of the N best segmentations, without the ids themselves: pieces and CRC-32 of the best (ids as
    little-endian unsigned 32-bit numbers), all scores, and whether decoding gives the text back. Other rules as in `encode`."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), DIGEST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 4_000_000):
            model = pieces(path)[0]
            texts = [t or "" for t in b.column("__text").to_pylist()]
            made = [(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), scores[0], scores, model.decode(ids.tolist()) == t) for t, (ids, scores, _, _) in zip(texts, encode_batch(texts, path, count))]
            cols = list(zip(*made))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_())
            names = [*keep, "n_pieces", "ids_crc32", "score", "scores", "decodes"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return rows.mapInArrow(run, schema)


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4)


QUERIES: dict[str, Callable] = {"op4_piece_lattice": op4_piece_lattice}
