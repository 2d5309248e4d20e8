"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled into two deterministic transducers:

* The pre-tokenizer (contractions, letter runs, digit runs, other runs, white
  space) becomes a table over 12 states and 12 character classes. Text is cut
  into chunks of equal length. All chunks run in lockstep from every state,
  which gives each chunk a state map; the maps compose through a parallel
  prefix scan, and the entry states that follow give all piece borders.
* The merges become a transducer over the bytes of a piece. Its state is the
  longest suffix that can begin a token, with the last token and the relative
  count at each position inside it; each transition carries the change of the
  token count. States are determinised as they are met and kept for the task.

Special strings count as one token each, which is the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

# The classes of characters and the states of the pre-tokenizer.
LETTER, STMD, R, V, L, E, NUMBER, BLANK, WHITE, QUOTE, OTHER, END = range(12)
START, LETTERS, NUMBERS, OTHERS, QUOTED, BLANK1, WHITE1, BLANKS, WHITES, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
K = 12
NOW, PREVIOUS = 1, 2  # outputs: a piece begins at this character, or at the one before it


def _pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs, both indexed by state * 12 + class."""
    step, out = np.zeros(K * 12, np.uint8), np.zeros(K * 12, np.uint8)

    def begin(c: int) -> int:
        if c in (LETTER, STMD, R, V, L, E):
            return LETTERS
        return {NUMBER: NUMBERS, BLANK: BLANK1, WHITE: WHITE1, QUOTE: QUOTED, OTHER: OTHERS, END: START}[c]

    def joined(c: int) -> int:
        return OTHERS if c in (QUOTE, OTHER) else begin(c)

    letters = (LETTER, STMD, R, V, L, E)
    for c in range(12):
        fresh = (begin(c), NOW)
        run = {
            START: fresh,
            LETTERS: (LETTERS, 0) if c in letters else fresh,
            NUMBERS: (NUMBERS, 0) if c == NUMBER else fresh,
            OTHERS: (OTHERS, 0) if c in (QUOTE, OTHER) else fresh,
            QUOTED: {STMD: (START, 0), R: (QUOTE_R, 0), V: (QUOTE_V, 0), L: (QUOTE_L, 0), QUOTE: (OTHERS, 0), OTHER: (OTHERS, 0)}.get(c, fresh),
        }
        for s, second in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
            to, o = run[LETTERS]
            run[s] = (START, 0) if c == second else (to, o | PREVIOUS)
        white = {BLANK: (BLANKS, 0), WHITE: (WHITES, 0), END: (START, NOW)}
        run[BLANK1] = white.get(c, (joined(c), 0))
        run[WHITE1] = white.get(c, fresh)
        run[BLANKS] = white.get(c, (joined(c), PREVIOUS))
        run[WHITES] = white.get(c, (begin(c), NOW | PREVIOUS))
        for s, (to, o) in run.items():
            step[s * 12 + c], out[s * 12 + c] = to, o
    return step, out


STEP, OUT = _pretokenizer()
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point; made once in each process, from Unicode's general categories."""
    if not _CLASSES:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        every, at = "".join(map(chr, points)), np.array(points)
        found = np.full(0x110000, OTHER, np.uint8)
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
            for m in regex.finditer(pattern, every):
                found[at[m.start() : m.end()]] = k
        for chars, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", BLANK), ("'", QUOTE)):
            found[[ord(c) for c in chars]] = k
        _CLASSES.append(found)
    return _CLASSES[0]


def scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of state maps [n, K]: row i is the map of all rows before i.

    Work-efficient: neighbours are composed in pairs, the half as many maps are scanned in the
    same way, and the odd rows follow from one more composition.
    """
    n = len(maps)
    if n <= 1:
        return np.tile(np.arange(K, dtype=np.uint8), (n, 1))
    even, odd = maps[0 : n - n % 2 : 2], maps[1::2]
    before = scan(np.take_along_axis(odd, even, 1))
    out = np.empty_like(maps)
    out[0 : n - n % 2 : 2] = before
    out[1::2] = np.take_along_axis(even, before, 1)
    if n % 2:
        out[-1] = np.take_along_axis(odd[-1:], out[-2:-1], 1)
    return out


def borders(classes: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Where pieces begin, as booleans, for a stream of classes in which END follows each text."""
    n = len(classes)
    rows = -(-n // chunk)
    c = np.full(rows * chunk, END, np.uint8)
    c[:n] = classes
    c = np.ascontiguousarray(c.reshape(rows, chunk).T)
    maps = np.tile(np.arange(K, dtype=np.uint8)[:, None], (1, rows))
    for j in range(chunk):
        maps = STEP[maps * np.uint8(12) + c[j]]
    entry = scan(np.ascontiguousarray(maps.T))[:, START]
    state = entry
    told = np.empty((chunk, rows), np.uint8)
    for j in range(chunk):
        at = state * np.uint8(12) + c[j]
        told[j] = OUT[at]
        state = STEP[at]
    told = told.T.reshape(-1)[:n]
    begins = (told & NOW) > 0
    begins[:-1] |= (told[1:] & PREVIOUS) > 0
    return begins


class MergeTransducer:
    """Token counts of byte pieces; states and transitions are compiled as they are met."""

    def __init__(self, merges: list[tuple[bytes, bytes]], max_states: int = 300_000):
        self.rank = {m: i for i, m in enumerate(merges)}
        parts = {a + b: (a, b) for a, b in merges}
        tokens = {bytes([b]) for b in range(256)} | set(parts)
        self.tokens = tokens
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t))} | {b""}
        self.max_states = max_states
        inf = len(merges)

        def spine(t: bytes, side: int) -> list[tuple[bytes, int]]:
            """Symbols at the outer side of a token, from byte to token, each with the rank of the merge that ends it."""
            found, end = [], inf
            while True:
                found.append((t, end))
                if t not in parts:
                    return found
                end = self.rank[parts[t]]
                t = parts[t][side]

        self.right = {t: spine(t, 1) for t in tokens}
        self.left = {t: spine(t, 0) for t in tokens}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: (suffix, last tokens at the positions in it, their counts against the current one).
        first = (b"", (None,), (0,))
        self.ids, self.states, self.next = {first: 0}, [first], [{}]

    def _restart(self, state: int) -> int:
        """Forget all states but the first and `state`, which gets a new number."""
        kept = self.states[state]
        self._clear()
        if kept not in self.ids:
            self.ids[kept] = len(self.states)
            self.states.append(kept)
            self.next.append({})
        return self.ids[kept]

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of a + b stop at these two tokens: no merge across the border comes first."""
        found = self.pairs.get((a, b))
        if found is None:
            rank, found = self.rank, True
            for x, x_end in self.right[a]:
                for y, y_end in self.left[b]:
                    r = rank.get((x, y))
                    if r is not None and r < x_end and r <= y_end:
                        found = False
                        break
                if not found:
                    break
            self.pairs[a, b] = found
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            t = grown[i:]
            if t in self.tokens and (last[i] is None or self.follows(last[i], t)):
                break
        delta = counts[i] + 1
        last, counts = (*last, t), (*(c - delta for c in counts), 0)
        cut = 0
        while grown[cut:] not in self.prefixes:
            cut += 1
        new = (grown[cut:], last[cut:], counts[cut:])
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][byte] = (to, delta)
        return to, delta

    def count(self, piece: bytes) -> int:
        found = self.known.get(piece)
        if found is None:
            state, found, step = 0, 0, self.next
            for byte in piece:
                hop = step[state].get(byte)
                if hop is None:
                    if len(self.states) > self.max_states:
                        state = self._restart(state)
                        step = self.next
                    hop = self.compile(state, byte)
                state = hop[0]
                found += hop[1]
            if len(piece) <= 64:
                if len(self.known) > 2 * self.max_states:
                    self.known.clear()
                self.known[piece] = found
        return found


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[MergeTransducer, list[str]]:
    """The merge transducer and the special strings of a byte-level BPE file for the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
    alphabet = byte_alphabet()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    pairs = [tuple(bytes(alphabet[c] for c in s) for s in m) for m in merges]
    return MergeTransducer(pairs), [t["content"] for t in spec.get("added_tokens", [])]


_LOADED: dict[str, tuple[MergeTransducer, list[str]]] = {}


def tokenizer(path: str) -> tuple[MergeTransducer, list[str]]:
    """`load`, once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return _LOADED[path]


def count_batch(texts: list[str], path: str) -> np.ndarray:
    """Token counts of texts."""
    merges, special = tokenizer(path)
    extra = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for s in special:
            if s in text:
                pieces = [q for p in pieces for q in p.split(s)]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    stream = "\0".join([*parts, ""])  # each text is followed by one character, which becomes END
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    classes = char_classes()[points]
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(length + 1) - 1
    classes[ends] = END
    begins = borders(classes)
    begins[ends] = True  # the filler is a piece of its own, dropped below
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    starts = np.flatnonzero(begins)
    offsets = np.append(at[starts], at[-1])
    raw = stream.encode()
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    coded = pieces.dictionary_encode()
    count = merges.count
    each = np.fromiter((count(p) for p in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    tokens = each[coded.indices.to_numpy(zero_copy_only=False)]
    filler = classes[starts] == END
    tokens[filler] = 0
    part = np.cumsum(filler) - filler
    sums = np.bincount(part, weights=tokens, minlength=len(parts)).astype(np.int64)
    np.add.at(extra, np.array(owner, np.int64), sums)
    return extra


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    A map without a shuffle: rows come back one for one, in any number of partitions.
    Null and empty texts have 0 bytes and 0 tokens. Long texts are counted whole. Repeated rows
    each get a row. Other columns of `docs`, whatever their names, are not read; an empty table
    gives an empty table. `keep` must not hold the names of results.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), "n_bytes bigint, n_tokens bigint, over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            n = count_batch(texts, path)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable] = {"op5_token_counts": op5_token_counts}
