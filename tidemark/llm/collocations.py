"""Phrase collocations by position bitmaps, as in SPAM: one compressed bitmap a word and shard, phrases extended by shift and AND.

Texts are cut into shards of about SHARD words of one language. A shard numbers its words' places, leaving a gap between pieces
(and in place of words too rare to be in a phrase), so that a shift never crosses a piece. A word or phrase that holds many places
is a packed bitmap: shifted by one, and-ed with a word's bitmap and counted by popcount, depth first. All others are compressed
to lists of their places, which advance together: a shift adds one, AND looks the place up in the column of words.

Counts are exact and add up over shards: words first, then pairs of frequent words, then phrases all of whose pairs are frequent.
What a shard needs to know of the whole (its frequent words, its frequent pairs) comes back to it by joins on the shard, in
proportion to the shard; nothing of the vocabulary is broadcast.

Null texts count as empty, null languages as `und`. A text is never cut inside a piece. At most 2**31 - 1 frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table

SHARD = 1 << 20
LONGEST, LEAST, TOP = 4, 30, 2000
DENSE_WORD, DENSE_PHRASE = 64, 256  # a bitmap is packed where at least one place in so many is set

# ASCII capitals become small letters, tabs blanks, and all that ends a piece a line feed.
_PLAIN = bytes(32 if i == 9 else 10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(texts: list[str]) -> list[bytes]:
    """The words of all texts in order, with a line feed after each piece."""
    big = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_PLAIN) + b"\n"
    return [w for w in big.replace(b"\n", b" \n ").split(b" ") if w]


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """(shard, lang, places, words, counts): `places` holds 32-bit numbers of words (from 1; 0 ends a piece)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, chars = TaskContext.get().partitionId(), 0, {}, {}

        def flush(key: str) -> pa.RecordBatch:
            nonlocal made
            coded = pa.array(words_of(held.pop(key)), pa.binary()).dictionary_encode()
            del chars[key]
            names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            end = names.index(b"\n")
            number = np.arange(1, len(names) + 1, dtype=np.int32)
            number[end:] -= 1
            number[end] = 0
            places = number[at]
            # Gaps that follow gaps add nothing.
            places = places[np.append(True, (places[1:] != 0) | (places[:-1] != 0))]
            count = np.bincount(places, minlength=len(names))[1:]
            words = [w.decode("utf-8", "surrogatepass") for i, w in enumerate(names) if i != end]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([key]), pa.array([places.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([count.tolist()], pa.list_(pa.int32()))],
                names=["shard", "lang", "places", "words", "counts"],
            )

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(key, []).append(t)
                chars[key] = chars.get(key, 0) + len(t)
                # About six characters make a word. Many languages at once share the room of a few shards.
                if chars[key] > 6 * size:
                    yield flush(key)
                elif sum(chars.values()) > 24 * size:
                    yield flush(max(chars, key=chars.get))
        for key in list(held):
            yield flush(key)

    return rows.mapInArrow(run, "shard bigint, lang string, places binary, words array<string>, counts array<int>")


def _bits(places: np.ndarray, length: int) -> np.ndarray:
    """A packed bitmap of `places`, in whole 64-bit words with one to spare."""
    flags = np.zeros((length // 64 + 2) * 64, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view("<u8")


def _shifted(bits: np.ndarray) -> np.ndarray:
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def _places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def phrase_counts(words: np.ndarray, longest: int, shortest: int = 2, pairs: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (phrases as rows of words, counts)} in a shard's column of `words` (0 is a gap). With `pairs` (sorted, first << 32 |
    second) only phrases all of whose pairs are among them."""
    names, s = np.unique(np.append(words, 0), return_inverse=True)
    s = s.ravel()  # ends with a gap, so that every place has a next one
    n = len(s)
    joined = np.append((s[:-1] != 0) & (s[1:] != 0), False)  # may the word at a place be followed by the next?
    if pairs is not None:
        at = np.flatnonzero(joined)
        key = (names[s[at]].astype(np.int64) << 32) | names[s[at + 1]]
        near = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        joined[at] = pairs[near] == key if len(pairs) else False
    may = np.append(False, joined[:-1])  # may the word at a place follow the one before?
    loose = [np.zeros(n, bool) for _ in range(longest + 1)]  # ends of phrases of each length that are kept as lists
    found: dict[int, list[tuple]] = {k: [] for k in range(2, longest + 1)}
    size = np.bincount(s, minlength=len(names))
    dense = [w for w in np.flatnonzero(size * DENSE_WORD >= n) if w]
    is_dense = np.zeros(len(names), bool)
    is_dense[dense] = True
    follows, packed_next = _bits(np.flatnonzero(may), n), _bits(np.flatnonzero(is_dense[np.append(s[1:], 0)]), n)
    column = {w: _bits(np.flatnonzero(s == w), n) & follows for w in dense}

    def extend(phrase: tuple, bits: np.ndarray) -> None:
        k = len(phrase) + 1
        ahead = _shifted(bits)
        for w, own in column.items():
            child = ahead & own
            count = int(np.bitwise_count(child).sum())
            if count * DENSE_PHRASE >= n:
                found[k].append(((*phrase, w), count))
                if k < longest:
                    extend((*phrase, w), child)
            elif count:
                loose[k][_places(child)] = True
        others = _places(bits & ~packed_next) + 1
        others = others[others < n]
        loose[k][others[may[others]]] = True

    for w in dense:
        extend((w,), _bits(np.flatnonzero(s == w), n))
    loose[1] = (s != 0) & ~is_dense[s]
    for k in range(1, longest):
        loose[k + 1] |= np.append(False, loose[k][:-1]) & may
    out = {}
    second = None  # number of the pair that ends at a place
    for k in range(2, longest + 1):
        ends = np.flatnonzero(loose[k])
        if k == 2:
            key = s[ends - 1] * np.int64(len(names)) + s[ends]
        else:
            if second is None:
                at = np.flatnonzero(may)
                second = np.zeros(n, np.int64)
                second[at] = np.unique(s[at - 1] * np.int64(len(names)) + s[at], return_inverse=True)[1].ravel()
            if k == 3:
                key = second[ends - 1] * np.int64(len(names)) + s[ends]
            else:
                key = second[ends - 2] * np.int64(n) + second[ends]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        rows = names[np.stack([s[ends[first] - j] for j in range(k - 1, -1, -1)], axis=1)] if len(ends) else np.zeros((0, k), names.dtype)
        if found[k]:
            rows = np.concatenate([names[np.array([p for p, _ in found[k]])], rows])
            count = np.concatenate([[c for _, c in found[k]], count])
        if k >= shortest:
            out[k] = rows, count.astype(np.int64)
    return out


def _numbered(frequent: DataFrame) -> DataFrame:
    """`frequent` (lang, word, f) with numbers from 1, by counts of hash ranges and a number inside each."""
    x = frequent.withColumn("r", F.pmod(F.xxhash64("lang", "word"), F.lit(4096)))
    counts = x.groupBy("r").agg(F.count("*").alias("c"))
    before = counts.select("r", (F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("r")) - F.col("c")).alias("b"))
    number = F.row_number().over(Window.partitionBy("r").orderBy("lang", "word")) + F.col("b")
    return x.join(before, "r").select("lang", "word", "f", number.cast("int").alias("id"))


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): words (lang, word, f, id) and phrases (phrase: array of word ids, a) that occur `least` times at
    least, and all word occurrences (lang, n)."""
    cut = stage(shards(docs, text, lang, size), "phrase-shards")
    seen = cut.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("shard", "lang", F.col("pos").alias("local"), "col.words", "col.counts")
    per = seen.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    per = stage(per, "phrase-words")
    words = stage(_numbered(per.filter(F.col("f") >= least)), "phrase-frequent")
    known = seen.join(words.select("lang", F.col("word").alias("words"), "id"), ["lang", "words"]).groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("known"))

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                places = np.frombuffer(b.column("places")[i].as_buffer(), np.int32)
                known = b.column("known")[i].values
                ids = np.zeros(places.max(initial=0) + 1, np.int32)
                ids[known.field("local").to_numpy() + 1] = known.field("id").to_numpy()
                out = ids[places]
                out = out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]
                yield pa.RecordBatch.from_arrays([b.column("shard").slice(i, 1), pa.array([out.tobytes()], pa.binary())], names=["shard", "ids"])

    numbered = stage(cut.select("shard", "places").join(known, "shard").mapInArrow(renumber, "shard bigint, ids binary"), "phrase-ids")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids")):
                rows, count = phrase_counts(np.frombuffer(ids.as_buffer(), np.int32), 2)[2]
                key = (rows[:, 0].astype(np.int64) << 32) | rows[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), shard)), pa.array(key), pa.array(count)], names=["shard", "pair", "c"])

    # One exchange by pair: its total stands beside each shard's count.
    total = numbered.mapInArrow(pairs, "shard bigint, pair bigint, c bigint").withColumn("a", F.sum("c").over(Window.partitionBy("pair")))
    frequent = stage(total.filter(F.col("a") >= least).select("shard", "pair", "a"), "phrase-pairs")
    two = frequent.select("pair", "a").distinct().select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("phrase"), "a")

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, own in zip(b.column("ids"), b.column("pairs")):
                known = np.sort(own.values.to_numpy())
                for rows, count in phrase_counts(np.frombuffer(ids.as_buffer(), np.int32), longest, 3, known).values():
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(count)], names=["phrase", "c"])

    own = frequent.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    more = numbered.join(own, "shard").mapInArrow(longer, "phrase array<int>, c bigint").groupBy("phrase").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    phrases = two.unionByName(more) if longest > 2 else two
    return words, per.groupBy("lang").agg(F.sum("f").alias("n")), stage(phrases, "phrase-candidates")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """The `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    words, totals, phrases = candidates(docs, text, lang, least, longest, size)
    counts = phrases.select(F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"))
    counts = counts.unionByName(words.select(F.array("id").alias("part"), "f", "lang"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    left = cuts.withColumn("part", F.slice("phrase", F.lit(1), F.col("k"))).join(counts.withColumnRenamed("f", "l"), "part").drop("part")
    both = left.withColumn("part", F.expr("slice(phrase, k + 1, size(phrase) - k)")).join(counts.select("part", F.col("f").alias("r")), "part")
    score = F.expr("cast((cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(20, 0)) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = both.groupBy("phrase").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), best)  # the cut after one word knows the language
    # A longer candidate contains a phrase only if one that is a word longer does, and that one is as frequent at least.
    inner = phrases.filter(F.size("phrase") > 2).select(F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)"))).alias("phrase"), F.col("a").alias("around"))
    around = inner.groupBy("phrase").agg(F.max("around").alias("around"))
    kept = scored.join(around, "phrase", "left").filter("around is null or 100 * around < 80 * a").select("lang", "phrase", "a", "cut.*")
    # Names are needed for the rows that can be among the top, ties included.
    near = stage(kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place"), "phrase-top")
    said = near.select("phrase", F.posexplode("phrase").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = near.join(said.select("phrase", F.array_join("w.word", " ").alias("text")), "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}

_CUT = "SELECT lang, p, a, {k} AS k, array_to_string(w[:{k}], ' ') AS lp, array_to_string(w[{k} + 1:], ' ') AS rp FROM c WHERE len(w) > {k}"
SQL = {
    "op13_collocations": f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 pc AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pc),
 g AS ({' UNION ALL '.join(f"SELECT lang, unnest(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: w[i:i + {k - 1}])) AS w FROM w WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))}),
 f AS (SELECT lang, w, array_to_string(w, ' ') AS p, count(*) AS a FROM g GROUP BY 1, 2),
 n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(w) = 1 GROUP BY 1),
 c AS (SELECT * FROM f WHERE len(w) > 1 AND a >= {LEAST}),
 cuts AS ({' UNION ALL '.join(_CUT.format(k=k) for k in range(1, LONGEST))}),
 s AS (SELECT cuts.lang, cuts.p, cuts.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a)::HUGEINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = lp JOIN f y ON y.lang = cuts.lang AND y.p = rp),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
 i AS ({' UNION ALL '.join(f"SELECT lang, array_to_string(w[{o}:{o + m - 1}], ' ') AS p, a AS around FROM c WHERE len(w) > {m} AND len(w) >= {o + m - 1}" for m in range(2, LONGEST) for o in range(1, LONGEST - m + 2))}),
 m AS (SELECT lang, p, max(around) AS around FROM i GROUP BY 1, 2),
 k AS (SELECT b.* FROM b LEFT JOIN m USING (lang, p) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM k) JOIN n USING (lang) WHERE rank <= {TOP}"""
}
