"""Winnowing, filter audit and collocations against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd_documents
from tidemark.llm import collocations, filter_audit, winnowing
from tidemark.llm.common import mix64


def plain_winnow(text):
    if not text:
        return []

    def digest(s):
        x = sum((ord(c) + 1) * pow(winnowing.BASE, j, 1 << 64) for j, c in enumerate(s)) + (len(s) if len(text) < winnowing.GRAM else 0)
        return int(mix64(np.array([x % (1 << 64)], np.uint64))[0])

    h = [digest(text[i : i + winnowing.GRAM]) for i in range(len(text) - winnowing.GRAM + 1)] or [digest(text)]
    chosen = set()
    for i in range(max(1, len(h) - winnowing.WINDOW + 1)):
        w = h[i : i + winnowing.WINDOW]
        chosen.add(i + max(j for j, v in enumerate(w) if v == min(w)))
    return [(i, h[i] >> 32) for i in sorted(chosen)]


def some_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abé😀 ") for _ in range(r.choice([0, 1, 5, 11, 12, 13, 25, 30, 31, 32, 33, 80, 300]))) for _ in range(n)] + ["a" * 100, "ab" * 60]


def test_winnowing_by_brute_force():
    texts = some_texts(200)
    for text, found in zip(texts, winnowing.winnow(texts)):
        assert [tuple(map(int, x)) for x in found] == plain_winnow(text)
        assert [tuple(map(int, x)) for x in winnowing.winnow_long(text, chunk=37)] == plain_winnow(text)
        assert (winnowing.decoded(winnowing.encoded(found)) == found).all()


def test_a_shared_run_of_guaranteed_length_is_found():
    r = random.Random(4)
    reach = winnowing.GRAM + winnowing.WINDOW - 1
    for _ in range(100):
        run = "".join(r.choice("abc") for _ in range(reach))
        a, b = ("".join(r.choice("xyz") for _ in range(r.randrange(90))) + run + "".join(r.choice("xyz") for _ in range(40)) for _ in range(2))
        x, y = winnowing.winnow([a, b])
        assert set(x["hash"]) & set(y["hash"])


def neighbours_by_hand(rows):
    """Rows of the query: descending ids, nulls last, then hash order of texts of one id."""
    out = []
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        new = winnowing.edited(text, other)
        sets = [{h for _, h in plain_winnow(t)} for t in (text, new, other)]
        like = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    return out


@pytest.mark.parametrize("part_bytes", [100, 5000, 10**9])
def test_rows_meet_the_one_that_follows(spark, part_bytes):
    texts = some_texts(120, 3)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)] + [(7, "one row many times " * 3)] * 40 + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    got = winnowing.with_next(frame, winnowing.compared, winnowing.RESULT, part_bytes=part_bytes).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(neighbours_by_hand(ordered), key=key)
    for r in got:
        assert len({x.fingerprint for x in got if x.doc_id == r.doc_id and x.n_chars == r.n_chars}) == 1


def test_winnowing_of_odd_tables(spark):
    docs = odd_documents(spark)
    assert winnowing.with_next(empty(docs), winnowing.compared, winnowing.RESULT).count() == 0
    one = winnowing.with_next(docs.filter("doc_id = 3"), winnowing.compared, winnowing.RESULT).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    wide = winnowing.fingerprints(docs)
    assert wide.columns == [*docs.columns, "fingerprint"] and wide.count() == docs.count()
    assert all(len(r.fingerprint) == len(plain_winnow(r.text)) for r in wide.filter("text is null or length(text) < 100").collect() if r.text) and wide.filter("text is null").first().fingerprint == []


WORDS = ["alpha", "Beta", "GAMMA", "d$", "x|y", "é", "the"]


def audit_by_hand(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}
        rows.append((source or "", {c for c in fails if fails[c]}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for step in range(1, 6):
            for part in {r[0] for r in rows}:
                own, before = [r for r in rows if r[0] == part], set(order[: step - 1])
                c = order[step - 1]
                here = [r for r in own if c in r[1] and not r[1] & before]
                out[part, "".join(order), step] = [sum(not r[1] & (before | {c}) for r in own), len(here), sum(c in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {c} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
    share = Counter()
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] += v[1]
    return {k: [*v, share[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_filter_audit_by_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS + [f"w{k}" for k in range(80)]) for _ in range(r.choice([0, 3, 49, 50, 120]))) for _ in range(30)]
    docs = [(r.choice([None, *range(40)]), r.choice([None, "", "a\x0bb\x85c", *texts]), r.choice([None, "", "s1", "s2", "hot", "hot"])) for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 40, 2), 4, 4, None]]
    frame = spark.createDataFrame([(*d, 1, "A") for d in docs], "doc_id long, text string, source string, n long, part string")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == audit_by_hand(docs, labels)
    assert len(got) == 600 * 4
    assert filter_audit.audit(empty(frame), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_filter_audit_of_odd_documents(spark):
    docs = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    got = filter_audit.audit(docs, spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")).filter("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [x.part for x in got] == [""] * 5 and got[-1].kept == 0 and sum(x.good_lost for x in got) == 1
    assert got[0].kept == docs.count() - 1 and got[0].removed == 1  # row 2 is empty, as row 1, whose text is null


def phrases_by_hand(docs, least, top):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang, Counter())
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = tuple(w for w in piece.replace("\t", " ").split(" ") if w)
            total[lang] += len(words)
            own.update(words[i : i + k] for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def some_prose(n, seed):
    r = random.Random(seed)
    common, rare = ["The", "of", "la", "ÉÉ", "straße"], [f"w{k}" for k in range(60)] + ["日本", "a\x00b"]
    line = lambda: r.choice([" ", "  ", "\t"]).join(r.choice(common) if r.random() < 0.7 else r.choice(rare) for _ in range(r.randrange(1, 30)))
    return [("".join(line() + r.choice([". ", ",", "\n", "\r\n", "; ", " "]) for _ in range(r.randrange(6))), r.choice(["en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_collocations_by_brute_force(spark, size):
    docs = [*some_prose(150, 2), (None, "en"), ("", None), ("new york city hall. " * 50, "en"), ("x", "only")]
    frame = spark.createDataFrame([(t, c, 1) for t, c in docs], "text string, lang string, n int").repartition(3)
    got = collocations.collocations(frame, least=8, top=40, size=size)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_hand(docs, 8, 40)
    assert collocations.collocations(empty(frame)).count() == 0


def test_bitmaps_and_lists_count_alike():
    rng = np.random.default_rng(3)
    words = rng.choice([0, 1, 2, 3, *range(10, 2000)], 20000, p=[0.1, 0.3, 0.15, 0.05, *[0.4 / 1990] * 1990]).astype(np.int32)
    words[5000:5400] = 7
    plain = {k: Counter(tuple(w) for w in np.lib.stride_tricks.sliding_window_view(words, k).tolist() if all(w)) for k in (2, 3, 4)}
    for found in (collocations.phrase_counts(words, 4), collocations.phrase_counts(np.append(words, [0] * 50), 4)):
        for k, (rows, count) in found.items():
            assert dict(zip(map(tuple, rows.tolist()), count.tolist())) == plain[k]
    pairs = {p for p, c in plain[2].items() if c >= 5}
    keys = np.sort(np.array([(a << 32) | b for a, b in pairs]))
    for k, (rows, count) in collocations.phrase_counts(words, 4, 3, keys).items():
        assert dict(zip(map(tuple, rows.tolist()), count.tolist())) == {p: c for p, c in plain[k].items() if all(q in pairs for q in zip(p, p[1:]))}


def test_collocations_of_one_very_long_text(spark):
    text = "to be or not to be that is the question " * 30000
    rows = collocations.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), size=1000).collect()
    assert {r.phrase: r.a for r in rows}["that is the question"] == 30000 and rows[0].n == 300000
