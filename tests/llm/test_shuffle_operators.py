"""Joins, packing, search, language model and the pipeline, each against brute force."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import DIR, empty, odd_documents, table
from tidemark.llm import ann, common, jaccard_join, katz, packing, quality, secrets, vector_dedup
from tidemark.llm.common import components

BPE = public_tokenizers.path("byte_bpe_50k.json")


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def links_by_brute_force(docs, threshold=0.8):
    sets = {d: grams(t) for d, t in docs}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]


def check_classes(rows, ids, links):
    n, want = Counter(x for pair in links for x in pair), roots(ids, links)
    assert {r[0]: (r[1], r[2]) for r in rows} == {d: (want[d], n[d]) for d in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (7, 7), (20, 21)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), spark, "t").collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long"), spark, "t").count() == 0


def test_release_removes_staged_tables(spark):
    held = common.stage(spark.range(3), "t")
    folder = held.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert held.count() == 3 and os.path.isdir(folder)
    common.release(spark)
    assert not os.path.exists(folder)


def family(seed, size, words=60, changes=3):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}_{i}" for i in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for at in rng.integers(0, words, changes):
            w[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_links_and_classes(spark, block):
    texts = [t for s in range(6) for t in family(s, 12, changes=1 + s % 3)] + ["short one"] * 3 + ["short two", "Short  ONE"]
    docs = list(enumerate(texts)) + table("documents", "doc_id + 1000, text")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard_join.jaccard_join(df, block=block).collect()
    check_classes(rows, [d for d, _ in docs], links_by_brute_force(docs))


def test_shingle_classes_on_odd_rows(spark):
    docs = odd_documents(spark)
    r = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str)
    assert r == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (4, 4, 1), (5, 5, 0), (None, None, 0)], key=str)
    assert jaccard_join.jaccard_join(empty(docs)).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["1", "2", "3", "4", "5", "None"]


@pytest.mark.parametrize("room", [300, 1_000_000])
def test_size_classes_lose_no_link(spark, room):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[: int(k)]) for k in rng.integers(40, 400, 60)] + [" ".join(base[:k]) for k in (104, 84, 129, 5, 6, 7)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, got = links_by_brute_force(docs), jaccard_join.jaccard_join(df, bands=200, per_band=4, room=room, block=7).collect()
    check_classes(got, [d for d, _ in docs], want)


def test_rows_that_share_an_id(spark):
    a, b = (family(i, 3, words=200, changes=1) for i in (1, 2))
    docs = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (3, b[1]), (4, a[2]), (0, b[2])]
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([(1, 2, 1), (1, 3, 0), (2, 2, 1), (3, 3, 0), (3, 3, 0), (4, 2, 1), (0, 3, 0)])
    kept = jaccard_join.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a[0]), (0, b[2])])
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (0, [0.01, 1.0], 1)]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.vector_dedup(vectors_frame(spark, rows)).collect())
    assert found == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_shared_passages_alone_are_no_link(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(k, passage + " " + " ".join(f"d{k}_{i}" for i in range(60))) for k in range(40)]
    assert {r.n_links for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0}


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def vector_links(rows, t=0.93):
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    return [(a, b) for a, x, la in ok for b, y, lb in ok if a < b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= t]


@pytest.mark.parametrize("block", [8, 2048])
def test_vector_links(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.05 + 0.25 * (i % 3))).astype(np.float32).tolist(), i % 2 if i % 17 else None) for i in range(160)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [float("inf")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, [1.0, 2.0], 1), (306, [1.0, 2.0], 1), (307, [], 0)]
    got = vector_dedup.vector_dedup(vectors_frame(spark, rows), block=block).collect()
    check_classes([(r.vec_id, r.component_id, r.n_links) for r in got], [r[0] for r in rows], vector_links(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_links_on_empty_and_repeated_rows(spark):
    df = vectors_frame(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])
    assert vector_dedup.vector_dedup(empty(df)).count() == 0
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in vector_dedup.vector_dedup(df).collect()) == [("1", 1, True), ("1", 1, True), ("None", 0, False)]


@pytest.mark.parametrize("dim, spread, t", [(16, 0.3, 0.93), (8, 1.0, 0.99), (1, 1.0, 0.93)])
def test_vectors_travel_once_a_block_or_by_fewer_cells(spark, monkeypatch, dim, spread, t):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, dim))
    rows = [(i, (centres[i % 40] * spread + rng.normal(size=dim) * 0.1).astype(np.float32).tolist(), int(i >= 330)) for i in range(400)]
    sent, kept = [], vector_dedup.unit_keys
    monkeypatch.setattr(vector_dedup, "unit_keys", lambda df: sent.append(kept(df)) or sent[0])
    monkeypatch.setattr(vector_dedup, "TILE", 7)
    for block in (100, 2):
        sent.clear()
        got = vector_dedup.vector_dedup(vectors_frame(spark, rows), threshold=t, block=block).collect()
        check_classes([(r.vec_id, r.component_id, r.n_links) for r in got], [r[0] for r in rows], vector_links(rows, t))
        assert sent[0].count() <= sum(m * math.ceil(m / block) for m in (330, 70))
        # Groups far from each other, for this threshold: cells send less where blocks are small.
        assert t != 0.99 or block > 2 or sent[0].filter("part >= 0").count()


def check_packing(rows, docs, capacity):
    lib = Tokenizer.from_file(BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, text in docs:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(sequences)


def test_packing_of_documents(spark):
    docs = table("documents", "doc_id, text")
    rows = packing.op3_packing(spark, DIR).collect()
    n = check_packing(rows, docs, 1024)
    total = sum(r.length for r in rows)
    assert n <= 1.04 * math.ceil(total / 1024)


def test_packing_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.pack(docs, BPE).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 4], 1024)
    assert sum(r.doc_id == 4 for r in rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(empty(docs), BPE).count() == 0


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(1)
    for n in (1, 7, 200, 5000):
        sizes, counts = np.unique(np.maximum(4, rng.integers(1, 257, n) * 4), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist()))
        made = packing.plan(histogram, 1024)
        held = Counter()
        for p, times in made:
            assert sum(s * a for s, a in p.items()) <= 1024
            for s, a in p.items():
                held[s] += a * times
        assert held == histogram
        if n == 5000:
            assert sum(t for _, t in made) <= 1.01 * sum(s * c for s, c in histogram.items()) / 1024 + 1


def test_knapsack_prices_the_best_pattern():
    value, pattern = packing.price(np.array([3.0, 4.1, 7.0]), np.array([3, 4, 6]), 10)
    assert value == pytest.approx(11.1) and pattern.tolist() == [0, 1, 1]


def nearest(rows, q, top):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    return sorted((float(np.sqrt(((x[q] - y) ** 2).sum())), i) for i, y in x.items() if i != q)[:top]


def test_neighbour_recall(spark):
    rows = [(i, v) for i, v in table("embeddings", "vec_id, embedding")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 25 == 0, leaf=60, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = {q: nearest(rows, q, 10) for q, _ in rows if q % 25 == 0}
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found) and [s for s, _ in found] == pytest.approx([math.dist(np.array(dict(rows)[q], np.float32), np.array(dict(rows)[i], np.float32)) for _, i in found])


def test_neighbours_come_from_original_doubles(spark):
    rows = [(0, [1.0, -0.0]), (1, [1.0 + 1e-8, 0.0]), (2, [1.0, 1e-9]), (3, [2.0, 0.0]), (4, [1e100, 0.0]), (4, [5.0, 0.0]), (5, [1.0, 0.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(rows, F.col("vec_id") == 0).orderBy("rank").collect()]
    want = sorted((float(np.hypot(r.embedding[0] - 1.0, r.embedding[1])), r.vec_id) for r in rows.collect() if r.vec_id)
    assert [i for i, _ in got] == [i for _, i in want] and np.allclose([d for _, d in got], [d for d, _ in want], rtol=1e-12)


def test_descent_runs_at_every_size(spark, monkeypatch):
    calls, true = [], ann.descend
    monkeypatch.setattr(ann, "descend", lambda *a: calls.append(1) or true(*a))
    assert ann.op8_neighbours(spark, DIR).count() and calls


def test_neighbours_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40, 60)]
    odd = [(100, None), (200, [0.0] * 4), (300, [float("nan"), 1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows + odd], "vec_id long, embedding array<float>, node long")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.rank))
    for q in (0, 20, 40):
        assert [i for i, _ in got[q]] == [i for _, i in nearest(rows, q, 10)] and [k for _, k in got[q]] == list(range(1, 11))
    assert set(got) == {0, 20, 40}
    few = df.filter("vec_id < 3")
    assert [r.vec_id for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [i for _, i in nearest(rows[:3], 0, 10)]
    assert ann.search(empty(df), F.col("vec_id") == 0).count() == 0


def katz_by_definition(docs):
    lower = str.maketrans({i: i + 32 for i in range(65, 91)})
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["</s>"] for d, t in docs}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 7 != 2]
    one, two = Counter(w for d in train for w in words[d]), Counter()
    for d in train:
        two.update(zip(["<s>", *words[d]], words[d]))
    d1, d2 = (katz.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in (one, two))
    total, distinct, n1 = sum(one.values()), len(one), Counter(one.values())
    lost = sum((1 - d1[r]) * r * n1[r] for r in range(1, 6))
    after = defaultdict(dict)
    for (v, w), c in two.items():
        after[v][w] = c
    factor = lambda d, c: d[c] if c <= 5 else 1.0
    p1 = lambda w: factor(d1, one[w]) * one[w] / total if one[w] else lost / total

    def p2(v, w):
        seen = after.get(v)
        if not seen:
            return p1(w)
        size = sum(seen.values())
        free = sum((1 - factor(d2, c)) * c for c in seen.values())
        if not free:
            free, size = 1, size + 1
        return factor(d2, seen[w]) * seen[w] / size if w in seen else free / size / (1 - sum(map(p1, seen))) * p1(w)

    out = {}
    for d, t in words.items():
        base = sum(math.log10((one[w] + 1) / (total + distinct + 1)) for w in t)
        out[d] = (d not in train, len(t), sum(one[w] > 0 for w in t), total, base, sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *t], t)))
    for v in list(after)[:5]:  # exactly normalised: all known words and the unknown one
        assert sum(p2(v, w) for w in one) + p2(v, "\0") == pytest.approx(1)
    return out


@pytest.mark.parametrize("chars, words", [(3000, 3_000_000), (10_000_000, 3_000_000), (3000, 200), (30_000, 2000)])
def test_katz_by_definition(spark, chars, words):
    docs = table("documents", "doc_id, text")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = katz.katz_scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, max_chars=chars, words_per_bucket=words).collect()
    want = katz_by_definition(docs)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4] and tuple(r)[5:] == pytest.approx(want[r.doc_id][4:], abs=1e-6)


def test_katz_beats_its_base_on_rows_held_out(spark):
    rows = [r for r in katz.op7_katz(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_katz_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = katz.katz_scores(docs, F.col("doc_id") != 3).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.score for r in katz.katz_scores(docs, F.lit(False)).collect()} == {0.0}
    assert katz.katz_scores(empty(docs), F.lit(True)).count() == 0


def test_pipeline_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.trained(spark, folder)
    good = [(r.doc_id, r.text) for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD]
    first = roots([d for d, _ in good], links_by_brute_force(good))
    kept = [(d, t) for d, t in good if first[d] == d]

    def clean(t):
        merged = []
        for s, e in sorted((s, e) for _, _, e, s in secrets.find(t)):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            t = t[:s] + "[SECRET]" + t[e:]
        return t

    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in kept}
    check_packing(rows, [(d, clean(t)) for d, t in kept], 1024)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("__score", F.lit("kept"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DIR)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
