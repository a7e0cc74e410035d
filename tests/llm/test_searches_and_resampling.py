"""Operators 11 to 13 on hostile rows, against their SQL and brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import hard_negatives, pivots, resampling, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, id long, part int, chunk string, codes array<int>"


def vectors(spark, copies=1):
    """Clusters, exact copies, ties, repeated rows, other lengths and everything that takes no part."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8)) / 3
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 8)) * 0.02, np.repeat(base[:3], 30, 0), rng.integers(-1, 2, (60, 8)) / 4])
    rows = [(int(i) * 5, v.astype(np.float32).tolist(), int(i % 3) + 7) for i, v in enumerate(x)]
    rows += rows[:4] + [(100, rows[3][1], 8), (-100, rows[5][1], 9), (700, rows[7][1], 0)]
    rows += [(50, [0.5, -0.25], 8), (2000, [], 7), (3000, [0.0] * 8, 7), (4000, [0.125] * 12, 7), (7007, rows[1][1], 9)]
    rows += [(900, None, 1), (1000, [float("nan")] * 8, 1), (1100, [None] * 8, 1), (1200, [float("inf")] * 8, 1), (None, rows[0][1], 7), (1300, rows[0][1], None)]
    return spark.createDataFrame([(*r, 1, 2, "x", [3]) for r in rows], VECTORS)


def by_sql(rows, text):
    db = duckdb.connect()
    db.register("embeddings", rows.select("vec_id", "embedding", "label").toArrow())
    result = db.execute(text)
    names = [d[0] for d in result.description]
    return sorted(names), sorted(tuple(r[names.index(n)] for n in sorted(names)) for r in result.fetchall())


def got(df):
    names = sorted(df.columns)
    return names, sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture
def small_parts(monkeypatch):
    """So that a few hundred rows have many parts, blocks, chunks and rounds."""
    monkeypatch.setattr(pivots, "ROWS_PER_PIVOT", 20)
    monkeypatch.setattr(pivots, "ANNULI", 4)
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    monkeypatch.setattr(hard_negatives, "FANOUT", 3)
    monkeypatch.setattr(hard_negatives, "LEAVES", 81)
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "CHUNK", 3)


def test_top_products_of_hostile_rows(spark, small_parts):
    rows = vectors(spark)
    assert got(pivots.top_products(rows)) == by_sql(rows, pivots.pivot_sql())
    assert got(pivots.top_products(rows, k=2, every=7)) == by_sql(rows, pivots.pivot_sql(2, 7))
    assert pivots.top_products(rows.limit(0)).collect() == []
    lone = rows.filter("vec_id = 3000")
    assert pivots.top_products(lone).collect() == []


def test_one_part_gives_the_same(spark):
    rows = vectors(spark)
    assert got(pivots.top_products(rows)) == by_sql(rows, pivots.pivot_sql())


def test_hard_negatives_of_hostile_rows(spark, small_parts):
    rows = vectors(spark)
    assert got(hard_negatives.hard_negatives(hard_negatives.shifted(rows))) == by_sql(rows, hard_negatives.negatives_sql())
    assert hard_negatives.hard_negatives(rows.limit(0)).collect() == []


def test_hard_negatives_by_plain_loops(spark, small_parts):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(300, 4)) / 2, rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    codes = [[math.floor(256 * c) for c in v] for v in x]
    score = lambda a, b: sum(p * q for p, q in zip(codes[a], codes[b]))
    expected = []
    for a in range(0, 300, 50):
        ordered = sorted((b for b in range(300) if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in ordered if labels[b] == labels[a]][:2]:
            fits = [b for b in ordered if labels[b] != labels[a] and 60 * score(a, p) <= 100 * score(a, b) <= 100 * score(a, p)]
            expected += [(a, n, score(a, n), p, score(a, p), r + 1) for r, n in enumerate(fits[:4])]
    out = hard_negatives.hard_negatives(rows, every=50, positives=2, negatives=4, low_percent=60)
    assert got(out)[1] == sorted(expected) and len(expected) > 20


@pytest.mark.parametrize("index", ["annuli", "tree"])
def test_bounds_hold_and_exclude(spark, index, monkeypatch):
    """No vector lies outside its part's bounds, and clustered vectors let most parts go."""
    monkeypatch.setattr(hard_negatives, "LEAF", 10)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-300, 300, (12, 6)), 25, 0) + rng.integers(-3, 4, (300, 6))
    space = vector_search.Space(float((x**2).sum(1).max()))
    if index == "annuli":
        made = pivots.Annuli(x[space.chosen(x, 12)], space, 4)
        made.edges = np.tile(np.linspace(1, 20, 3), (12, 1))
        part, distance = made.place(x, False)
        made.parts = np.unique(part)
        made.lows, made.highs = (np.array([f(distance[part == p]) for p in made.parts]) for f in (np.min, np.max))
    else:
        made = hard_negatives.Tree(x, 300, space)
        table = spark.createDataFrame([(v.tolist(),) for v in x], "codes array<long>").repartition(3)
        hard_negatives.ranged(table, made)
        part, _ = made.place(x, False)
        made.parts = np.unique(part)
    near, far = made.bounds(x)
    true = space.asked(x, x)
    place = np.searchsorted(made.parts, part)
    assert (near[:, place] <= true + 1e-3).all() and (far[:, place] >= true - 1e-3).all()
    fifth = np.sort(true, 1)[:, 5]
    assert (near <= fifth[:, None]).mean() < 0.6


def test_large_integers_stay_exact():
    a = np.array([[2**30 + 1, -3], [2**30, 5]])
    assert vector_search.scores(a, a).tolist() == [[(2**30 + 1) ** 2 + 9, (2**30 + 1) * 2**30 - 15], [(2**30 + 1) * 2**30 - 15, 2**60 + 25]]
    with pytest.raises(ValueError, match="64-bit"):
        vector_search.scores(a * 2**30, a * 2**30)
    assert vector_search.matrix(pa.array([[1], [], [2, 3]], pa.list_(pa.int64()))).tolist() == [[1, 0], [0, 0], [2, 3]]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, target, ngrams=1, buckets=10_000, percent=10, least=20):
    def features(text):
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for i, (key, text) in enumerate(docs):
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least, i])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {r[5]: n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[5])) for r in out), key=repr)


def resampled(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_resampling_equals_plain_python(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    out = resampling.op13_importance_resampling(spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert resampled(out) == plain_resample(docs, target)


HOSTILE = [
    (1, "The Cat AND the dog, don't 12 stop É漢字 \x00x\x7fy 😀 Kİ " * 9),
    (2, ""),
    (3, None),
    (4, " .,;"),
    (5, "w" * 70 + " 0 " * 40),
    (5, "other words of the same id " * 8),
    (None, "no id but a good number of words " * 5),
    (8, "long " * 60_000),
    (9, "x" * 30_000),
    *[(6, "a row that is often repeated " * 6)] * 2500,
    *[(i, "many rows that tie in weight " * 4) for i in range(100, 200)],
]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_resampling_of_hostile_rows(spark, monkeypatch, ngrams):
    monkeypatch.setattr(resampling, "PIECE", 1000)  # texts are cut for the library
    target = ["the good dog stops", None, "a tie of words"]
    docs = spark.createDataFrame([(*r, 1, "s", 0, [1]) for r in HOSTILE], "doc_id long, text string, weight int, score string, rank int, buckets array<int>")
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    assert resampled(resampling.resample(docs, texts, ngrams=ngrams)) == plain_resample(HOSTILE, target, ngrams)
    assert resampled(resampling.resample(docs, texts.limit(0), percent=50, least_words=3)) == plain_resample(HOSTILE, [], 1, percent=50, least=3)
    assert resampling.resample(docs.limit(0), texts).collect() == []
