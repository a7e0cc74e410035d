"""The two text classifiers against dictionary versions of what they count and add up."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pytest

from plumbline.llm import langid, ngrams, toxicity

FACTOR, MASK = int(ngrams.FACTOR), (1 << 32) - 1


def plain_buckets(text, orders, bits):
    """Buckets of all n-grams of a text, one character after the other."""
    codes, out = [ord(c) for c in " " + " ".join(text.lower().split()) + " "], []
    for i in range(len(codes)):
        h = 0
        for n in range(1, max(orders) + 1):
            if i + n > len(codes):
                break
            h = (h + codes[i + n - 1]) * FACTOR & MASK
            h ^= h >> 15
            if n in orders:
                out.append((h * FACTOR & MASK) >> 32 - bits)
    return out


TEXTS = ["The CAT sat", "", "  \n ", "a", "Été à l'île 漢字 😀", "x" * 40, "der hund und die katze " * 30]


@pytest.mark.parametrize("at_once", [7, 1 << 19])
def test_buckets(monkeypatch, at_once):
    monkeypatch.setattr(ngrams, "CHARS_AT_ONCE", at_once)
    found = collections.defaultdict(list)
    grams = ngrams.Grams(TEXTS, (1, 3, 5), 14)
    for start, bucket in grams:
        inside = np.flatnonzero(bucket < 1 << 14)
        for text, b in zip(grams.owners(start + inside).tolist(), bucket[inside].tolist()):
            found[text].append(b)
    for i, text in enumerate(TEXTS):
        assert sorted(found[i]) == sorted(plain_buckets(text, (1, 3, 5), 14))


def test_shares_and_votes_of_languages(spark):
    shares = langid.frequencies(TEXTS)
    for text, share in zip(TEXTS, shares):
        counted = collections.Counter(plain_buckets(text, langid.ORDERS, langid.BITS))
        total = sum(counted.values())
        assert np.allclose(share, [counted[b] / total for b in range(1 << langid.BITS)], atol=1e-7)
    words = {"en": "the of and that with", "de": "der und nicht eine auf", "nl": "het een van niet ook", "fr": "les des une dans pour", "eo": "la kaj estas ne oni"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=9)), lang) for i, lang in enumerate(list(words) * 25)]
    model = langid.train(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert sorted(map(sorted, model.families)) == [["de", "en", "nl"], ["eo"], ["fr"]] and len(model.pairs) == 3
    asked = [*TEXTS, *(r[1] for r in rows[:40]), "the der het une"]
    for text, language, score in zip(asked, *model.predict(asked)):
        if not any(c.isalpha() for c in text):
            assert (language, score) == ("und", 0.0)
            continue
        counted = collections.Counter(plain_buckets(text, langid.ORDERS, langid.BITS))
        total = sum(counted.values())
        margin = model.weights[-1].astype(float) + sum(n / total * model.weights[b].astype(float) for b, n in counted.items())
        n = len(model.families)
        family = model.families[int(np.argmax(margin[:n]))]
        wins, sums = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
        for (a, b), m in zip(model.pairs, margin[n:]):
            if a in wins:
                wins[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        expected = sorted(family, key=lambda x: (-wins[x], -sums[x], x))[0]
        assert language == expected and 0 <= score <= 1


def test_equal_wins_go_to_the_first_name():
    model = langid.Model([["de", "en", "nl"]], [("de", "en"), ("de", "nl"), ("en", "nl")], np.zeros((1, 4)))
    flat = np.array([1.0, 0.0, 0.0, 0.0])
    assert model.choose(flat, np.full(4, 0.5))[0] == "de"
    circle = np.array([1.0, 1.0, -1.0, 1.0])  # each wins once
    assert model.choose(circle, np.full(4, 0.5))[0] == "de"


def test_counts_ratios_and_score_of_toxicity(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("you are kind and bright today".split(), k=12)) + (" idiot fool" * (i % 3) if i % 4 == 0 else " friend")) for i in range(120)]
    labels = {i: int(i % 4 == 0) for i in range(0, 120, 2)}
    rows = spark.createDataFrame(docs, "key long, text string")
    marks = spark.createDataFrame(list(labels.items()), "key long, label long")
    counted = {y: collections.Counter() for y in (0, 1)}
    for i, text in docs:
        if i in labels:
            counted[labels[i]].update(plain_buckets(text, toxicity.ORDERS, toxicity.BITS))
    found = toxicity.bucket_counts(rows.join(marks, "key")).collect()
    assert {r["bucket"]: (r["clean"], r["toxic"]) for r in found} == {b: (counted[0][b], counted[1][b]) for b in counted[0] | counted[1]}
    model = toxicity.train(rows, marks, kept_buckets=300)
    kept = np.flatnonzero(model.weights)
    assert 0 < len(kept) <= 300 and set(kept.tolist()) <= set(counted[0] | counted[1])
    # The buckets kept say most about the label by the likelihood-ratio statistic.
    n = {y: sum(c.values()) for y, c in counted.items()}

    def statistic(b):
        seen, total = {y: counted[y][b] for y in (0, 1)}, n[0] + n[1]
        both, out = seen[0] + seen[1], 0.0
        for y in (0, 1):
            for count, expected in ((seen[y], both * n[y] / total), (n[y] - seen[y], (total - both) * n[y] / total)):
                out += count * math.log(count / expected) if count else 0.0
        return out

    best = sorted(counted[0] | counted[1], key=lambda b: (-statistic(b), b))[:300]
    assert set(kept.tolist()) <= set(best)
    texts = [t for _, t in docs[:30]] + ["", "You IDIOT"]
    for text, score in zip(texts, model.scores(texts)):
        margin = model.intercept + sum(model.weights[b] for b in set(plain_buckets(text, toxicity.ORDERS, toxicity.BITS)))
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_regression_holds_little_besides_its_columns():
    """The fit on sparse rows, some at a time, equals the one on a whole matrix; what it holds doesn't grow with the rows."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 400, 6000)
    lengths[[3, -1]] = 0
    column = np.concatenate([rng.choice(2000, k, replace=False) for k in lengths]).astype(np.int32)
    label, value = (rng.random(6000) < 0.3).astype(float), rng.standard_normal(2000)
    tracemalloc.start()
    weights, intercept = toxicity.logistic(np.cumsum(lengths), value, column, label, 2000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * toxicity.PLACES_AT_ONCE + 2_000_000 < 32 * len(column)
    x = np.zeros((6000, 2000))
    x[np.repeat(np.arange(6000), lengths), column] = value[column]
    step = 1.0 / (0.25 * max(1.0, float(np.percentile((x * x).sum(1), 99))) + toxicity.PENALTY)
    bias = old_bias = float(np.log((label.sum() + 1) / (6000 - label.sum() + 1)))
    w = old = np.zeros(2000)
    for i in range(400):
        v, c = w + i / (i + 3) * (w - old), bias + i / (i + 3) * (bias - old_bias)
        error = 1 / (1 + np.exp(-np.clip(x @ v + c, -40, 40))) - label
        old, old_bias = w, bias
        w, bias = v - step * (x.T @ error / 6000 * 20 + toxicity.PENALTY * v), c - step * error.mean() * 20
    assert np.allclose(weights, w, atol=1e-9) and abs(intercept - bias) < 1e-9


@pytest.mark.parametrize("marks", [1, 5_000, 1 << 20])
def test_pairs_of_texts_and_buckets_need_no_sort(monkeypatch, marks):
    """However many texts are marked at a time: each wanted bucket of a text once, in order."""
    monkeypatch.setattr(toxicity, "MARKS", marks)
    wanted = np.zeros((1 << toxicity.BITS) + 1, bool)
    wanted[np.random.default_rng(3).choice(1 << toxicity.BITS, 1 << toxicity.BITS - 1, replace=False)] = True
    monkeypatch.setattr(np, "unique", lambda *_, **__: pytest.fail("sorted"))
    batch = [*TEXTS, "ab" * 700, "the cat sat the cat sat"]
    owner, bucket = toxicity.present(batch, wanted)
    plain = [(i, b) for i, text in enumerate(batch) for b in sorted(set(plain_buckets(text, toxicity.ORDERS, toxicity.BITS))) if wanted[b]]
    assert list(zip(owner.tolist(), bucket.tolist())) == plain
    assert [len(x) for x in toxicity.present([], wanted)] == [0, 0]
