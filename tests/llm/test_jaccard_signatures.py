"""Signatures of the Jaccard join: unlike sets don't meet, and no link is lost at the limit."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.llm import jaccard


def joined(spark, texts: list[str], percent: int) -> dict[int, int]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(rows, words=1, percent=percent).collect()}


def by_brute_force(texts: list[str], percent: int) -> dict[int, int]:
    sets = [set(t.split()) for t in texts]
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in range(len(texts))}


def test_unlike_texts_do_not_meet(spark, monkeypatch):
    """Empty parts alone brought unlike sets of near sizes together, with the square of their number."""
    rng, met = random.Random(3), []
    texts = [" ".join(f"{i}x{k}" for k in range(rng.randint(40, 90))) for i in range(800)]
    plain = jaccard.Sets.in_blocks
    monkeypatch.setattr(jaccard.Sets, "in_blocks", lambda self, places: met.append(places.count()) or plain(self, places))
    assert joined(spark, texts, 80) == {i: i for i in range(800)}
    assert sum(met) <= 20


@pytest.mark.parametrize("percent", [80, 90])
def test_links_at_the_limit_are_found(spark, percent):
    """Pairs that differ as much as a link allows or by one word more, some with a passage that most texts hold."""
    rng, texts = random.Random(percent), []
    passage = [f"p{k}" for k in range(25)]
    for i in range(220):
        n = rng.randint(1, 60) if i % 3 else rng.randint(60, 400)
        words = [f"{i}x{k}" for k in range(n)] + (passage if i % 2 and n > 30 else [])
        n = len(words)
        own = words[n - rng.randint(0, n * (100 - percent) // (2 * percent) + 1) :]  # words that only the first has
        kept = words[: n - len(own)]
        more = max(0, (100 * len(kept) - percent * n) // percent) + rng.randint(0, 1)  # and only the second
        rng.shuffle(words)
        texts += [" ".join(words), " ".join(kept + [f"{i}y{k}" for k in range(more)])]
    assert joined(spark, texts, percent) == by_brute_force(texts, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_more_signatures_than_one_may_leave_out(percent):
    """Whatever the differences: the signatures that both have outnumber those that either may leave out."""
    rng, sizes = np.random.default_rng(percent), jaccard.classes(percent)
    for _ in range(1500):
        a = rng.integers(0, 1 << 63, rng.integers(2, 300), dtype=np.uint64)
        out = rng.integers(0, len(a) * (100 - percent) // percent + 1)
        b = a[out:]
        b = np.concatenate([b, rng.integers(0, 1 << 63, max(0, (100 * len(b) - percent * len(a)) // percent), dtype=np.uint64)])
        if not len(b) or not out and len(a) == len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        (x, spare), (y, other) = jaccard.signatures(np.unique(a), percent, sizes), jaccard.signatures(np.unique(b), percent, sizes)
        assert len(np.intersect1d(x, y)) > max(spare, other)


def test_one_pass_names_and_signs_sets(spark):
    """Sets are those of single texts whatever lies beside them, and each distinct one is signed in the same pass."""
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One two", "a b c", "a b c a b c a"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(150)] * 2
    sets = jaccard.gram_sets(texts, 3)
    assert [s.tolist() for s in sets] == [jaccard.gram_sets([t], 3)[0].tolist() for t in texts]
    for text, s in zip(texts, sets):
        words = (text or "").lower().split()
        plain = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        assert len(s) == len(plain) and (np.diff(s) > 0).all()
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, copy long, text string").coalesce(1)
    found = jaccard.named_and_signed(rows, 3, 80, 4).collect()
    named = {r["id"]: (r["node"], r["n"]) for r in found if r["part"] is None}
    assert named == {i: (jaccard.name_of(s), len(s)) for i, s in enumerate(sets)}
    signed, sizes = {}, jaccard.classes(80)
    for r in (r for r in found if r["part"] is not None):
        nodes, keys = np.frombuffer(r["nodes"], np.int64), jaccard.unpacked(r["keys"])
        for key, place in zip(keys.tolist(), np.frombuffer(r["places"], "<u2").tolist()):
            signed.setdefault(int(nodes[place]), []).append((r["part"], key))
    for s in filter(len, sets):
        keys, _ = jaccard.signatures(s, 80, sizes)
        assert sorted(signed.get(jaccard.name_of(s), [])) == sorted((int(k >> np.uint64(32)) % 4, int(k) & 0xFFFFFFFF) for k in keys)
