"""Very long texts, texts made of white space, and columns that clash."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, jaccard, langid, lm_scoring, quality, resampling, toxicity

WORDS = 250_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["the", "of", "and", "einmal", f"w{rng.randrange(5000)}"]) for _ in range(WORDS))
    rows = [(1, long), (2, long), (3, "the end of it and that is all"), (4, "x" * 2_000_000), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), long


def test_long_texts_are_counted_whole(docs):
    table, long = docs
    words = long.split()
    found = {r["doc_id"]: r for r in quality.quality(table).collect()}
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = [False] * WORDS
    for i in range(WORDS - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside[i] = inside[i + 1] = inside[i + 2] = True
    assert (found[1]["n_words"], found[1]["word_chars"], found[1]["n_repeat_words"]) == (WORDS, sum(map(len, words)), sum(inside))
    assert found[4]["n_words"] == 1 and found[4]["word_chars"] == 2_000_000 and found[5]["n_words"] == 0
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(table).collect()}
    shingles = len(set(zip(words, words[1:], words[2:])))
    assert linked == {1: (shingles, 1), 2: (shingles, 1), 3: (6, 3), 4: (1, 4), 5: (0, 5)}
    scored = {r["doc_id"]: r for r in lm_scoring.score_texts(table, share=1, learn=F.col("doc_id") < 4).collect()}
    assert scored[1]["n_tokens"] == WORDS + 1 and scored[1]["score"] == scored[2]["score"] < 0 and scored[4]["n_known"] == 1
    drawn = {r["doc_id"]: r["n_features"] for r in resampling.resample(table, table.filter("doc_id = 3")).collect()}
    assert drawn == {1: WORDS, 2: WORDS, 3: 8, 4: 1, 5: 0}


def test_classifiers_take_long_texts(spark, docs):
    table, _ = docs
    rows = [(i, w * 12, lang, i % 2) for i, (w, lang) in enumerate([("the and of ", "en"), ("der und nicht ", "de")] * 20)]
    known = spark.createDataFrame(rows, "key long, text string, lang string, label long")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, langid.train(known)).collect()}
    assert found[1] == found[3] == "en" and found[5] == "und" and found[4] in ("en", "de")
    model = toxicity.train(known.select("key", "text"), known.select("key", "label"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())


def test_indented_texts_are_encoded_as_by_the_library():
    """Code, tables and runs of every kind of white space; many texts, so that the cache is cleared on the way."""
    ranks = bpe.read_ranks(bpe.RANKS)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    space = lambda: rng.choice([" ", "  ", "    ", "\n    ", "\t", "\n\n", " \n", "  ", "  ", "\x1c ", "\x85"])
    texts = ["".join(space() + f"{rng.choice('abcxyz=|+.')}{rng.randrange(300)}" for _ in range(rng.randint(1, 12))) + rng.choice(["", space()]) for _ in range(20_000)]
    encoder = bpe.Encoder(bpe.MergeReplay(ranks).encode)
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        for text, ids in zip(part, encoder.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.held <= bpe.KEPT_BYTES
    assert all(len(u) <= bpe.LONGEST_KEPT for kept in (encoder.first, encoder.later) for u in kept)
    assert all(" ".join(bpe.units(t)) == t for t in texts)


def test_rows_with_maps_and_clashing_names_pass_the_stages(spark, folder):
    rows = [(1, "some words of a text that is kept", {"a": 1, "b": 2}, "m"), (1, "some words of a text that is kept", {"b": 2, "a": 1}, "m"), (2, "quite another text than the first one", None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, _mark string")
    kept = corpus_pipeline.near_copies(spark, odd, folder)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert sorted(r["_mark"] or "" for r in kept.collect()) == ["", "m"]
