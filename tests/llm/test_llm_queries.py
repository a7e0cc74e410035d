"""Every operator on hostile rows, and against brute force, exact round trips or its SQL."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import attention, bpe, dom, extraction, jaccard, langid, lm_scoring, near_vectors, packing, quality, sharding, toxicity
from plumbline.llm.queries import ORACLES, QUERIES
from plumbline.llm.trie import Trie

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, label int"
ROWS = [
    (1, "The cat and the dog.\nThe cat and the dog.\nAnd so on", "en", "a", 1, "x", 1, 0),
    (2, "", None, None, None, None, None, None),
    (3, None, "fr", "a", 1, "x", 1, 0),
    (4, " \n\t ", "de", "a", 1, "x", 1, 1),
    (5, "wort " * 3000, "de", "a", 1, "x", 1, 1),
    (6, "der hund und die katze sind nicht hier", "de", None, 1, "x", 1, 1),
    (6, "der hund und die katze sind nicht hier", "de", None, 1, "x", 1, 1),
    (None, "der hund und die katze sind nicht hier", None, "b", 1, "x", 1, 1),
    (8, "漢字 😀  é \x00 x", "en", "b", 2, "y", 2, None),
]


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sql(rows, text):
    db = duckdb.connect()
    table = rows.toArrow()
    db.register("documents", table)
    result = db.execute(text)
    names = [d[0] for d in result.description]
    return sorted(names), sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in result.fetchall()), key=repr)


def got(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in result.fetchall()), key=repr)
    assert got(QUERIES[name](spark, folder)) == (sorted(names), expected)


@pytest.mark.parametrize("limit", [1, 40, 100, 20_000])
def test_shards_equal_sql_for_small_limits(hostile, limit):
    names, rows = got(sharding.assign_shards(hostile, limit=limit))
    assert (names, rows) == sql(hostile, sharding.shard_sql(limit))
    at = names.index
    assert all(r[at("shard_bytes")] <= limit or r[at("shard_rows")] == 1 for r in rows)


def test_quality_of_hostile_rows(hostile, empty):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bar_lines", "n_stop_words", "base_failed", "kept"]
    assert got(quality.quality(hostile).select(columns)) == sql(hostile, quality.quality_sql())
    assert quality.quality(empty).count() == 0


def test_toxicity_learns_and_scores_everything(spark, hostile, empty):
    docs = spark.createDataFrame([(i, "a nice day " * (1 + i % 3) + ("you idiot" if i % 4 == 0 else "my friend")) for i in range(200)], "key long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(None, 1), (3, None)], "key long, label long")
    model = toxicity.train(docs, labels)
    out = {r["key"]: r["score"] for r in toxicity.score(docs, model, key="key").collect()}
    assert all((out[i] > 0.5) == (i % 4 == 0) for i in range(200))
    assert len(toxicity.score(hostile, model).collect()) == len(ROWS)
    nothing = toxicity.train(docs.limit(0), labels)
    assert {r["score"] < 0.5 for r in toxicity.score(hostile, nothing).collect()} == {True}
    assert toxicity.score(empty, model).count() == 0


def test_extraction_of_unseen_layouts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    own = "<html><nav><ul>{}</ul></nav><article><h1>{}</h1>{}</article><footer>&copy; {}</footer></html>"
    pages = [own.format("".join(f"<li><a href=x>{word()}</a></li>" for _ in range(5)), line(4), "".join(f"<p>{line(30)}</p>" for _ in range(4)), line(3)) for _ in range(40)]
    trees = extraction.boost(*extraction.examples(pages[:30]))
    taken = [extraction.pieces(p) for p in pages[30:]]
    right = 0
    for own_pieces in taken * 3:
        source = extraction.layout(rng, own_pieces, taken)
        page = dom.parse(source)
        label = [True] * len(page.tags)
        for i in range(1, len(page.tags)):
            label[i] = page.marks[i] == "1" if page.marks[i] is not None else label[page.parents[i]]
        right += extraction.main_texts([source], trees)[0] == [t for t, k in zip(page.texts, label) if t and k]
    assert right >= 27
    found = extraction.main_texts(["", "<p>A &amp; b<br>c<scr", "no markup at all", "<article>x" + "<div>" * 3000 + "y"], None)
    assert found == [[], ["A & b", "c"], ["no markup at all"], ["x", "y"]]


def runs(source):
    page = dom.parse(source)
    return [t for tag, t in zip(page.tags, page.texts) if tag == "#text"]


def test_stray_markup_loses_no_text():
    assert runs("<html><head><title>T</title><meta charset=x><body><article><p>Lost part one.</p><header>h</header><p>Body text.</p></article>") == ["Lost part one.", "h", "Body text."]
    assert runs("<p data-x=don't>It is here.</p><p>and it's there.</p>") == ["It is here.", "and it's there."]
    assert runs("<div class='a \"b' id=\"c'd\" =x y = z >one</div><p a=\"1>2\">two</p>3 < 4 <5> <") == ["one", "two", "3 < 4 <5> <"]
    assert runs("<select><option>a<option>b</select>kept<svg><title>no</title></svg><!-- > --><!-->x<?php a ?>y") == ["keptxy"]
    assert runs("<p>before<p title=\"never closed>after") == ["before"]
    assert runs("<style>p{}</styles>x</style >seen<script>a</scripty>b</script>end") == ["seenend"]
    page = dom.parse("<div CLASS=Main class=other hidden><p>t")
    assert page.tokens[1] == ("main", "hidden")
    began = time.perf_counter()
    assert runs("a <b " * 200_000 + '"') == ["a"]
    assert len(runs("<option>x" * 50_000)) == 1 and len(runs("<!x" * 200_000)) == 0
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("seed", range(30))
def test_attributes_by_both_readers(seed):
    rng = random.Random(seed)
    body = "".join(rng.choice([" ", "a", "=", "b='x'", 'c="y"', "/", ">", "'", '"', "d=e", "\n"]) for _ in range(12)) + '">'
    quick, plain = dom.tag_rest(body, 0), dom.attributes(body, 0)
    assert quick == plain


def test_decoding_is_best_of_all_labellings():
    """Against every choice of kept nodes in small trees, in which no kept node lies below a dropped one."""
    rng = np.random.default_rng(7)
    for source in ("<div><p>a</p><section><p>b</p>c</section></div>", "<ul><li>a<li>b</ul><p>c</p>", "x<div>y</div>"):
        page = dom.parse(source)
        n = len(page.tags)
        for _ in range(20):
            margin = rng.normal(0, 2, n)
            best = -np.inf
            for bits in range(1 << (n - 1)):
                kept = [True, *((bits >> i & 1) == 1 for i in range(n - 1))]
                if all(kept[page.parents[i]] for i in range(1, n) if kept[i]):
                    best = max(best, sum(m if k else 0.0 for m, k in zip(margin, kept)))
            found = extraction.decode(page, margin)
            assert sum(m if k else 0.0 for m, k in zip(margin, found)) == pytest.approx(best), source


def test_decoding_never_keeps_below_a_dropped_node():
    page = dom.parse("<div><p>a</p><section><p>b</p></section></div>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        kept = extraction.decode(page, rng.normal(0, 3, len(page.tags)))
        assert all(kept[page.parents[i]] for i in range(1, len(kept)) if kept[i])


def test_extraction_query_columns(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>a  b</p></article><footer>z</footer>", 6), (None, "v", "", 7)], "page_id long, url string, html string, blocks int")
    out = {r["page_id"]: r["blocks"] for r in extraction.extract(rows, extraction.train(rows), ["page_id"]).collect()}
    assert out[1] == [] and out[None] == []
    assert extraction.extract(rows.limit(0), None, ["page_id"]).count() == 0


def linked(sets, percent):
    names = sorted(sets)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(names, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in names}


@pytest.mark.parametrize("sent", [jaccard.SENT_PLACES, 0])
def test_jaccard_join_equals_brute_force(spark, hostile, empty, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_PLACES", sent)
    rng = random.Random(7)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([2, 5, 12, 40, 150, 400]))]
        for copy in range(14):
            changed = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                changed[rng.randrange(len(changed))] = f"z{rng.randrange(9999)}"
            texts[base * 100 + copy] = " ".join(changed)
    sets = {k: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for k, w in ((k, t.split()) for k, t in texts.items())}
    expected = linked(sets, 90)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = jaccard.link_documents(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {k: len(s) for k, s in sets.items()}
    ids = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.link_documents(hostile).collect())
    assert ids == [("1", 8, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 0, "4"), ("5", 1, "5"), ("6", 6, "6"), ("6", 6, "6"), ("8", 3, "8"), ("None", 6, "6")]
    assert jaccard.link_documents(empty).count() == 0


def test_trie_finds_what_comparing_finds():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30)).astype(np.uint64)) for _ in range(150)]
    trie = Trie()
    for i, s in enumerate(sets):
        trie.add(i, s)
    for percent in (50, 80, 90):
        for s in sets[:60]:
            plain = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))]
            assert sorted(trie.similar(s, percent)) == plain


def test_packing_is_exact_and_full(spark, hostile, empty):
    added = [(50, "a <|endoftext|> b", 0), (51, "<|endoftext|><|endoftext|>", 0), (52, "x<|endoftext|" + " " * 70_000 + "<|endoftext|>y", 0)]
    docs = hostile.select("doc_id", "text", "node").unionByName(spark.createDataFrame(added, "doc_id long, text string, node long"))
    rows = packing.pack(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in (*ROWS, *added)}
    by_doc = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert by_doc[50].count(50256) == 1 and by_doc[51] == [50256, 50256, 1]
    for r in rows:
        part = by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(by_doc[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(by_doc[r[0]]) for r in (*ROWS, *added))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_least_squares_against_its_conditions():
    rng = np.random.default_rng(5)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6


def test_near_vectors_equal_brute_force(spark, empty):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5]])
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 1), (905, [1.0], 1), (906, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    db.register("embeddings", table.toArrow())
    result = db.execute(near_vectors.near_sql())
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in result.fetchall()), key=repr)
    assert got(near_vectors.near_duplicates(table, shard=20))[1] == expected
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0


def test_unconnected_groups_of_near_vectors_are_linked():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(3, 24)), 200, 0) + rng.normal(size=(600, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, own = near_vectors.Graph(x, near_vectors.heights(np.arange(600))), np.arange(600)
    truth = x @ x.T >= near_vectors.THRESHOLD
    truth[own, own] = False
    for cut in (False, True):
        if cut:  # no link leaves a group
            for links in graph.links:
                links[(links >= 0) & (links // 200 != own[:, None] // 200)] = -1
        found, parts = np.zeros(truth.shape, int), near_vectors.Components(600)
        near_vectors.audited(graph, x, own, lambda a, b: (np.add.at(found, (a, b), 1), parts.add(a, b)))
        assert (found == truth).all()
        assert (parts.tops(own) == own // 200 * 200).all()


def test_stored_graphs_search_alike():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    heights = near_vectors.heights(np.arange(900) * 7919)
    graph = near_vectors.Graph(x, heights)
    links = np.concatenate([level.ravel() for level in graph.links])
    again = near_vectors.Graph.stored(x, heights, links, len(graph.links))
    assert all((a == b).all() for a, b in zip(graph.search(x[:50], 40), again.search(x[:50], 40)))
    nearest = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    found = graph.search(x[:200], 64)[0][:, :10]
    assert (nearest[:, :, None] == found[:, None, :]).any(2).mean() >= 0.9


def test_languages(spark, hostile, empty):
    words = {"en": "the of and that with this from", "de": "der und nicht eine auf sich", "fr": "les des une dans pour avec", "es": "los una por las como para"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang) for i, lang in enumerate(list(words) * 30)]
    model = langid.train(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert langid.UNDETERMINED not in {lang for family in model.families for lang in family}
    predicted = [langid_row["lang_pred"] == lang for langid_row, (_, _, lang) in zip(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), model).collect(), rows)]
    assert sum(predicted) >= 0.95 * len(rows)
    out = langid.identify(hostile, model).collect()
    assert len(out) == len(ROWS) and {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_repeated_ids_fill_no_sample(spark, monkeypatch):
    fitted = {}
    machine, logistic = langid.machine, toxicity.logistic
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 20)
    monkeypatch.setattr(langid, "machine", lambda x, y: (fitted.update(lang=(len(x), len(np.unique(x, axis=0)))), machine(x, y))[1])
    monkeypatch.setattr(toxicity, "ROWS_PER_LABEL", 20)
    monkeypatch.setattr(toxicity, "logistic", lambda row, value, column, label, width: (fitted.update(label=label), logistic(row, value, column, label, width))[1])
    body = [(k, f"{'der hund' if k % 2 else 'the idiot'} {'abcdefghijklmnopqrstuvwxyz'[k // 2]} " * 9, "de" if k % 2 else "en") for k in range(50) for _ in range(30)]
    docs = spark.createDataFrame(body, "key long, text string, lang string")
    langid.train(docs)
    assert fitted["lang"] == (80, 80)  # 20 documents of each language, whole and their openings
    toxicity.train(docs.select("key", "text"), spark.createDataFrame([(k, k % 2) for k in range(50) for _ in range(3)], "key long, label long"))
    assert sorted(fitted["label"]) == [0] * 20 + [1] * 20


def test_replay_equals_the_library(hostile):
    ranks = bpe.read_ranks(bpe.RANKS)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t  aab'sétßñ   15!?.,漢字😀\x1c\x85") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 60)] + ["hello'll  the there's"]
    for text, ids in zip(texts, bpe.replay_encoder(bpe.RANKS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    decoded = bpe.decode(bpe.encode(hostile), ["doc_id"]).collect()
    assert sorted(r["decoded"] for r in decoded) == sorted((r[1] or "").encode() for r in ROWS)


def test_lm_counts_and_probabilities(hostile, empty):
    rows = lm_scoring.score_texts(hostile, share=1).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [0]
    learned = [split(r[1]) for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = collections.Counter(w for words in learned for w in words)
    n, v = sum(c.values()), len(c)
    expected = sorted((len(split(r[1])), sum(c[w] > 0 for w in split(r[1])), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in split(r[1])), 6)) for r in ROWS)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == expected
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] < 0 for r in rows)
    assert lm_scoring.score_texts(empty).count() == 0


def test_chunks_of_files_do_not_follow_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        split = lm_scoring.score_texts(spark.read.parquet(f"{folder}/documents.parquet"), share=10).select("doc_id", "n_known", "base_score")
        one = sorted(split.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["n_known"] for r in one] == [r["n_known"] for r in sorted(lm_scoring.op10_lm_scoring(spark, folder).select("doc_id", "n_known", "base_score").collect())]


def test_words_encoded_side_by_side():
    encoder = lm_scoring.subwords(lm_scoring.RANKS)
    words = ["the", "don't", "x\u00a0", "\u00a0y", "\u2003", "漢字", "a\x1cb", "é\x85", "zz" * 3000, "12ab!?", "😀"] * 3
    flat, many = encoder.encode(words)
    each = [encoder.library.encode_ordinary(" " + w) for w in words]
    assert many.tolist() == [len(x) for x in each] and flat.tolist() == [i for x in each for i in x]
    whole = pa.array(["Ünlü Ä " * 9, "A b\x0bA  ", None, "", " \x1c é\x0cÉ", "ß"])
    found = lm_scoring.Words(whole.slice(1, 4))
    assert [[found.names[i] for i in found.at[found.text == t]] for t in range(4)] == [["a", "b", "a"], [], [], ["\x1c", "é", "É"]]


def test_attention_gradient_and_windows():
    counts, starts = np.arange(30.0), np.arange(30) % 2 == 0
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, 30, 400), np.array([1, 90, 400])
    words = attention.vocabulary(counts, starts)
    model = attention.Model(words, attention.trained(attention.untrained(words), words, ids, ends, 30, 1))
    # Probabilities of all ids add up to one.
    total = np.bincount(words.kind, 10.0 ** words.share.astype(float), attention.CLASSES)
    assert np.allclose(total[np.unique(words.kind)], 1, atol=1e-5)
    # A text's scores don't depend on its neighbours.
    alone = model.token_scores(ids[1:90], np.array([89]))
    assert np.allclose(alone, model.token_scores(ids, ends)[1:90], atol=1e-5)
    units, kinds = rng.integers(0, 30, (3, attention.WINDOW)), rng.integers(0, attention.CLASSES, (3, attention.STRIDE))
    seen, used = np.arange(attention.WINDOW) >= np.array([[0], [10], [attention.WINDOW - 3]]), rng.random((3, attention.STRIDE)) < 0.8
    w = {k: rng.normal(0, 0.3, x.shape) for k, x in model.weights.items()}  # small, so that nothing is clipped
    taken = lambda w: np.take_along_axis(attention.forward(w, units, seen)[0], kinds[:, :, None], 2)[:, :, 0]
    loss = lambda w: -(np.log(taken(w)) * used).sum() / used.sum()
    g = attention.gradient(w, units, seen, kinds, used)
    for name in w:
        moved = {k: x.copy() for k, x in w.items()}
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        moved[name][at] += 1e-5
        assert abs((loss(moved) - loss(w)) / 1e-5 - g[name][at]) < 1e-4


def test_scores_equal_one_id_at_a_time():
    """Against plain sums for every id: attention from it over the ids in view, softmax over classes, share."""
    rng = np.random.default_rng(1)
    ids, ends = rng.integers(0, 40, 210), np.array([5, 6, 138, 210])
    words = attention.vocabulary(rng.random(41) * 9, np.arange(41) % 3 == 0)
    w = {k: x.astype(float) + rng.normal(0, 0.2, x.shape) for k, x in attention.untrained(words).items()}
    found = attention.Model(words, w).token_scores(ids, ends)
    begin = 0
    for end in ends:
        for t in range(begin, end):
            number = (t - begin) // attention.STRIDE
            first = begin + number * attention.STRIDE - (attention.WINDOW - attention.STRIDE)
            view = range(max(begin, first), t + 1)
            unit = lambda s: words.unit[40 if s == begin else ids[s - 1]]  # noqa: E731, B023
            x = {s: w["embed"][unit(s)] + w["place"][s - first] for s in view}
            heat = np.array([np.exp(x[t] @ w["look"] @ x[s]) for s in view])
            h = x[t] + sum(a * x[s] for a, s in zip(heat / heat.sum(), view)) @ w["carry"]
            logits = h @ w["out"] + w["bias"]
            chance = np.exp(logits[words.kind[ids[t]]]) / np.exp(logits).sum()
            assert abs(found[t] - (np.log10(chance) + words.share[ids[t]])) < 1e-4
        begin = end


def test_pipeline_keeps_what_each_stage_should(spark, folder, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([(1, "", None, None, 0), (2, "hello world the cat", None, None, 0), (2, "hello world the cat", None, None, 0), (3, "hello world the cat", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[2, 2, 3], [2, 2, 3], [2]]
    none = empty.select(columns)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0


def test_pipeline_finds_near_copies_by_brute_force(spark, folder):
    """Pairs at Jaccard 0.78, 0.80, 0.85 and 0.92 of 5-word shingles, (n - k) / (n + k)."""
    texts = {}
    for i, (n, k) in enumerate([(89, 11), (90, 10), (74, 6), (96, 4)]):
        words = [f"w{i}x{j}" for j in range(n + 4)]
        texts[10 * i] = " ".join(words)
        texts[10 * i + 1] = " ".join([*words[: n + 4 - k], *(f"z{i}x{j}" for j in range(k))])
    texts |= {90: "a b c", 91: "a b c", 92: "a b d"}
    sets = {d: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in texts.items())}
    shared = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in (0, 10, 20, 30)]
    assert shared == [0.78, 0.8, 0.85, 0.92]
    docs = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, folder).collect()}
    assert kept == set(linked(sets, 80).values()) == {0, 1, 10, 20, 30, 90, 92}


def test_ids_digest_is_little_endian(hostile):
    row = bpe.encode(hostile).filter("doc_id = 1").first()
    assert hashlib.sha256(row["ids"]).hexdigest() and len(row["ids"]) == 4 * row["n_tokens"]
    assert base64.b64encode(row["ids"][3:4]) == b"AA=="


@pytest.mark.parametrize("path", [packing.RANKS, bpe.RANKS])
def test_long_runs_are_encoded_as_by_the_library(path):
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    runs = [unit * n + end for unit in ("a", "=", " ", "\n", "ha", "é", "ab") for n in (1, 2, 3, 7, 64, 1001, 50_000) for end in ("", "x")]
    for text, ids in zip(runs, bpe.replay_encoder(path).encode(runs), strict=True):
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes(), (text[:2], len(text))


def test_packing_takes_white_space_beyond_the_library():
    encoder = packing.token_encoder(packing.RANKS)
    text = "x" + " " * 300_000 + "y"  # replayed, though the library still can
    assert encoder.encode(text) == np.array(encoder.library.encode_ordinary(text), "<u4").tobytes()
    longer = "x" + " " * 1_200_000 + "y"
    assert encoder.library.decode(np.frombuffer(encoder.encode(longer), "<u4").tolist()) == longer


def test_attention_learns_from_all_training_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 40))) for i in range(150)], "doc_id long, text string")
    train = [i for i in range(150) if zlib.crc32(str(i).encode()) % 7 != 2]
    given, learned = [], lm_scoring.learned

    def seen(rows, parts, *rest):
        given.append((rows.count(), parts, sorted(r["part"] for r in rows.select("part").distinct().collect())))
        return learned(rows, parts, *rest)

    monkeypatch.setattr(lm_scoring, "learned", seen)
    whole = lm_scoring.score_texts(docs).collect()
    monkeypatch.setattr(lm_scoring, "FIT_BYTES", 3000)  # several parts a round
    dealt = lm_scoring.score_texts(docs).collect()
    assert given[0][:2] == (len(train), 1)
    assert given[1][0] == len(train) and given[1][1] >= 2 * lm_scoring.ROUNDS and len(given[1][2]) == given[1][1]
    for rows in whole, dealt:
        assert len(rows) == 150 and all(r["score"] < 0 for r in rows)
    few = lm_scoring.score_texts(docs, share=64).collect()
    assert sum(r["score"] for r in whole) > sum(r["score"] for r in few)
