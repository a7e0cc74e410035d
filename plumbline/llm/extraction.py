"""Main text of web pages by boosted trees over DOM nodes and a consistent choice over the tree.

Each node, an element or a run of text, has features of its subtree (text, links, density), its
tag, the words in its attributes and its ancestors', its depth, place and siblings. Boosted trees
give each node's log-odds of holding main text. Decoding then chooses the most likely labelling
in which nothing below a dropped node is kept, by one pass up and one pass down the tree.

Nothing labels the pages, so training pages are made from them: a bounded sample of pages that
mark their article is taken apart into article blocks, menus and other pieces, and laid out anew
in several layouts, with semantic elements or plain ones with the usual class words, with sidebars,
notices, forms and reader comments whose text comes from other pages. Which part a node comes from
is its label. The page's own layout takes part as well.

Defined results: missing html is empty, and a page without main text gives an empty string.
A tag that the end of the page cuts off is dropped. Whole pages are read, whatever their length.
Rows are independent; repeated rows give repeated results. Other columns are ignored. Without a
page that marks its article, tags and attribute words alone decide.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.boosting import Trees, boost
from plumbline.llm.common import slices, table
from plumbline.llm.dom import Page, parse

SLICE_BYTES = 4 << 20
#: Pages that training pages are made from, those with the smallest key hash, and layouts of each.
PAGES, LAYOUTS = 120, 4

GOOD = frozenset("article content main post entry story body text page blog news".split())
BAD = frozenset(
    "nav menu navigation header footer sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent notice alert "
    "comment comments reply replies discussion share social related recommended breadcrumb breadcrumbs form search newsletter subscribe signup login widget popup "
    "modal hidden copyright legal toolbar pagination tags meta byline disqus".split()
)
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
ARTICLE = frozenset("article main".split())
KINDS = ("#text", "p", "div", "section", "ul", "ol", "li", "table", "td", "blockquote", "pre", "body", "figure", "dl", "html", "#page")
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tags)
    parent = np.array(page.parents)
    length = np.array([len(t) for t in page.texts], float)
    links = np.array(page.links, float)
    runs = (length > 0).astype(float)
    marks = np.array([sum(map(t.count, ".,!?;:")) if t else 0 for t in page.texts], float)
    good, bad = np.zeros(n), np.zeros(n)
    semantic, article, head = np.zeros(n), np.zeros(n), np.zeros(n)
    depth, above_good, above_bad, above_sem, above_art = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    children, place = np.zeros(n), np.zeros(n)
    for i in range(n):
        tokens, tag, p = page.tokens[i], page.tags[i], parent[i]
        if tokens:
            good[i], bad[i] = sum(t in GOOD for t in tokens), sum(t in BAD for t in tokens)
        semantic[i], article[i], head[i] = tag in BOILERPLATE, tag in ARTICLE, tag in HEADS
        if p >= 0:
            depth[i] = depth[p] + 1
            above_good[i], above_bad[i] = max(above_good[p], good[p]), max(above_bad[p], bad[p])
            above_sem[i], above_art[i] = max(above_sem[p], semantic[p]), max(above_art[p], article[p])
            place[i] = children[p]
            children[p] += 1
    start = np.cumsum(length) - length
    size, link_size, run_count, mark_count, nodes = length.copy(), links.copy(), runs.copy(), marks.copy(), np.ones(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        link_size[p] += link_size[i]
        run_count[p] += run_count[i]
        mark_count[p] += mark_count[i]
        nodes[p] += nodes[i]
    total = max(1.0, size[0])
    up = np.maximum(parent, 0)
    siblings = children[up]
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    for i in range(1, n):
        p = page.parents[i]
        if p in last:
            before[i], after[last[p]] = size[last[p]], size[i]
        last[p] = i
    kind = np.array([KINDS.index(t) if t in KINDS else -1 for t in page.tags])
    columns = [
        np.log1p(size), size / total, link_size / np.maximum(1, size), size / nodes, size / np.maximum(1, run_count), mark_count / np.maximum(1, size),
        run_count, depth, start / total, (start + size) / total, siblings, place, place / np.maximum(1, siblings), np.log1p(before), np.log1p(after),
        size[up] / total, size / np.maximum(1, size[up]), link_size[up] / np.maximum(1, size[up]), np.log1p(size[up]), good, bad, above_good, above_bad,
        semantic, article, above_sem, above_art, head, (above_bad == 0) & (above_sem == 0) & (bad == 0) & (semantic == 0), np.full(n, link_size[0] / total),
    ]
    return np.stack([*columns, *(kind == k for k in range(len(KINDS)))], 1).astype(np.float32)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The most likely labels in which nothing below a dropped node is kept."""
    n = len(page.tags)
    keep = -np.log1p(np.exp(-np.clip(odds, -30, 30)))
    drop = -np.log1p(np.exp(np.clip(odds, -30, 30)))
    best_keep, all_dropped = keep.tolist(), drop.tolist()
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        best_keep[p] += max(best_keep[i], all_dropped[i])
        all_dropped[p] += all_dropped[i]
    kept = [True] * n  # the page itself is open
    for i in range(1, n):
        kept[i] = kept[page.parents[i]] and best_keep[i] > all_dropped[i]
    return kept


def simple_odds(page: Page) -> np.ndarray:
    """What tags and attribute words alone say."""
    return np.array([-2.0 if tag in BOILERPLATE or any(t in BAD for t in tokens) else 2.0 for tag, tokens in zip(page.tags, page.tokens)])


def main_texts(pages: list[str], trees: Trees | None) -> list[list[str]]:
    """The blocks of main text of each page, in page order."""
    parsed = [parse(source) for source in pages]
    if trees is None:
        odds = [simple_odds(p) for p in parsed]
    else:
        rows = [features(p) for p in parsed]
        odds = np.split(trees.margins(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    return [[t for t, k in zip(p.texts, decode(p, o)) if t and k] for p, o in zip(parsed, odds)]


def pieces(source: str) -> tuple[list[tuple[str, str]], list[str], list[str]] | None:
    """A page's article blocks with their tags, its linked texts and its other texts; None without a marked article."""
    page = parse(source)
    inside, outside = [False] * len(page.tags), [False] * len(page.tags)
    for i, tag in enumerate(page.tags):
        p = page.parents[i]
        inside[i] = tag in ARTICLE or (p >= 0 and inside[p])
        outside[i] = tag in BOILERPLATE or any(t in BAD for t in page.tokens[i]) or (p >= 0 and outside[p])
    blocks, linked, other = [], [], []
    for i, text in enumerate(page.texts):
        if text and inside[i] and not outside[i]:
            tag = page.tags[page.parents[i]]
            blocks.append((tag if tag in HEADS or tag in ("li", "blockquote", "pre") else "p", text))
        elif text:
            (linked if page.links[i] * 2 > len(text) else other).append(text)
    return (blocks, linked, other) if blocks else None


def layout(rng: random.Random, own: tuple, others: list[tuple]) -> str:
    """A page with this article and pieces of other pages; ``data-mark`` says what is article (1) and what isn't (0)."""
    pick = rng.choice
    blocks, linked, other = own
    words = [w for _, t in pick(others)[0] for w in t.split()][:400] or ["more"]
    short = lambda low, high: " ".join(words[(a := rng.randrange(len(words))) : a + rng.randint(low, high)]) or words[0]
    titles = linked or [short(1, 3) for _ in range(4)]
    link_list = lambda: "<ul>" + "".join(f'<li><a href="/x">{escape(t)}</a></li>' for t in (titles if rng.random() < 0.5 else [short(1, 5) for _ in range(rng.randint(3, 9))])) + "</ul>"
    said = lambda low, high: f"<p>{escape(short(low, high))}</p>"

    def part(tags: list[str], names: list[str], body: str) -> str:
        tag = pick([*tags, "div", "div"])
        name = f' {pick(["class", "id"])}="{pick(names)}"' if tag in ("div", "section", "ul") or rng.random() < 0.4 else ""
        return f'<{tag}{name} data-mark="0">{body}</{tag}>'

    menu = lambda: part(["nav"], ["nav", "menu", "main-menu", "navigation", "top-nav"], link_list())
    header = lambda: part(["header"], ["header", "site-header", "page-header", "banner"], f"<p>{escape(short(1, 4))}</p>" + (link_list() if rng.random() < 0.5 else ""))
    footer = lambda: part(["footer"], ["footer", "site-footer", "copyright", "legal"], pick([f"&copy; {escape(short(2, 8))}", said(3, 12), link_list() + said(2, 6)]))
    sidebar = lambda: part(["aside"], ["sidebar", "side", "widget", "related", "recommended-posts"], f"<h3>{escape(short(1, 3))}</h3>" + link_list() + said(8, 40))
    advert = lambda: part(["aside"], ["ad", "ads", "advert", "sponsored", "promo-box", "ad-banner"], pick([escape(short(3, 30)), said(3, 30), escape(pick(other)) if other else said(2, 9)]))
    notice = lambda: part([], ["cookie-notice", "cookie-banner", "consent", "notice", "newsletter", "subscribe"], said(5, 35) + "<button>OK</button>")
    form = lambda: f'<form data-mark="0" action="/s"><label>{escape(short(1, 3))}</label><input name="q"><p>{escape(short(2, 15))}</p><button>{escape(short(1, 1))}</button></form>'
    remarks = lambda: part(["section"], ["comments", "comment-list", "replies", "discussion"], f"<h3>{escape(short(1, 2))}</h3>" + "".join(f'<div class="{pick(["comment", "reply", "item"])}">{said(4, 60)}</div>' for _ in range(rng.randint(1, 6))))
    tags = lambda tag: tag if rng.random() < 0.9 else "div"
    body = ""
    for i, (tag, text) in enumerate(blocks):
        body += f"<{(t := tags(tag))}>{escape(text, quote=False)}</{t}>"
        if rng.random() < 0.05:
            body += pick([advert, sidebar, form, notice])()
    box = pick(['article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', 'div class="article-text"', "div", "section"])
    article = f'<{box} data-mark="1">{body}</{box.split()[0]}>'
    if rng.random() < 0.3:
        article = f'<main data-mark="1">{article}{remarks() if rng.random() < 0.3 else ""}</main>'
    if rng.random() < 0.3:
        article = f'<div class="{pick(["wrapper", "container", "row", "layout"])}" data-mark="1">{sidebar() if rng.random() < 0.5 else ""}{article}{sidebar() if rng.random() < 0.5 else ""}</div>'
    front = [f() for f in (notice, header, menu, advert, form) if rng.random() < 0.45]
    back = [f() for f in (remarks, sidebar, advert, form, notice, footer) if rng.random() < 0.4]
    return f"<html><body>{''.join(front)}{article}{''.join(back)}</body></html>"


def examples(sources: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the nodes of all training pages."""
    rng = random.Random(17)
    taken = [p for p in map(pieces, sources) if p]
    x, y, w = [np.empty((0, 0))], [], []
    for own, source in zip(taken, (s for s in sources if pieces(s))):
        for k in range(LAYOUTS + 1):
            page = parse(layout(rng, own, taken) if k else source)
            label = np.ones(len(page.tags))
            for i in range(1, len(page.tags)):
                p = page.parents[i]
                if k:
                    label[i] = float(page.marks[i]) if page.marks[i] is not None else label[p]
                else:
                    dropped = page.tags[i] in BOILERPLATE or any(t in BAD for t in page.tokens[i])
                    label[i] = label[p] and not dropped
            x.append(features(page))
            y.append(label)
            w.append(np.full(len(label), 1 / np.sqrt(len(label))))
    if not y:
        return np.empty((0, 0)), np.empty(0), np.empty(0)
    w = np.concatenate(w)
    return np.concatenate(x[1:]), np.concatenate(y), w / w.mean()


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> Trees | None:
    """Trees from a bounded sample of the pages; None if no page of it marks its article."""
    # Keys first, so that only the chosen pages' html moves.
    chosen = pages.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct().orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(PAGES)
    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).filter("html IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("html").alias("html"))
    x, y, w = examples([r["html"] for r in sorted(rows.collect(), key=lambda r: str(r["key"]))])
    return boost(x, y, w) if len(set(y.tolist())) == 2 else None


def extract(pages: DataFrame, trees: Trees | None, keep: list[str], html: str = "html") -> DataFrame:
    """The columns in ``keep`` and ``blocks``, the page's blocks of main text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html", SLICE_BYTES):
            found = main_texts([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:-1], "blocks"])

    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", blocks array<string>")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, train(pages), ["page_id", "url"]).withColumn("text", F.array_join("blocks", " "))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
