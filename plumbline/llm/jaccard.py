"""Exact n-gram Jaccard join: blocks from partition signatures, links from prefix trees.

A document is the set of its word n-grams' 64-bit hashes in ascending order, the global order of
all tries. Documents with equal sets are one node. Two linked sets differ in at most a ninth of
the smaller one's size (at 90 percent), so when the hash space is cut into more parts than that,
they agree on whole parts: the digest of each part is a signature, and only sets that share one
are compared. Sets of near sizes use the same number of parts; a set that may have a smaller
partner in the next lower class signs there too. A set that fills more parts than it may have
differences shares a filled part with each set it links with, so only filled parts sign. In the few
sets that don't, empty parts count as well, in pairs; there are more parts than needed, so that this
loses nothing. Signatures travel once, packed: of each slice of texts and range of signatures one
value with 32 bits of each in order and the number of its set.
What reads a range of all slices reports only signatures of several sets, and of those that
have the very same sets one. Two signatures taken for one cost a comparison and no more.

A set that fills several parts more than its differences shares that many signatures at least, and
leaves out as many, less one, of those it has: the ones that most sets have, in one order for all. The
last in this order of the signatures that two sets share is then left out by neither. So a passage
that many unlike texts hold brings few of them together.

Of the sets that share a signature the least is the pivot, and each set first meets the least of
its pivots: in blocks of bounded size the sets form a trie that the pivot's set traverses. A signature
whose sets are all connected then needs no more comparisons. The sets of the other signatures, in
clusters that signatures connect, meet in pairs of bounded blocks, trie against asking sets. Blocks
that hold sets of one component only don't meet each other, so a large group of near copies is
compared with what isn't yet part of it and not with itself. No link between components is lost.

Defined results: a text that is missing or has no word has no n-grams, links with nothing and is its
own component; with fewer words than n the whole sequence is the one n-gram. Repeated rows and equal
sets share a component. A row without an id takes part but names no component. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table
from plumbline.llm.components import components
from plumbline.llm.trie import Trie
from plumbline.session import cut_lineage, remove_tables, written_table

NAMED_AND_SIGNED = ["id", "copy", "node", "n", "part", "nodes", "spares", "keys", "places"]
WORDS, PERCENT = 3, 90
SLICE_BYTES = 8 << 20
BLOCK = 128
STORED, ASKS, BOTH = 0, 1, 2
#: Texts cut into n-grams at a time; bytes that a word has at least in most texts, by which signatures are foretold.
TEXTS_AT_ONCE, WORD_BYTES = 64, 4
#: Signatures in a range of them, about; the filter of wanted rows, in bits (the power of two).
RANGE = 2_000_000
FILTER_BITS = 26
#: Places of sets in blocks that are sent to every task (28 bytes each); more are joined by a shuffle.
SENT_PLACES = 500_000
GROWTH = 1.4
#: One more part for so many differences, so that nearly all sets fill more parts than they may have differences.
FILLED = 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct word n-grams, computed for a few texts at a time."""
    out = []
    for first in range(0, len(texts), TEXTS_AT_ONCE):
        found = [t.encode().lower().split() if t else [] for t in texts[first : first + TEXTS_AT_ONCE]]
        ends = np.cumsum([len(w) for w in found])
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, ends[-1])
        every = rolled(h, words)
        for n, end in zip(map(len, found), ends.tolist()):
            if n < words:
                out.append(rolled(h[end - n : end], n))
                continue
            own = every[end - n : end - words + 1]
            own.sort()
            out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n hashes in a row."""
    count = max(0, len(h) - n + 1) if n else 0
    out = np.full(count, n, np.uint64)
    for i in range(n if count else 0):
        out = mixed(out * M1 + h[i : count + i])
    return out


def classes(percent: int, limit: int = 1 << 40) -> list[tuple[int, int, int]]:
    """Lowest size, highest size and number of parts of each class of sizes; none where only equal sets link."""
    out, low = [], 1
    while low < limit:
        high = max(low, int(low * GROWTH))
        differences = high * (100 - percent) // percent
        out.append((low, high, differences + 3 + differences // FILLED if differences else 0))
        low = high + 1
    return out


def signatures(tokens: np.ndarray, percent: int, sizes: list[tuple[int, int, int]]) -> tuple[np.ndarray, int]:
    """The signatures of a set for each class that its smaller partner may lie in, and how many it may leave out."""
    n, out, spare = len(tokens), [np.empty(0, np.uint64)], []
    place, value = (mixed(tokens) >> np.uint64(32)).astype(np.uint32), mixed(tokens * M1)
    for number, (low, high, parts) in enumerate(sizes):
        if low > n:
            break
        # Without differences only equal sets link, and those are one node.
        if 100 * high < percent * n or not parts:
            continue
        part = (place % np.uint32(parts) if parts < 1 << 32 else place % np.uint64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        filled = part[begin].astype(np.uint64)
        sums = np.add.reduceat(value[order], begin)
        salt = np.uint64(number << 48)
        out.append(mixed(sums ^ mixed((filled + salt) * M1)))
        # Each difference changes one part; those of this set that stay are shared.
        differences = n * (100 - percent) // percent if n <= high else (n + high) * (100 - percent) // (100 + percent)
        shared = len(filled) - differences
        # One more is held in reserve: two signatures of a set may be taken for one.
        spare.append(max(0, shared - 2))
        if shared > 0:
            continue
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), filled)
        for i in range(len(empty) - 1):
            out.append(mixed((mixed(empty[i + 1 :] + salt) ^ np.uint64(7)) * M1 + empty[i]))
    return np.concatenate(out), min(spare, default=0)


def name_of(tokens: np.ndarray) -> int | None:
    """The number that stands for a set, none for an empty one."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def packed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def signed(sets: dict[int, np.ndarray], percent: int, sizes: list[tuple[int, int, int]], ranges: int) -> Iterator[tuple]:
    """Of each range of signatures its number, the sets' numbers, what they may leave out, and the packed signatures with the places of their sets."""
    found = [signatures(s, percent, sizes) for s in sets.values()]
    nodes, lists, spare = np.array(list(sets), np.int64), [x for x, _ in found], np.array([x for _, x in found], "<u4")
    if not sum(map(len, lists)):
        return
    key = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists), dtype=np.uint32), [len(x) for x in lists])
    part = (key >> np.uint64(32)) % np.uint64(ranges)
    key = (key & np.uint64(0xFFFFFFFF)) | part << np.uint64(32)
    order = np.argsort(key)
    key, owner, part = key[order].astype(np.uint32), owner[order], part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for i, j in zip(begin, [*begin[1:], len(part)]):
        own, place = np.unique(owner[i:j], return_inverse=True)
        small = "<u2" if len(own) <= 1 << 16 else "<u4"
        yield int(part[i]), nodes[own].tobytes(), spare[own].tobytes(), packed(key[i:j]), place.astype(small).tobytes()


def named_and_signed(docs: DataFrame, words: int, percent: int, ranges: int) -> DataFrame:
    """Rows of two kinds, so that texts are cut into n-grams once.

    Every row's set as ``node``, and its size ``n``; and with a ``part`` the signatures of each slice and range.
    """
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, copy long, node long, n long, part long, nodes binary, spares binary, keys binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, types = classes(percent), [pa.int64()] * 3 + [pa.binary()] * 4
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = gram_sets(batch.column(2).to_pylist(), words)
            names = [name_of(s) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.nulls(batch.num_rows, t) for t in types[2:]]
            yield pa.RecordBatch.from_arrays(columns, NAMED_AND_SIGNED)
            distinct = {name: s for name, s in zip(names, sets) if name is not None}
            for row in signed(distinct, percent, sizes, ranges):
                columns = [pa.nulls(1, t) for t in (batch.column(0).type, *types[:3])] + [pa.array([v], t) for v, t in zip(row, types[2:])]
                yield pa.RecordBatch.from_arrays(columns, NAMED_AND_SIGNED)

    return docs.select("id", "copy", "text").mapInArrow(run, schema)


def shared_signatures(rows: pa.Table) -> pa.Table:
    """Of one range the signatures that several sets have, as ``key`` and ``node``.

    ``sets`` have the signature, it stands for ``weight`` of the very same sets, and its set may leave out ``spare``.
    """
    keys, nodes, spares = [], [], []
    for own, spare, key, place in zip(*(rows.column(c).to_pylist() for c in ("nodes", "spares", "keys", "places"))):
        key, own = unpacked(key), np.frombuffer(own, np.int64)
        place = np.frombuffer(place, "<u2" if len(place) == 2 * len(key) else "<u4")
        keys.append(key)
        nodes.append(own[place])
        spares.append(np.frombuffer(spare, "<u4")[place])
    key, node, spare = np.concatenate(keys), np.concatenate(nodes), np.concatenate(spares)
    order = np.lexsort((node, key))
    key, node, spare = key[order], node[order], spare[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node, spare = key[fresh], node[fresh], spare[fresh]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(begin, len(key)))
    # Signatures of the very same sets say the same; one of them is enough.
    total = np.add.reduceat(mixed(node.view(np.uint64) * M1), begin)
    several = np.flatnonzero(count > 1)
    _, first, weight = np.unique(np.stack([total[several], count[several].astype(np.uint64)]), axis=1, return_index=True, return_counts=True)
    order = np.argsort(first)
    taken, weight = several[first[order]], weight[order]
    many = count[taken]
    at = np.repeat(begin[taken], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    names = key[begin[taken]].astype(np.int64) + (rows.column("part")[0].as_py() << 32)
    columns = [np.repeat(names, many), node[at], np.repeat(many, many), np.repeat(weight, many), spare[at]]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["key", "node", "sets", "weight", "spare"])


def selective(shared: DataFrame) -> DataFrame:
    """``key``, ``node`` and the least of the key's sets as ``pivot``, without the signatures that a set may leave out.

    These are the ones that most sets have. A set's rows are no more than its signatures.
    """
    order = Window.partitionBy("node").orderBy(F.desc("sets"), "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = shared.withColumn("before", F.sum("weight").over(order)).filter("before > spare").select("key", "node")
    rows, path = written_table(rows, "selective")
    groups = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = cut_lineage(rows.join(groups, "key"), "shared")
    remove_tables(shared.sparkSession, [path])
    return found


def packed_set(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of a set's hashes, in order: what sets are compared by."""
    short = np.unique(tokens >> np.uint64(16)).astype("<u8")
    return short.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


BLOCK_ROW = "block long, asks int, root long, node long, tokens binary"


def row_filter(marks: DataFrame) -> np.ndarray:
    """A filter of bounded size that every mark passes and few others."""
    word = F.shiftrightunsigned("mark", 64 - FILTER_BITS)
    bits = marks.select(F.shiftright(word, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each word of the filter at most
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[np.asarray(found.column("at"))] = np.asarray(found.column("bits"))
    return out


class Sets:
    """The sets of some rows' texts, made again where they are needed."""

    def __init__(self, rows: DataFrame, marks: DataFrame, words: int) -> None:
        self.rows, self.marks, self.words = rows, marks, words

    def in_blocks(self, places: DataFrame) -> DataFrame:
        """``places`` (node, block, asks, root) with the nodes' sets as ``tokens``.

        One row stands for a set; a filter of bounded size holds back the others. Places go to the
        rows if they are few, else both are shuffled by node.
        """
        places = cut_lineage(places.select("node", "block", F.col("asks").cast("int").alias("asks"), "root"), "places")
        spark, words = places.sparkSession, self.words
        wanted = spark.sparkContext.broadcast(row_filter(self.marks.join(places.select("node").distinct(), "node")))
        sent = None
        if places.count() <= SENT_PLACES:
            table_ = places.orderBy("node").toArrow()
            sent = spark.sparkContext.broadcast([np.asarray(table_.column(c)) for c in ("node", "block", "asks", "root")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()  # rows of this task, so that a row repeated in it counts once
            for batch in slices(batches, "text", SLICE_BYTES):
                mark = np.asarray(batch.column(0))
                place = mark.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                held = wanted.value[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64)
                passed = np.flatnonzero((held >> (place & np.uint64(63)) & np.uint64(1)).astype(bool))
                passed = [i for i in passed if mark[i] not in done and not done.add(mark[i])]
                sets = gram_sets(batch.column(1).take(pa.array(passed, pa.int64())).to_pylist(), words)
                node, tokens = np.array([name_of(s) or 0 for s in sets], np.int64), [packed_set(s) for s in sets]
                if sent is None:
                    some = [i for i, s in enumerate(sets) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array([tokens[i] for i in some], pa.binary())], ["node", "tokens"])
                    continue
                nodes, *columns = sent.value
                first, last = np.searchsorted(nodes, node), np.searchsorted(nodes, node, side="right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(first, last)] or [np.empty(0, int)]).astype(int)
                own = np.repeat(np.arange(len(node)), last - first)
                out = [pa.array(c[at]) for c in columns] + [pa.array(node[own]), pa.array([tokens[i] for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["block", "asks", "root", "node", "tokens"])

        read = self.rows.select(F.xxhash64("id", "copy").alias("mark"), "text")
        if sent is not None:
            return read.mapInArrow(run, BLOCK_ROW)
        sets = read.mapInArrow(run, "node long, tokens binary").dropDuplicates(["node"])
        return places.hint("merge").join(sets, "node").select("block", "asks", "root", "node", "tokens")


def join_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the stored and the asking sets of each block.

    ``rows`` has ``block``, ``asks``, ``root``, ``node``, ``tokens``. Sets with one root are connected
    already and aren't reported.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
        current, held, seen = None, [], set()
        for batch in batches:
            for name, ask, root, node, tokens in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if name != current:
                    if held:
                        yield held
                    current, held, seen = name, [], set()
                if (ask, node) not in seen:  # a set may come from several tasks
                    seen.add((ask, node))
                    held.append((ask, root, node, unpacked_set(tokens)))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(batches):
            trie, roots, left, right = Trie(), {}, [], []
            for ask, root, node, tokens in held:
                if ask != ASKS:
                    trie.add(node, tokens)
                    roots[node] = root
            for ask, root, node, tokens in held:
                if ask != STORED:
                    for other in trie.similar(tokens, percent, lambda name: roots[name] != root):  # noqa: B023
                        left.append(node)
                        right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = rows.select("block", "asks", "root", "node", "tokens").repartition("block").sortWithinPartitions("block", "asks", "node")
    return dealt.mapInArrow(run, "a long, b long")


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def pivot_links(shared: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links of each signature's sets with its least set, by rows of ``key``, ``node``, ``root``, ``pivot``, ``pivot_root``."""
    pairs = shared.select("node", "root", "pivot", "pivot_root").distinct()
    sizes = pairs.groupBy("pivot", "pivot_root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    sizes = cut_lineage(sizes, "pivots")
    name = lambda number: F.xxhash64("pivot", number)
    members = pairs.join(sizes.drop("pivot_root"), "pivot")
    members = members.select(name(F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).alias("block"), F.lit(STORED).alias("asks"), "root", "node")
    pivots = sizes.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pivots = pivots.select(name(F.col("number")).alias("block"), F.lit(ASKS).alias("asks"), F.col("pivot_root").alias("root"), F.col("pivot").alias("node"))
    return cut_lineage(join_blocks(sets.in_blocks(members.unionByName(pivots)), percent), "pivot-links")


def groups_to_compare(shared: DataFrame) -> DataFrame:
    """Sets that must meet, as ``cluster``, ``node``, ``root``: by signature, or by what signatures connect.

    Two sets that link share a signature, so either grouping finds all links. A set is in one cluster
    but with several signatures; clusters are larger. The grouping that places fewer sets in blocks is taken.
    """
    by_key = shared.select(F.col("key").alias("cluster"), "node", "root")
    edges = shared.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    clusters = components(edges).withColumnRenamed("root", "cluster")
    by_cluster = cut_lineage(shared.select("node", "root").distinct().join(clusters, "node").select("cluster", "node", "root"), "cluster-nodes")

    def places(nodes: DataFrame) -> int:
        each = nodes.groupBy("cluster").agg(F.count("*").alias("n"))
        return each.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(BLOCK)))).first()[0] or 0

    return by_key if places(by_key) < places(by_cluster) else by_cluster


def grid_links(shared: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links among sets of different roots that share a signature, in pairs of bounded blocks.

    The blocks of a group hold sets of one root if that has many, else of several; two blocks meet
    unless both are of one and the same root.
    """
    nodes = groups_to_compare(shared)
    sizes = nodes.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") <= BLOCK).groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("long").alias("pools"))
    dealt = nodes.join(sizes, ["cluster", "root"]).join(small, "cluster", "left")
    pure = F.when(F.col("n") > BLOCK, F.col("root"))
    number = F.when(pure.isNull(), F.pmod(F.xxhash64("root", F.lit(3)), F.col("pools"))).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")))
    dealt = cut_lineage(dealt.select("cluster", "root", "node", pure.alias("pure"), F.xxhash64("cluster", F.coalesce(pure, F.lit(0)), pure.isNull(), number).alias("part")), "parts")
    parts = dealt.select("cluster", "pure", "part").distinct()
    left = parts.select("cluster", F.col("pure").alias("p1"), F.col("part").alias("a"))
    right = parts.select("cluster", F.col("pure").alias("p2"), F.col("part").alias("b"))
    pairs = left.join(right, (left["cluster"] == right["cluster"]) & (left["a"] <= right["b"]) & F.coalesce(left["p1"] != right["p2"], F.lit(True))).select("a", "b")
    pairs = cut_lineage(pairs.withColumn("block", F.xxhash64("a", "b")), "part-pairs")
    same = F.when(F.col("a") == F.col("b"), F.lit(BOTH))
    stored = pairs.select("block", F.coalesce(same, F.lit(STORED)).alias("asks"), F.col("a").alias("part"))
    asking = pairs.filter("a <> b").select("block", F.lit(ASKS).alias("asks"), F.col("b").alias("part"))
    rows = stored.unionByName(asking).join(dealt.select("part", "root", "node"), "part").drop("part")
    return join_blocks(sets.in_blocks(rows), percent)


def unresolved(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of signatures whose sets are not all connected."""
    rows = with_roots(shared.select("key", "node", "pivot"), roots)
    groups = rows.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("pivot").alias("pivot"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("total"), F.count("*").alias("members")
    )
    # Signatures of the very same sets say the same; one of them is enough.
    keys = groups.filter("low <> high").groupBy("pivot", "total", "members").agg(F.min("key").alias("key")).select("key")
    return rows.join(keys, "key")


def nearest_pivots(shared: DataFrame) -> DataFrame:
    """Every set with the least of the pivots it has, so that it meets one of them only."""
    return shared.filter("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot")).select(
        "node", "pivot", F.col("node").alias("root"), F.col("pivot").alias("pivot_root")
    )


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row the key, ``n_shingles`` and ``component_id``."""
    used = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = written_table(df, name)
        used.append(path)
        return out

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    foretold = 2 * (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES * (100 - percent) // percent
    both, path = written_table(named_and_signed(rows, words, percent, max(1, -(-foretold // RANGE))), "signed")
    table_ = cut_lineage(both.filter("part IS NULL").select(*NAMED_AND_SIGNED[:4]), "named")
    shared = both.filter("part IS NOT NULL").select(*NAMED_AND_SIGNED[4:]).groupBy("part")
    shared = kept(shared.applyInArrow(shared_signatures, "key long, node long, sets long, weight long, spare long"), "signatures")
    remove_tables(docs.sparkSession, [path])
    shared = selective(shared)
    # One row stands for a set: its text is read again, and only for sets that are compared.
    marks = table_.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "copy")).alias("row"))
    marks = marks.select("node", F.xxhash64("row.id", "row.copy").alias("mark"))

    sets = Sets(rows, marks, words)
    # First every set meets one pivot, which connects most of what there is to connect.
    links = pivot_links(nearest_pivots(shared), sets, percent)
    roots = components(links)
    shared = kept(unresolved(shared, roots), "unresolved")
    if not shared.isEmpty():
        links = links.unionByName(kept(grid_links(shared, sets, percent), "grid-links"))
        roots = components(links)
    least = with_roots(table_.select("id", "node").filter("node IS NOT NULL"), roots).groupBy("root").agg(F.min("id").alias("component_id"))
    named_ = with_roots(table_.select("node").filter("node IS NOT NULL").distinct(), roots).join(least, "root").select("node", "component_id")
    named_ = cut_lineage(named_, "components")
    remove_tables(docs.sparkSession, used)
    return table_.join(named_, "node", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return link_documents(table(spark, sf_dir, "documents"))


def jaccard_sql() -> str:
    """The same rows in DuckDB by counting common shingles of all pairs."""
    word = r"[^\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM documents),
    s AS (
      SELECT DISTINCT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3
      UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY a)
    SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least.least, doc_id)) AS component_id
    FROM d LEFT JOIN n USING (r) LEFT JOIN least ON least.a = d.r"""
