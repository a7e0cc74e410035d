"""Hard negatives through a multiway hyperplane tree with sibling distance ranges.

A node of the tree has up to ``FANOUT`` split points that lie far apart; a vector goes to the
child of its nearest one. For every pair of a split point and a child the node stores the least
and the largest distance from the point to the child's vectors, over all rows. A window of scores
is an annulus around the anchor: a child is left out when, for any of the split points, the
distances that its range allows don't meet the annulus. Leaves are compared exactly. The shape comes
from a bounded sample; every row goes into a leaf and into the ranges on its way.

An anchor's positives are its best rows of the same label; each positive opens a window from
``share`` of its score up to its score, in which the best rows of other labels are the negatives.
``vector_search`` has the space, the rounds and the scan.

Defined results: rows without an id, label or vector, or with a missing or non-finite component,
take no part. Rows that repeat id, vector and label are one row; an id with several vectors is
several rows, but no row is a positive of its own id; an id with several labels likewise. Vectors
of different lengths are compared as if the shorter one were filled up with zeros. A positive with
a negative score has an empty window. Ties go to the smaller id. An empty table gives no rows.
Products beyond 64-bit integers raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.pivots import SCORE_SQL, codes_sql
from plumbline.llm.vector_search import LEAST, MOST, Space, Table, answers, blocks, candidates, chunks, coded, matrix, place, search
from plumbline.session import cut_lineage

POSITIVES, NEGATIVES = 5, 5
EVERY = 100
LOW_PERCENT = 80
SHIFT_EVERY, LABELS = 7, 10
FANOUT, DEPTH = 8, 4
LEAF = 1024  # rows below which a node isn't split any further
LEAVES = FANOUT**DEPTH


class Node:
    """Split points, one child for each (a node's or a leaf's number) and the ranges from points to children."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.points, self.children, self.leaf = points, [0] * n, [False] * n
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)


class Tree:
    """Nodes, the root first; leaves are the parts of the index."""

    def __init__(self, sample: np.ndarray, rows: int, space: Space) -> None:
        self.space, self.nodes, self.parts = space, [], np.empty(0, np.int64)
        self.leaves = 0
        if len(sample):
            self.grow(sample, rows / len(sample), 1)

    def grow(self, x: np.ndarray, weight: float, depth: int) -> int:
        number, node = len(self.nodes), Node(x[self.space.chosen(x, FANOUT)])
        self.nodes.append(node)
        nearest = self.space.between(x, node.points).argmin(1)
        for j in range(len(node.points)):
            own = x[nearest == j]
            node.leaf[j] = depth == DEPTH or len(own) * weight <= LEAF or len(node.points) == 1
            if node.leaf[j]:
                node.children[j], self.leaves = self.leaves, self.leaves + 1
            else:
                node.children[j] = self.grow(own, weight, depth + 1)
        return number

    def walk(self, x: np.ndarray, query: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each node on the way of some rows: number, the rows, their distances to its points and their child."""
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            number, rows = todo.pop()
            node = self.nodes[number]
            away = (self.space.asked if query else self.space.between)(x[rows], node.points)
            child = away.argmin(1)
            yield number, rows, away, child
            for j in np.unique(child):
                if not node.leaf[j]:
                    todo.append((node.children[j], rows[child == j]))

    def place(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        part, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
        for number, rows, away, child in self.walk(x, query):
            node = self.nodes[number]
            ends = np.array(node.leaf)[child]
            part[rows[ends]] = np.array(node.children)[child[ends]]
            distance[rows[ends]] = away[ends, child[ends]]
        return part, distance

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance from each query to the vectors of each leaf, from all ranges on its way."""
        near, far = np.zeros((len(queries), self.leaves)), np.full((len(queries), self.leaves), np.inf)
        todo = [(0, np.zeros(len(queries)), np.full(len(queries), np.inf))]
        while todo:
            number, above, below = todo.pop()
            node = self.nodes[number]
            away = self.space.asked(queries, node.points)
            for j, child in enumerate(node.children):
                if np.isinf(node.low[0, j]):
                    continue  # no row went there
                low = np.maximum(above, np.maximum(node.low[:, j] - away, away - node.high[:, j]).max(1))
                high = np.minimum(below, (away + node.high[:, j]).min(1))
                if node.leaf[j]:
                    near[:, child], far[:, child] = low, high
                else:
                    todo.append((child, low, high))
        return near[:, self.parts], far[:, self.parts]


def ranged(rows: DataFrame, tree: Tree) -> None:
    """Fill the ranges of the tree from all rows: least and largest distances by task, then by range."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = shared.value, ["node", "point", "child", "low", "high"]
        seen = {}
        for batch in batches:
            for number, _, away, child in tree.walk(matrix(batch.column("codes")), False) if batch.num_rows else ():
                for j in np.unique(child):
                    low, high = seen.setdefault((number, j), (np.full(away.shape[1], np.inf), np.full(away.shape[1], -np.inf)))
                    np.minimum(low, away[child == j].min(0), out=low)
                    np.maximum(high, away[child == j].max(0), out=high)
        for (number, j), (low, high) in seen.items():
            n = len(low)
            columns = [np.full(n, number, np.int32), np.arange(n, dtype=np.int32), np.full(n, j, np.int32), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    partial = rows.select("codes").mapInArrow(distances, "node int, point int, child int, low double, high double")
    # As many rows as the tree has pairs of a point and a child.
    for r in partial.groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        node = tree.nodes[r["node"]]
        node.low[r["point"], r["child"]], node.high[r["point"], r["child"]] = r["low"], r["high"]


def indexed(rows: Table) -> tuple[Tree, DataFrame]:
    """The tree over all candidates and its leaves as blocks."""
    tree = Tree(rows.sample(), rows.count, rows.space)
    ranged(rows.rows, tree)
    tree.parts = np.array(sorted(c for n in tree.nodes for j, c in enumerate(n.children) if n.leaf[j] and np.isfinite(n.low[0, j])), np.int64)
    placed = cut_lineage(place(rows.rows, tree, rows.kind, False), "placed")
    return tree, blocks(placed, "leaves", LEAVES)


def hard_negatives(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
) -> DataFrame:
    """Negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A negative's score is at least
    ``low_percent`` hundredths of the positive's and at most as high.
    """
    rows = cut_lineage(coded(vectors, key, vector, label), "codes")
    kept = Table(candidates(rows, max(positives, negatives)), "candidates")
    if not kept.count:
        names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], names)
    tree, stored = indexed(kept)
    anchors = rows.filter(F.col("id") % every == 0).withColumns({"low": F.lit(LEAST), "high": F.lit(MOST)})
    asked = chunks(cut_lineage(place(anchors, tree, kept.kind, True), "anchors"), "chunks", LEAVES)
    best = search(asked, stored, tree, kept, positives, same_label=True)
    found = answers(asked, best, ["id", "label", "codes"])
    low = F.ceil(F.col("score") * F.lit(low_percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")).cast("long")
    found = found.select(F.col("ask_id").alias("id"), F.col("ask_label").alias("label"), F.col("ask_codes").alias("codes"), low.alias("low"), F.col("score").alias("high"), F.col("id").alias("positive"))
    windows = cut_lineage(found.filter("high >= 0").withColumn("codes", F.col("codes").cast("array<long>")), "windows")
    asked = chunks(cut_lineage(place(windows, tree, kept.kind, True), "asked"), "chunks", LEAVES)
    best = search(asked, stored, tree, kept, negatives, same_label=False)
    names = {"ask_id": "anchor_id", "ask_positive": "positive_id", "rank": "rank", "id": "negative_id", "ask_high": "positive_score", "score": "negative_score"}
    return answers(asked, best, ["id", "positive", "high"]).select(*[F.col(a).alias(b) for a, b in names.items()])


def shifted(vectors: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The label of every seventh id moved on by one, so that vectors of one kind bear two labels."""
    moved = (F.col(label).cast("long") + 1) % LABELS
    return vectors.withColumn(label, F.when(F.col(key) % SHIFT_EVERY == 0, moved).otherwise(F.col(label).cast("long")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``, searched in all rows."""
    return hard_negatives(shifted(table(spark, sf_dir, "embeddings")))


def negatives_sql() -> str:
    """The same rows in DuckDB from all pairs of an anchor and a row."""
    shifted_label = f"CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS l"
    return f"""
    WITH v AS ({codes_sql(f"vec_id, {shifted_label}", "label IS NOT NULL")}),
    pairs AS (SELECT a.vec_id AS anchor_id, a.c, a.l, b.vec_id, b.l = a.l AS same, {SCORE_SQL} AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id OR a.l <> b.l WHERE a.vec_id % {EVERY} = 0),
    positives AS (SELECT * FROM pairs WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id, c, l ORDER BY score DESC, vec_id) <= {POSITIVES}),
    windows AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.c, p.l, p.vec_id, p.score ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
                FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.c = p.c AND n.l = p.l AND NOT n.same
                AND n.vec_id <> n.anchor_id AND {LOW_PERCENT} * p.score <= 100 * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= {NEGATIVES}"""
