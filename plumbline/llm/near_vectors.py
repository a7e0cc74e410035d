"""Near-duplicate vectors by small-world graphs per shard, verified cosines and components.

Copies of a vector are one node with a count. Vectors of a label (and length) are dealt by hash
into shards of about ``SHARD`` nodes. Every shard's graph is built once and written, links and
vectors in one row; then each shard meets each shard's nodes as queries. The beam is doubled until an
audit passes: for a part of the queries brute force gives the true links and nearest vectors, and
recall of both must reach its target. A query whose beam is a third hits gets a wider one. Beyond
``CEILING`` neither is worth it: such queries, or a block whose audit still fails, are compared with
the whole shard, which costs less than a walk that visits most of it. Cosines are in double precision.
A block returns counts and, for linked nodes, their component inside the block, never pairs, so a
group of near copies costs rows by its size.

Defined results: vectors that are missing, zero, or hold missing or non-finite numbers, and rows
without a label, link with nothing and are their own component. Vectors of different lengths
don't link. Repeated rows are copies and link with each other. A row without an id takes part,
but is never a component's id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.components import components
from plumbline.llm.hnsw import BATCH, DEGREE, Graph
from plumbline.session import cut_lineage, remove_tables, written_table

THRESHOLD = 0.98
SHARD = 8192
BEAM, CEILING = 64, 256
AUDIT, NEAREST = 128, 10
LINK_RECALL, NEAREST_RECALL = 0.999, 0.9


def unit(rows: pa.Table, name: str) -> np.ndarray:
    """The vectors of a group, all of one length, scaled to length 1."""
    x = np.array(rows.column(name).to_pylist(), np.float64).reshape(rows.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def heights(nodes: np.ndarray) -> np.ndarray:
    """A geometric level for each node, from its id."""
    mixed = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    share = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(8, (-np.log(np.maximum(share, 1e-16)) / np.log(DEGREE)).astype(int))


#: Takes the places of some links found, in the queries and in the shard.
Report = Callable[[np.ndarray, np.ndarray], None]


def linked(graph: Graph, queries: np.ndarray, own: np.ndarray, beam: int, report: Report) -> np.ndarray:
    """Report the links of all queries and return each one's nearest; ``own`` is a query's place in the shard or -1."""
    size = len(graph.x)
    nearest = np.full((len(queries), NEAREST), -1)
    todo, width = np.arange(len(queries)), min(beam, size)
    while len(todo) and width <= CEILING:
        wider = []
        for i in range(0, len(todo), BATCH):
            part = todo[i : i + BATCH]
            ids, cosines = graph.search(queries[part], width)
            nearest[part, : min(NEAREST, width)] = ids[:, :NEAREST]
            hits = cosines >= THRESHOLD
            full = (hits.sum(1) * 3 > width) & (width < size)
            wider.append(part[full])
            hits[full] = False
            row, at = np.nonzero(hits & (ids != own[part][:, None]))
            report(part[row], ids[row, at])
        todo, width = np.concatenate(wider), min(2 * width, size)
    compared(graph.x, queries, own, todo, report)
    return nearest


def compared(x: np.ndarray, queries: np.ndarray, own: np.ndarray, places: np.ndarray, report: Report) -> None:
    """Report the links of some queries, from their cosines with every vector."""
    for i in range(0, len(places), BATCH):
        part = places[i : i + BATCH]
        row, at = np.nonzero(queries[part] @ x.T >= THRESHOLD)
        other = at != own[part][row]
        report(part[row[other]], at[other])


def audited(graph: Graph, queries: np.ndarray, own: np.ndarray, report: Report) -> None:
    """Report the links of all queries, with the first beam whose recall on the audited queries is enough."""
    size, beam = len(graph.x), BEAM
    picked = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = queries[picked] @ graph.x.T
    true_links = truth >= THRESHOLD
    true_links[np.arange(len(picked))[own[picked] >= 0], own[picked][own[picked] >= 0]] = False
    true_near = np.argsort(-truth, 1, kind="stable")[:, : min(NEAREST, size)]
    while beam <= CEILING:
        found = np.zeros(true_links.shape, bool)

        def note(left: np.ndarray, right: np.ndarray) -> None:
            found[left, right] = True  # noqa: B023

        nearest = linked(graph, queries[picked], own[picked], beam, note)
        near = (true_near[:, :, None] == nearest[:, None, :]).any(2).mean()
        if (found & true_links).sum() >= LINK_RECALL * true_links.sum() and near >= NEAREST_RECALL:
            linked(graph, queries, own, beam, report)
            return
        beam *= 2
    compared(graph.x, queries, own, np.arange(len(queries)), report)


class Components:
    """The smallest name reachable for each of some names, from links that arrive part by part."""

    def __init__(self, size: int) -> None:
        self.up = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.tops(a), self.tops(b)
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def tops(self, places: np.ndarray) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up[places]
            self.up = higher


GRAPH = "label {kind}, dim int, shard long, node binary, copies binary, vector binary, links binary, levels int"


def built(rows: pa.Table) -> pa.Table:
    """One shard's nodes in order, their unit vectors, and the links of its graph, level by level."""
    rows = rows.sort_by("node")
    nodes = np.asarray(rows.column("node"))
    x = unit(rows, "vector")
    graph = Graph(x, heights(nodes))
    first = rows.select(["label", "dim", "shard"]).slice(0, 1)
    packed = {
        "node": nodes.tobytes(), "copies": np.asarray(rows.column("copies")).tobytes(), "vector": x.tobytes(),
        "links": b"".join(x.astype(np.int32).tobytes() for x in graph.links), "levels": len(graph.links),
    }
    for name, value in packed.items():
        first = first.append_column(name, pa.array([value], pa.int32() if name == "levels" else pa.binary()))
    return first


def probe(nodes: np.ndarray, copies: np.ndarray, graph: Graph, asks: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
    """One block of queries against one shard."""
    at = np.searchsorted(nodes, asks).clip(max=len(nodes) - 1)
    own = np.where(nodes[at] == asks, at, -1)
    # One numbering for queries and shard; a node that is both is one.
    names = np.unique(np.concatenate([nodes, asks]))
    ask_names, node_names = np.searchsorted(names, asks), np.searchsorted(names, nodes)
    links, parts, met = np.zeros(len(asks), np.int64), Components(len(names)), np.zeros(len(names), bool)

    def report(left: np.ndarray, right: np.ndarray) -> None:
        np.add.at(links, left, copies[right])
        a, b = ask_names[left], node_names[right]
        met[a] = met[b] = True
        parts.add(a, b)

    audited(graph, queries, own, report)
    ends = np.flatnonzero(met)
    columns = [np.concatenate([asks, names[ends]]), np.concatenate([links, np.zeros(len(ends), np.int64)]), np.concatenate([asks, names[parts.tops(ends)]])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "links", "near"])


def probed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard's graph beside a block of queries."""
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: E731, B023
            nodes, asks, dim = value("node", np.int64), value("b_node", np.int64), batch.column("dim")[i].as_py()
            graph = Graph.stored(value("vector", np.float64).reshape(-1, dim), heights(nodes), value("links", np.int32), batch.column("levels")[i].as_py())
            yield probe(nodes, value("copies", np.int64), graph, asks, value("b_vector", np.float64).reshape(-1, dim))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD) -> DataFrame:
    """For every row the key, ``n_links``, ``component_id`` and ``kept``."""
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    fine = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    usable = usable & fine & F.exists("vector", lambda v: v != 0)
    # Two hashes of the vector stand for it; -0.0 counts as 0.0.
    same = F.transform("vector", lambda v: v + F.lit(0.0))
    # A row that can't link has no node.
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", same))).withColumn("check", F.when(usable, F.xxhash64(F.lit(1), "label", same)))
    found = rows.filter("node IS NOT NULL").groupBy("node", "check").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("copies"))
    found = cut_lineage(found.withColumn("dim", F.size("vector")), "nodes")
    sizes = found.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("long").alias("shards"))
    dealt = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("shards")).alias("shard")
    nodes = found.join(sizes, ["label", "dim"]).select("label", "dim", dealt, "node", "copies", "vector")
    kind = rows.schema["label"].dataType.simpleString()
    graphs, graphs_at = written_table(nodes.groupBy("label", "dim", "shard").applyInArrow(built, GRAPH.format(kind=kind)), "graphs")
    graphs = graphs.join(sizes, ["label", "dim"])
    # Every shard meets every shard of its label and length; each pair is a key, so a hot label is spread.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    stored = graphs.withColumn("block", every).drop("shards")
    asking = graphs.select("label", "dim", F.col("shard").alias("block"), F.col("node").alias("b_node"), F.col("vector").alias("b_vector"), every.alias("shard"))
    met = stored.hint("merge").join(asking, ["label", "dim", "shard", "block"])
    found_links = met.select("dim", "node", "copies", "vector", "links", "levels", "b_node", "b_vector").mapInArrow(probed, "node long, links long, near long")
    probed_ = cut_lineage(found_links, "links")
    remove_tables(vectors.sparkSession, [graphs_at])
    roots = components(probed_.select(F.col("node").alias("a"), F.col("near").alias("b")))
    totals = probed_.groupBy("node").agg(F.sum("links").alias("links"))
    marked = found.select("node", "check", "least", "copies").join(totals, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = marked.join(smallest, "root").select("node", "check", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node", "check").join(marked, ["node", "check"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among the vectors of its label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def near_sql() -> str:
    """The same rows in DuckDB by comparing all pairs."""
    whole = lambda row: f"list_transform({row}.e, lambda x: coalesce(x, 0))"  # noqa: E731 - no row has a null here, but the engine looks
    return f"""
    WITH RECURSIVE v AS (
      SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
              WHERE list_cosine_similarity({whole('a')}, {whole('b')}) >= {THRESHOLD}),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.r)::BIGINT AS n_links,
           least(vec_id, coalesce(least.least, vec_id))::BIGINT AS component_id,
           vec_id = least(vec_id, coalesce(least.least, vec_id)) AS kept
    FROM v LEFT JOIN least ON least.a = v.r"""
