"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import remove_tables, written_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node in ``edges`` (a, b); nodes of a component share a root.

    Each round every node hangs itself on the neighbour of least priority, a hash that changes from
    round to round, and edges are rewritten to what their ends hang on. A constant share of the
    nodes goes in each round, however the ids lie along paths. The minima are partial aggregates,
    so a node with very many edges is no task's own.
    """
    edges, edges_at = written_table(edges.filter("a <> b").distinct(), "edges")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    roots, roots_at = written_table(roots, "roots")
    salt = 0
    while not edges.isEmpty():
        salt += 1
        priority = lambda node: F.struct(F.xxhash64(F.lit(salt), node).alias("p"), node.alias("node"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a"))
        best = both.groupBy("a").agg(F.min(priority(F.col("b"))).alias("best"))
        hangs = best.select(F.col("a").alias("node"), F.least(F.col("best"), priority(F.col("a")))["node"].alias("up"))
        hangs, hangs_at = written_table(hangs, "hangs")
        moved = roots.join(hangs.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        # What a round has read is of no more use once its results are written.
        old = [edges_at, roots_at, hangs_at]
        roots, roots_at = written_table(moved, "roots")
        moved = edges.join(hangs.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hangs.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        edges, edges_at = written_table(moved, "edges")
        remove_tables(edges.sparkSession, old)
    remove_tables(edges.sparkSession, [edges_at])
    return roots
