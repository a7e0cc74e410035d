"""Exact top-k search by inner product over a pivot-distance index.

Pivots are points of a bounded sample that lie far apart. Every vector is keyed by its nearest
pivot and its distance to it; a pivot's vectors, sorted by distance, are cut into annuli at the
quantiles of that distance. A query knows its distance to each pivot, so it knows how near an
annulus can be: it expands from the nearest annulus outwards and stops where no annulus left can
beat its k-th best. ``vector_search`` has the space, the rounds and the scan, which is exact.

Defined results: rows without an id or a vector, or with a missing or non-finite component, take
no part. Rows that repeat id and vector are one row; an id with several vectors is several rows,
but no row answers a query of its own id. Vectors of different lengths are compared as if the
shorter one were filled up with zeros. Ties go to the smaller id. An empty table gives no rows.
Products beyond 64-bit integers raise. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.vector_search import LEAST, MOST, SCALE, Space, Table, answers, blocks, candidates, chunks, coded, place, search
from plumbline.session import cut_lineage

TOP, EVERY = 5, 50
PIVOTS = 512  # at most
ROWS_PER_PIVOT = 2048  # fewer pivots for fewer rows
ANNULI = 16  # of a pivot


class Annuli:
    """Pivots, the edges of their annuli and the least and largest distance in each annulus."""

    def __init__(self, pivots: np.ndarray, space: Space, annuli: int) -> None:
        self.pivots, self.space, self.annuli = pivots, space, annuli
        self.edges = np.full((len(pivots), annuli - 1), np.inf)
        self.parts, self.lows, self.highs = np.empty(0, np.int64), np.empty(0), np.empty(0)

    def place(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        away = self.space.asked(x, self.pivots) if query else self.space.between(x, self.pivots)
        pivot = away.argmin(1)
        distance = away[np.arange(len(x)), pivot]
        return pivot * self.annuli + (self.edges[pivot] < distance[:, None]).sum(1), distance

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance from each query to the vectors of each part."""
        away = self.space.asked(queries, self.pivots)
        own = away[:, self.parts // self.annuli]
        near = np.maximum(np.maximum(self.lows - own, own - self.highs), 0)
        # A vector is no nearer to another pivot than to its own.
        return np.maximum(near, (own - away.min(1, keepdims=True)) / 2), own + self.highs


def indexed(rows: Table) -> tuple[Annuli, DataFrame]:
    """The index of all candidates and their blocks."""
    sample, most = rows.sample(), min(PIVOTS, -(-rows.count // ROWS_PER_PIVOT))
    index = Annuli(sample[rows.space.chosen(sample, most)], rows.space, ANNULI)
    placed = cut_lineage(place(rows.rows, index, rows.kind, False).withColumn("pivot", (F.col("part") / ANNULI).cast("int")), "placed")
    shares = [(i + 1) / ANNULI for i in range(ANNULI - 1)]
    for row in placed.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("edges")).collect():
        index.edges[row["pivot"]] = row["edges"]
    cuts = placed.sparkSession.createDataFrame([(p, e.tolist()) for p, e in enumerate(index.edges)], "pivot int, edges array<double>")
    edges = F.size(F.filter("edges", lambda e: e < F.col("distance")))
    placed = placed.join(F.broadcast(cuts), "pivot").withColumn("part", (F.col("pivot") * ANNULI + edges).cast("int")).drop("pivot", "edges")
    known = placed.groupBy("part").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("part").collect()
    index.parts = np.array([r["part"] for r in known], np.int64)
    index.lows, index.highs = np.array([r["low"] for r in known]), np.array([r["high"] for r in known])
    return index, blocks(placed, "blocks", PIVOTS * ANNULI)


def top_products(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = EVERY) -> DataFrame:
    """For every row whose id is divisible by ``every`` the k highest scores: ``query_id, rank, vec_id, score``."""
    rows = cut_lineage(coded(vectors, key, vector), "codes")
    asking = rows.filter(F.col("id") % every == 0)
    kept = Table(candidates(rows, k), "candidates")
    if not kept.count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, stored = indexed(kept)
    windows = asking.withColumns({"low": F.lit(LEAST), "high": F.lit(MOST)})
    asked = chunks(cut_lineage(place(windows, index, kept.kind, True), "asked"), "chunks", PIVOTS * ANNULI)
    best = search(asked, stored, index, kept, k)
    return answers(asked, best, ["id"]).select(F.col("ask_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every fiftieth row of ``embeddings`` among all other rows."""
    return top_products(table(spark, sf_dir, "embeddings"))


def codes_sql(columns: str = "vec_id", where: str = "true") -> str:
    """DuckDB: the rows that take part, each once, with integer components ``c``."""
    return f"""
      SELECT DISTINCT {columns}, list_transform(embedding, lambda x: CASE WHEN isfinite(x::DOUBLE) THEN floor({SCALE} * x::DOUBLE)::BIGINT ELSE 0 END) AS c
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {where}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"""


#: The score of rows ``a`` and ``b``.
SCORE_SQL = "coalesce(list_sum(list_transform(range(1, least(len(a.c), len(b.c)) + 1), lambda i: a.c[i] * b.c[i])), 0)::BIGINT"


def pivot_sql(k: int = TOP, every: int = EVERY) -> str:
    """The same rows in DuckDB from all pairs of a query and a row."""
    return f"""
    WITH v AS ({codes_sql()}),
    pairs AS (SELECT a.vec_id AS query_id, a.c, b.vec_id, {SCORE_SQL} AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
    ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
