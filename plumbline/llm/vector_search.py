"""Exact searches by integer inner product over parts of an index, shared by operators 11 and 12.

A vector's components become integers, floor(256 * x). With M the largest norm, a vector x gets one
more component sqrt(M^2 - |x|^2), a query none: then distance^2 = |q|^2 + M^2 - 2 * score, so the
highest scores are the nearest vectors and a window of scores is an annulus around the query.

An index deals vectors into parts and bounds, by the triangle inequality, how near and how far the
vectors of each part lie from a query. ``search`` visits the parts of a query in the order of their
least distance, 1, then 8, then 64 and so on, and leaves out those whose bounds don't meet what is
still wanted: the window, and from the k-th best found so far upwards. Scores are exact integers.

Queries travel in chunks and vectors in blocks of bounded rows, so no task holds a part as a whole;
both numbers of rows come from counts by part, not from how rows lie in partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

SCALE = 256
BLOCK = 2048  # vectors in a block
CHUNK = 512  # queries in a chunk
STEP = 8  # by which the number of visited parts grows from round to round
SAMPLE = 4096  # rows that pivots and split points are chosen from
SLACK = 1e-6  # of squared norms; bounds are rounded, scores are not
LEAST, MOST = -(2**63), 2**63 - 1


def coded(vectors: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """``id``, ``codes`` and ``label`` of the rows that take part, each once.

    Rows without an id, a vector or a label (where one is named), or with a missing or non-finite
    component, take no part.
    """
    named = F.lit(0) if label is None else F.col(label)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), named.cast("long").alias("label"))
    fine = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.col("label").isNotNull() & fine)
    codes = F.transform("vector", lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    return rows.select("id", codes.alias("codes"), "label").dropDuplicates(["id", "codes", "label"])


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of the rows of one label that share a vector, the k + 1 smallest ids.

    All of them score alike with a query, so no list of k needs more, one being the query itself. The
    limit applies before the shuffle as well, so a vector on a third of the rows is a few rows a task.
    """
    by = Window.partitionBy("codes", "label").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k + 1).drop("_n")


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets)
    lengths, values = np.diff(offsets), np.asarray(lists.values)[offsets[0] : offsets[-1]]
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision; components that only one side has count as zeros."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width].astype(np.float64) @ b[:, :width].astype(np.float64).T


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    width = min(a.shape[1], b.shape[1])
    most = width * int(np.abs(a.astype(object)).max(initial=0) if a.dtype == np.int64 else np.abs(a.astype(np.int64)).max(initial=0))
    most *= int(np.abs(b.astype(object)).max(initial=0) if b.dtype == np.int64 else np.abs(b.astype(np.int64)).max(initial=0))
    if most < 2**53:
        return np.rint(products(a, b)).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products leave the range of 64-bit integers")
    return a[:, :width].astype(np.int64) @ b[:, :width].astype(np.int64).T


class Space:
    """Distances between vectors that are filled up to the norm M, and from queries to them."""

    def __init__(self, square: float) -> None:
        self.square = square

    def rest(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.square - np.einsum("nd,nd->n", x, x), 0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.square - products(x, y) - self.rest(x)[:, None] * self.rest(y)), 0))

    def asked(self, queries: np.ndarray, y: np.ndarray) -> np.ndarray:
        q = queries.astype(np.float64)
        return np.sqrt(np.maximum(np.einsum("nd,nd->n", q, q)[:, None] + self.square - 2 * products(queries, y), 0))

    def chosen(self, x: np.ndarray, most: int) -> np.ndarray:
        """Places of up to ``most`` points that lie far apart, the first one first."""
        if not len(x):
            return np.empty(0, int)
        picked, near = [0], self.between(x, x[:1])[:, 0]
        while len(picked) < min(most, len(x)) and near.max() > 1e-6 * max(self.square, 1) ** 0.5:
            picked.append(int(near.argmax()))
            near = np.minimum(near, self.between(x, x[picked[-1:]])[:, 0])
        return np.array(picked)


class Table:
    """Candidates of an index as blocks by part, and what is known of them as a whole."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        self.rows = cut_lineage(rows, name)
        square = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        largest = F.array_max(F.transform("codes", lambda x: F.abs(x.cast("double"))))
        seen = self.rows.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(largest).alias("largest")).first()
        self.count, self.space = seen["n"], Space(float(seen["square"] or 0.0))
        self.kind = "int" if (seen["largest"] or 0.0) < 2**31 - 1 else "bigint"

    def sample(self) -> np.ndarray:
        """Vectors of the rows whose ids hash lowest."""
        picked = self.rows.orderBy(F.xxhash64("id", "codes"), "id").limit(SAMPLE).select("codes").toArrow()
        return matrix(picked.column("codes")) if picked.num_rows else np.zeros((0, 0), np.int64)


def spread(placed: DataFrame, size: int, name: str, most_parts: int) -> DataFrame:
    """A part's rows dealt by hash into pieces of about ``size`` rows: ``placed`` with ``pieces`` and ``first``.

    ``first`` numbers the pieces so that neighbouring small parts share one. There are at most
    ``most_parts`` parts, so their counts fit the driver.
    """
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(counts) <= most_parts
    deal, number, held = [], 0, 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        if n > size or held + n > size:
            number, held = number + (held > 0), 0
        pieces = -(-n // size)
        deal.append((part, number, pieces))
        number, held = (number + pieces, 0) if pieces > 1 else (number, held + n)
    table = placed.sparkSession.createDataFrame(deal, "part int, first long, pieces long")
    return placed.join(F.broadcast(table), "part")


PLACED = "id long, codes array<{kind}>, label long, part int, distance double"


def place(rows: DataFrame, index, kind: str, query: bool) -> DataFrame:
    """Rows with the part that the index puts them in and their distance to its point."""
    rows = rows.withColumn("codes", F.col("codes").cast(f"array<{kind}>"))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, distance = shared.value.place(matrix(batch.column("codes")), query)
                out = batch.append_column("part", pa.array(part.astype(np.int32)))
                yield out.append_column("distance", pa.array(distance))

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(dealt, f"{kinds}, part int, distance double")


def blocks(placed: DataFrame, name: str, most_parts: int) -> DataFrame:
    """Blocks of candidates, ids and vectors side by side in arrays, by part."""
    dealt = spread(placed, BLOCK, name, most_parts).withColumn("piece", F.pmod(F.xxhash64("id", "codes"), F.col("pieces")))
    kept = dealt.groupBy("part", "piece").agg(F.collect_list(F.struct("id", "label", "codes")).alias("items"))
    return cut_lineage(kept.select("part", *[F.col(f"items.{c}").alias(f"x_{c}") for c in ("id", "label", "codes")]), name)


def chunks(placed: DataFrame, name: str, most_parts: int) -> DataFrame:
    """Chunks of queries, rows of ``id, label, codes, low, high`` and further longs, side by side in arrays."""
    extra = [c for c in placed.columns if c not in ("part", "distance")]
    dealt = spread(placed, CHUNK, name, most_parts)
    dealt = dealt.withColumn("chunk", F.col("first") + F.pmod(F.xxhash64(*extra), F.col("pieces")))
    kept = dealt.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*extra))).alias("items"))
    return cut_lineage(kept.select("chunk", *[F.col(f"items.{c}").alias(c) for c in extra]), name)


def numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.asarray(batch.column(name)[row].values)


NEED = "part int, chunk long, pos array<int>, id array<long>, label array<long>, codes array<array<{kind}>>, floor array<long>, high array<long>"
FOUND = "chunk long, pos int, id long, score long"


def planned(shared, space: Space, first: int, last: int) -> Callable:
    """For chunks, the parts that stand at places ``first`` to ``last`` by least distance and may hold wanted scores."""

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                index, codes = shared.value, matrix(batch.column("codes")[row].values)
                floor, high = numbers(batch, "low", row).copy(), numbers(batch, "high", row)
                for reached in batch.column("kth")[row].as_py() or ():
                    floor[reached["pos"]] = max(floor[reached["pos"]], reached["score"])
                q = codes.astype(np.float64)
                reach = np.einsum("nd,nd->n", q, q)[:, None] + space.square
                near, far = index.bounds(codes)
                places = np.argsort(near, 1, kind="stable")[:, first:last]
                near, far = np.take_along_axis(near, places, 1), np.take_along_axis(far, places, 1)
                slack = SLACK * reach + 0.5
                want = ((reach - near**2) / 2 + slack >= floor[:, None]) & ((reach - far**2) / 2 - slack <= high[:, None]) & (floor <= high)[:, None]
                at, place = np.nonzero(want)
                part = index.parts[places[at, place]]
                order = np.lexsort((at, part))
                at, part = at[order], part[order]
                cuts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a < b:
                        yield packed(batch, row, int(part[a]), at[a:b], codes, floor, high)

    return plan


def packed(batch: pa.RecordBatch, row: int, part: int, at: np.ndarray, codes: np.ndarray, floor: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """One part and the queries of a chunk that need it."""
    one = lambda values: pa.array([values])
    taken = codes[at]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * taken.shape[1]), pa.array(taken.ravel()))
    nested = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), lists)
    columns = [pa.array([part], pa.int32()), pa.array([batch.column("chunk")[row].as_py()], pa.int64()), one(at.astype(np.int32))]
    columns += [one(numbers(batch, "id", row)[at]), one(numbers(batch, "label", row)[at]), nested, one(floor[at]), one(high[at])]
    return pa.RecordBatch.from_arrays(columns, ["part", "chunk", "pos", "id", "label", "codes", "floor", "high"])


def best_of(score: np.ndarray, fine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the places of the k highest scores among the fine ones, ties to smaller ids."""
    if score.shape[1] > k:
        worst = np.where(fine, score, LEAST)
        fine = fine & (score >= np.partition(worst, score.shape[1] - k, 1)[:, score.shape[1] - k, None])
    row, at = np.nonzero(fine)
    order = np.lexsort((ids[at], -score[row, at], row))
    row, at = row[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], at[rank < k]


def scanned(k: int, same_label: bool | None) -> Callable:
    """Blocks against the queries that need them: each query's k best of the block inside its window.

    ``same_label`` True keeps vectors of the query's label, False those of others, None all.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x_ids = numbers(batch, "id", row), numbers(batch, "x_id", row)
                score = scores(matrix(batch.column("codes")[row].values), matrix(batch.column("x_codes")[row].values))
                fine = (score >= numbers(batch, "floor", row)[:, None]) & (score <= numbers(batch, "high", row)[:, None]) & (ids[:, None] != x_ids)
                if same_label is not None:
                    fine &= (numbers(batch, "label", row)[:, None] == numbers(batch, "x_label", row)) == same_label
                at, found = best_of(score, fine, x_ids, k)
                chunk = np.full(len(at), batch.column("chunk")[row].as_py(), np.int64)
                columns = [chunk, numbers(batch, "pos", row)[at].astype(np.int32), x_ids[found], score[at, found]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "pos", "id", "score"])

    return scan


def search(asked: DataFrame, stored: DataFrame, index, table: Table, k: int, same_label: bool | None = None) -> DataFrame:
    """The k best of every query: ``chunk, pos, id, score, rank``; see the module for how.

    A query's place in its chunk is ``pos``. Highest scores come first, ties by smaller id.
    """
    shared = asked.sparkSession.sparkContext.broadcast(index)
    ranked = Window.partitionBy("chunk", "pos").orderBy(F.desc("score"), "id")
    best = asked.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    first, step = 0, 1
    while first < len(index.parts):
        reached = best.filter(F.col("rank") == k).groupBy("chunk").agg(F.collect_list(F.struct("pos", "score")).alias("kth"))
        needs = asked.join(reached, "chunk", "left").mapInArrow(planned(shared, table.space, first, first + step), NEED.format(kind=table.kind))
        # The estimate of what a plan needs is that of its queries, far too low to choose a broadcast by.
        found = needs.hint("merge").join(stored, "part").mapInArrow(scanned(k, same_label), FOUND)
        merged = found.union(best.drop("rank")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        best = cut_lineage(merged, "best")
        first, step = first + step, step * STEP
    return best


def answers(asked: DataFrame, best: DataFrame, columns: list[str]) -> DataFrame:
    """The answers of a search beside the named columns of their queries."""
    zipped = F.arrays_zip(*columns)
    queries = asked.select("chunk", F.posexplode(zipped).alias("pos", "ask")).select("chunk", "pos", *[F.col(f"ask.{c}").alias(f"ask_{c}") for c in columns])
    return queries.join(best, ["chunk", "pos"])
