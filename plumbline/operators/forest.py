"""Random forests of all rows, grown where the rows are and never gathered.

The method is that of Spark's forest: features cut into few bins by quantiles, each tree on its own Poisson
bootstrap, some features at a node drawn anew, the split of largest gini gain, siblings of one prediction
merged, leaf shares as votes. But the quantiles come from all rows, and rows of equal bins are one cell with
its counts by class: the sum of their bootstrap draws is a Poisson draw of the count. A task holds all
cells of a fit part, grows some of the trees level by level and adds up their votes on the held cells; only
these votes leave it. Cells are in an order of their own, and the draws of a tree depend on it and the tree
alone, so a forest depends neither on the number of tasks nor on how the rows arrived.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.running import running

#: Tasks that the trees of a forest are dealt to; each reads all cells.
TASKS = 32
#: Distinct values of a feature that thresholds are chosen from; of more, that many groups of neighbours.
VALUES = 10_000
#: Bytes of cells and counts that a task may hold; with them it needs some five times as much.
CELL_BYTES = 64 << 20
ROWS_PER_PARTITION, LEAST_PARTITIONS = 100_000, 8
NODES_AT_ONCE = 1 << 20  # numbers drawn at a time to choose features
LEAST_GAIN = 1e-14  # below it a gain is a rounding error
CELL = "cell binary, n0 long, n1 long"
SLICE = "slice long, cells binary, n0 binary, n1 binary"


@dataclass(frozen=True)
class Settings:
    """What a forest is grown by; ``weights`` are those of the two classes."""

    trees: int
    depth: int
    least: int
    gain: float
    strategy: str
    seed: int
    bins: int
    weights: tuple[float, float]


def settings(estimator: RandomForestClassifier, weights: tuple[float, float]) -> Settings | None:
    """The settings of Spark's estimator; none if it asks for something else than is grown here."""
    if (
        estimator.getImpurity() != "gini"
        or estimator.getSubsamplingRate() != 1.0
        or not estimator.getBootstrap()
        or estimator.getMinWeightFractionPerNode() != 0.0
        or estimator.getMaxBins() > 256
    ):
        return None
    return Settings(
        estimator.getNumTrees(),
        estimator.getMaxDepth(),
        estimator.getMinInstancesPerNode(),
        estimator.getMinInfoGain(),
        estimator.getFeatureSubsetStrategy(),
        estimator.getSeed(),
        estimator.getMaxBins(),
        weights,
    )


def features_at_a_node(strategy: str, features: int, trees: int) -> int:
    """How many features a node may split by, as Spark reads the strategy."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {
        "all": features,
        "sqrt": math.ceil(math.sqrt(features)),
        "log2": max(1, math.ceil(math.log2(features))),
        "onethird": math.ceil(features / 3),
    }
    if strategy in named:
        return named[strategy]
    if strategy.isdigit() and int(strategy):
        return min(features, int(strategy))
    if 0 < float(strategy) <= 1:
        return math.ceil(float(strategy) * features)
    raise ValueError(f"unknown feature subset strategy {strategy!r}")


def cuts(low: np.ndarray, high: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between ascending groups of values (lowest, highest, weight), at most ``bins - 1``, by Spark's rule."""
    middle = (high[:-1] + low[1:]) / 2
    if len(middle) < bins:
        return middle
    stride = weight.sum() / bins
    found, target, count = [], stride, weight[0]
    for i in range(1, len(weight)):
        before, count = count, count + weight[i]
        if abs(before - target) < abs(count - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def thresholds(rows: DataFrame, features: int, bins: int, weights: tuple[float, float]) -> list[np.ndarray]:
    """Thresholds of each feature from all rows of ``x`` and ``y``."""
    each = rows.select(F.posexplode("x").alias("feature", "value"), "y")
    counts = each.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n1"))
    total, distinct = rows.count(), {r["feature"]: r["count"] for r in counts.groupBy("feature").count().collect()}
    many = [j for j, n in distinct.items() if n > VALUES]
    groups = counts.where(~F.col("feature").isin(many)).select("feature", F.col("value").alias("low"), F.col("value").alias("high"), "n", "n1")
    if many:
        curve = running(counts.where(F.col("feature").isin(many)), keys=["feature"], order=["value"], sums={"through": F.col("n")})
        place = F.floor((F.col("through") - F.col("n")) * F.lit(VALUES) / F.lit(total)).alias("place")
        near = curve.groupBy("feature", place).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        groups = groups.unionByName(near.drop("place"))
    found = groups.orderBy("feature", "low").toArrow()
    feature, low, high, n, n1 = (found.column(c).to_numpy() for c in ("feature", "low", "high", "n", "n1"))
    weight = weights[0] * (n - n1) + weights[1] * n1
    return [cuts(low[feature == j], high[feature == j], weight[feature == j], bins) for j in range(features)]


def slices(rows: DataFrame, count: int, cut: Sequence[np.ndarray]) -> DataFrame:
    """The cells of all rows with their counts, ordered and packed some thousand to a row."""
    width = len(cut)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column(1).to_numpy(zero_copy_only=False) == 1
            codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cut)], 1).astype(np.uint8)
            found, of = np.unique(codes.view(f"V{width}").ravel(), return_inverse=True)
            ones, every = np.bincount(of, y, len(found)).astype(np.int64), np.bincount(of, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary()), pa.array(every - ones), pa.array(ones)], ["cell", "n0", "n1"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            n0, n1 = (batch.column(c).to_numpy().astype("<i8").tobytes() for c in (1, 2))
            values = b"".join(batch.column(0).to_pylist()), n0, n1
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([v], pa.binary()) for v in values], ["slice", "cells", "n0", "n1"])
            number += 1

    counted = rows.select("x", "y").mapInArrow(cells, CELL).groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    parts = max(LEAST_PARTITIONS, -(-count // ROWS_PER_PARTITION))
    return counted.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(packed, SLICE)


def cell_count(fit: DataFrame) -> int:
    """Cells of packed slices."""
    return (fit.agg(F.sum(F.octet_length("n0"))).first()[0] or 0) // 8


def fits_a_task(cells: int, features: int) -> bool:
    return cells * (features + 16) <= CELL_BYTES


@dataclass
class Level:
    """The nodes of one depth: drawn rows by class, where they split; children of the k-th that splits are 2k and 2k + 1."""

    zeros: np.ndarray
    ones: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    rank: np.ndarray


def gain_of(l0: np.ndarray, l1: np.ndarray, t0: np.ndarray, t1: np.ndarray, by: Settings) -> np.ndarray:
    """Gini gain where ``l0`` and ``l1`` of a node's ``t0`` and ``t1`` drawn rows go left; 0 where a side is too small."""
    (w0, w1), r0, r1 = by.weights, t0 - l0, t1 - l1
    total, left, right = w0 * t0 + w1 * t1, w0 * l0 + w1 * l1, w0 * r0 + w1 * r1
    with np.errstate(divide="ignore", invalid="ignore"):
        squares = ((w0 * l0) ** 2 + (w1 * l1) ** 2) / left + ((w0 * r0) ** 2 + (w1 * r1) ** 2) / right
    gain = squares / total - ((w0 * t0) ** 2 + (w1 * t1) ** 2) / total**2
    return np.where((l0 + l1 < by.least) | (r0 + r1 < by.least), 0.0, gain)


def best_by_counts(code: np.ndarray, b0: np.ndarray, b1: np.ndarray, node: np.ndarray, t0: np.ndarray, t1: np.ndarray, by: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the largest gain by one feature and the code that it is after, from counts of every code."""
    key, size = node * by.bins + code, (len(t0), by.bins)
    l0, l1 = (np.bincount(key, b, size[0] * size[1]).reshape(size).cumsum(1) for b in (b0, b1))
    gain = gain_of(l0, l1, t0[:, None], t1[:, None], by)
    at = gain.argmax(1)
    return gain[np.arange(len(at)), at], at


def best_by_order(code: np.ndarray, b0: np.ndarray, b1: np.ndarray, node: np.ndarray, t0: np.ndarray, t1: np.ndarray, by: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The same from the ordered codes of each node's rows, for nodes with fewer rows than codes."""
    gains, at = np.zeros(len(t0)), np.zeros(len(t0), np.int64)
    order = np.sort(node.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64) << np.uint64(32) | np.arange(len(node), dtype=np.uint64))
    group, row = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Where a node's next row has another code, the rows up to here may go left.
    stop = np.flatnonzero((group[1:] != group[:-1]) & (group[1:] >> 8 == group[:-1] >> 8))
    if not len(stop):
        return gains, at
    own, rows = group[stop] >> 8, np.bincount(node, minlength=len(t0))
    begin = (np.cumsum(rows) - rows)[own]
    c0, c1 = np.append(0, np.cumsum(b0[row])), np.append(0, np.cumsum(b1[row]))
    gain = gain_of(c0[stop + 1] - c0[begin], c1[stop + 1] - c1[begin], t0[own], t1[own], by)
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    most = np.maximum.reduceat(gain, start)
    best = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(start, len(own)))))
    best = best[np.append(True, own[best[1:]] != own[best[:-1]])]
    gains[own[start]], at[own[start]] = most, group[stop[best]] & 255
    return gains, at


def best_splits(codes: np.ndarray, b0: np.ndarray, b1: np.ndarray, node: np.ndarray, t0: np.ndarray, t1: np.ndarray, chosen: np.ndarray, by: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the largest gain, and its feature and highest code that goes left; every node has rows."""
    nodes, place = np.arange(len(t0)), np.arange(len(node))
    gains, features, at = np.zeros(len(t0)), np.full(len(t0), -1), np.zeros(len(t0), np.int64)
    best = best_by_counts if len(t0) * by.bins <= len(node) else best_by_order
    for i in range(chosen.shape[1]):
        gain, cut = best(codes[place, chosen[node, i]], b0, b1, node, t0, t1, by)
        better = gain > gains
        gains, at = np.where(better, gain, gains), np.where(better, cut, at)
        features = np.where(better, chosen[nodes, i], features)
    return gains, features, at


def grown(codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, by: Settings, tree: int) -> list[Level]:
    """One tree, level by level, on the tree's own draws of the cells."""
    rng = np.random.default_rng([by.seed & 0xFFFFFFFFFFFFFFFF, tree])
    b0, b1 = rng.poisson(n0), rng.poisson(n1)
    width = codes.shape[1]
    wanted = features_at_a_node(by.strategy, width, by.trees)
    used = np.flatnonzero(b0 + b1)
    codes, b0, b1 = codes[used], b0[used], b1[used]
    node, nodes, levels = np.zeros(len(used), np.int64), 1, []
    while nodes:
        t0, t1 = (np.bincount(node, b, nodes).astype(np.int64) for b in (b0, b1))
        level = Level(t0, t1, np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64))
        levels.append(level)
        open_ = (t0 > 0) & (t1 > 0) & (t0 + t1 >= 2 * by.least) & (len(levels) <= by.depth)
        if not open_.any():
            break
        kept = open_[node]
        codes, b0, b1, number = codes[kept], b0[kept], b1[kept], np.cumsum(open_) - 1
        node, count = number[node[kept]], int(open_.sum())
        if wanted < width:
            step = max(1, NODES_AT_ONCE // width)
            drawn = (rng.random((min(step, count - i), width)) for i in range(0, count, step))
            chosen = np.concatenate([np.argpartition(d, wanted - 1, 1)[:, :wanted].astype(np.int32) for d in drawn])
        else:
            chosen = np.broadcast_to(np.arange(width, dtype=np.int32), (count, width))
        gains, feature, at = best_splits(codes, b0, b1, node, t0[open_], t1[open_], chosen, by)
        split = (gains > LEAST_GAIN) & (gains >= by.gain)
        rank = np.cumsum(split) - 1
        whole = np.flatnonzero(open_)[split]
        level.feature[whole], level.cut[whole], level.rank[whole] = feature[split], at[split], rank[split]
        kept = split[node]
        codes, b0, b1, node = codes[kept], b0[kept], b1[kept], node[kept]
        right = codes[np.arange(len(node)), feature[node]] > at[node]
        node, nodes = 2 * rank[node] + right, 2 * int(split.sum())
    return levels


def votes(levels: list[Level], codes: np.ndarray, by: Settings) -> np.ndarray:
    """The share of ones in the leaf of each cell; siblings that are leaves of one prediction are none."""
    w0, w1 = by.weights
    inner: list[np.ndarray] = []
    below_leaf = below_one = np.empty(0, bool)
    for level in reversed(levels):
        split = np.flatnonzero(level.feature >= 0)
        leaf = level.feature < 0
        one = w1 * level.ones > w0 * level.zeros
        left, right = 2 * level.rank[split], 2 * level.rank[split] + 1
        leaf[split] = below_leaf[left] & below_leaf[right] & (below_one[left] == below_one[right]) if len(split) else leaf[split]
        inner.append(~leaf)
        below_leaf, below_one = leaf, one
    out, at, node = np.zeros(len(codes)), np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for level, goes_on in zip(levels, reversed(inner)):
        further = goes_on[node]
        done = node[~further]
        ones, zeros = w1 * level.ones[done], w0 * level.zeros[done]
        out[at[~further]] = ones / np.maximum(ones + zeros, 1e-300)
        at, node = at[further], node[further]
        right = codes[at, level.feature[node]] > level.cut[node]
        node = 2 * level.rank[node] + right
    return out


def scored(fit: DataFrame, held: DataFrame, features: int, by: Settings) -> DataFrame:
    """``_y, score`` of every row of the held slices by a forest grown on the fit slices."""
    tasks = min(TASKS, by.trees)

    def voted(group: int, parts: dict[bool, list]) -> Iterator[pa.RecordBatch]:
        def cells(part: list) -> np.ndarray:
            return np.frombuffer(b"".join(p[1] for p in part), np.uint8).reshape(-1, features)

        own, held_ = sorted(parts[False]), sorted(parts[True])
        if not held_:
            return
        n0, n1 = (np.frombuffer(b"".join(p[i] for p in own), "<i8") for i in (2, 3))
        codes, asked = cells(own), cells(held_)
        total = np.zeros(len(asked))
        for tree in range(group, by.trees, tasks):
            total += votes(grown(codes, n0, n1, by, tree), asked, by)
        at = 0
        for number, packed, *_ in held_:
            size = len(packed) // features
            columns = [pa.array([v], pa.int64()) for v in (number, group)] + [pa.array([total[at : at + size].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "group", "votes"])
            at += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, {False: [], True: []}
        for batch in batches:
            for group, is_held, *rest in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group != current:
                    if current is not None:
                        yield from voted(current, parts)
                    current, parts = group, {False: [], True: []}
                parts[is_held].append(rest)
        if current is not None:
            yield from voted(current, parts)

    def added(of: pa.Table, own: pa.Table) -> pa.Table:
        n0, n1 = (np.frombuffer(own.column(c)[0].as_py(), "<i8") for c in ("n0", "n1"))
        total = np.zeros(len(n0))
        for _, values in sorted(zip(of.column("group").to_pylist(), of.column("votes").to_pylist())):
            total += np.frombuffer(values)
        score = np.repeat(np.tile(total / by.trees, 2), np.concatenate([n0, n1]))
        y = np.repeat(np.array([0, 1], np.int32), [n0.sum(), n1.sum()])
        return pa.table([pa.array(y), pa.array(score)], names=["_y", "score"])

    both = fit.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    dealt = both.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select("group", "held", "slice", "cells", "n0", "n1")
    dealt = dealt.repartitionById(tasks, "group").sortWithinPartitions("group", "held", "slice")
    each = dealt.mapInArrow(run, "slice long, group long, votes binary")
    return each.groupBy("slice").cogroup(held.groupBy("slice")).applyInArrow(added, "_y int, score double")
