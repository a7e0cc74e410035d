"""A linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram bucket in a text. The counts of every bucket, for each
label, are summed over the labelled training rows of up to ``KEYS_PER_LABEL`` keys; they give the
log-count ratio that scales the bucket. Buckets that say most about the label, by the
likelihood-ratio statistic, are kept, up to a fixed number. Logistic regression on the scaled
features of a smaller sample then gives the weights. Both samples are the keys with the smallest
hashes, few enough to be sent to every task, so no text is shuffled. Whole texts are scored; the
model has one number a bucket.

Defined results: a missing text is empty and scores like one. Label rows without a label or key
are not used; a key that is labelled more than once counts once a label. Without a row of
either label every score is the share of toxic rows, or 0 without any. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, slices, table, texts
from plumbline.llm.ngrams import Grams

ORDERS = (3, 4, 5)
BITS = 19
SLICE_BYTES = 4 << 20
#: Keys of each label whose texts are counted, and those of them that the regression is fitted on.
KEYS_PER_LABEL = 100_000
ROWS_PER_LABEL = 5_000
KEPT_BUCKETS = 20_000
SMOOTHING = 1.0
#: Places of the regression's rows that are computed with at a time, about.
PLACES_AT_ONCE = 1 << 19
PENALTY = 1e-3
#: Marks of pairs of a text and a wanted bucket that are held at a time, a byte each.
MARKS = 1 << 20


def present(batch: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs of a batch, of wanted buckets only, in order.

    A few texts at a time, each pair has a mark of its own, so that repeated n-grams need no sort.
    """
    kept = np.flatnonzero(wanted)
    place, width = np.zeros(len(wanted), np.int32), max(1, len(kept))
    place[kept] = np.arange(len(kept))
    some, found = max(1, MARKS // width), [np.empty(0, np.int64)]
    for first in range(0, len(batch), some):
        grams = Grams(batch[first : first + some], ORDERS, BITS)
        marks = np.zeros(len(grams.ends) * width, bool)
        for start, bucket in grams:
            at = np.flatnonzero(wanted[bucket])
            begins = np.searchsorted(at, np.append(0, grams.ends) - start)
            marks[np.repeat(np.arange(len(grams.ends)) * width, np.diff(begins)) + place[bucket[at]]] = True
        found.append(np.flatnonzero(marks) + first * width)
    pairs = np.concatenate(found)
    owner = pairs // width
    return owner, kept[pairs - owner * width]


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """How often each bucket occurs in texts of each label (0 and 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            label = np.asarray(batch.column(1).to_pylist(), bool)
            body = texts(batch)
            for y in (0, 1):
                for _, bucket in Grams([t for t, z in zip(body, label) if z == y], ORDERS, BITS):
                    counts[y] += np.bincount(bucket, minlength=(1 << BITS) + 1)
        counts = counts[:, :-1]
        seen = np.flatnonzero(counts.sum(0))
        for part in np.array_split(seen, 1 + len(seen) // 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0][part]), pa.array(counts[1][part])], ["bucket", "clean", "toxic"])

    sums = labelled.select("text", "label").mapInArrow(run, "bucket long, clean long, toxic long")
    return sums.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def statistic(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Likelihood-ratio statistic of each bucket against the label, out of all n-grams of either."""
    total, rows = clean + toxic, n_clean + n_toxic

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    out = term(clean, total * n_clean / rows) + term(toxic, total * n_toxic / rows)
    return out + term(n_clean - clean, (rows - total) * n_clean / rows) + term(n_toxic - toxic, (rows - total) * n_toxic / rows)


def logistic(ends: np.ndarray, value: np.ndarray, column: np.ndarray, label: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sparse rows, by accelerated gradient steps.

    ``column`` has the columns of all rows, each row's up to its place in ``ends``; ``value`` is what a row that
    has a column has there. Places are held in the order of rows and, block by block, of columns, so that sums
    need neither a group's number for each place nor much memory at once.
    """
    n, places = len(label), np.arange(0, len(column), PLACES_AT_ONCE)
    lengths = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), lengths)
    column = column.astype(np.min_scalar_type(width))
    owner_back, column_back = owner.copy(), column.copy()
    for i in places:
        block = slice(i, i + PLACES_AT_ONCE)
        order = np.argsort(column[block], kind="stable")
        owner_back[block], column_back[block] = owner[block][order], column[block][order]

    def parts(groups: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Where the places of a block begin and end, the groups in it, and where each begins."""
        out = []
        for i in places:
            own = groups[i : i + PLACES_AT_ONCE]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out.append((i, i + len(own), own[begin].astype(np.int64), begin))
        return out

    by_row, by_column = parts(owner), parts(column_back)
    del owner, column_back

    def summed(values: np.ndarray, of: np.ndarray, blocks: list, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i, j, groups, begin in blocks:
            out[groups] += np.add.reduceat(values[of[i:j]], begin)
        return out

    def sums(of_columns: np.ndarray) -> np.ndarray:
        """Of each row over its columns."""
        return summed(of_columns, column, by_row, n)

    def sums_back(of_rows: np.ndarray) -> np.ndarray:
        """Of each column over the rows that have it."""
        return summed(of_rows, owner_back, by_column, width)

    x = sums(value * value)
    step = 1.0 / (0.25 * max(1.0, float(np.percentile(x, 99))) + PENALTY)
    prior = float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    w, bias, w_old, bias_old = np.zeros(width), prior, np.zeros(width), prior
    for i in range(400):
        ahead = i / (i + 3)
        v, c = w + ahead * (w - w_old), bias + ahead * (bias - bias_old)
        margin = sums(value * v) + c
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
        w_old, bias_old = w, bias
        w = v - step * (value * sums_back(error) / n * 20 + PENALTY * v)
        bias = c - step * error.mean() * 20
    return w, bias


@dataclass(frozen=True)
class Model:
    """A weight for each bucket, most of them zero, and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, batch: list[str]) -> np.ndarray:
        owner, bucket = present(batch, self.weights != 0)
        margin = np.bincount(owner, self.weights[bucket], minlength=len(batch)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def sampled_keys(labels: DataFrame, keys_per_label: int) -> DataFrame:
    """``key``, ``label`` and the key's ``rank`` by hash, for the first keys of each label."""
    found = []
    for y in (0, 1):
        own = labels.filter(F.col("label") == y).select("key").distinct()
        own = own.orderBy(F.xxhash64("key"), "key").limit(keys_per_label).toArrow()
        found.append(own.append_column("label", pa.array(np.full(len(own), y))).append_column("rank", pa.array(np.arange(len(own)))))
    kind = labels.schema["key"].dataType.simpleString()
    return labels.sparkSession.createDataFrame(pa.concat_tables(found), f"key {kind}, label long, rank long")


def train(docs: DataFrame, labels: DataFrame, keys_per_label: int | None = None, rows_per_label: int | None = None, kept_buckets: int = KEPT_BUCKETS) -> Model:
    """The model learned from ``docs`` (key, text) and ``labels`` (key, label 0 or 1)."""
    labels = labels.filter("key IS NOT NULL AND label IN (0, 1)")
    chosen = F.broadcast(sampled_keys(labels, keys_per_label or KEYS_PER_LABEL))
    rows_per_label = rows_per_label or ROWS_PER_LABEL
    labelled = docs.join(chosen, "key").select("text", "label")
    # Only keys move to learn the share of each label.
    totals = {r["label"]: r["n"] for r in labels.join(docs.select("key"), "key").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    weights = np.zeros((1 << BITS) + 1)
    if not n_clean or not n_toxic:
        return Model(weights, 40.0 if n_toxic else -40.0)
    counted = bucket_counts(labelled).toArrow()  # a row for each bucket at most
    bucket, clean, toxic = (np.asarray(counted.column(i)) for i in range(3))
    best = np.lexsort((bucket, -statistic(clean, toxic, int(clean.sum()), int(toxic.sum()))))[:kept_buckets]
    bucket, clean, toxic = bucket[best], clean[best], toxic[best]
    ratio = np.log((toxic + SMOOTHING) / (toxic + SMOOTHING).sum()) - np.log((clean + SMOOTHING) / (clean + SMOOTHING).sum())
    wanted = np.zeros((1 << BITS) + 1, bool)
    wanted[bucket] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            owner, found = present(texts(batch), wanted)
            lists = np.split(found.astype(np.int32), np.searchsorted(owner, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(lists, pa.list_(pa.int32()))], ["key", "label", "copy", "buckets"])

    # One row for a key and label, however often it is repeated; only the kept buckets of a text move.
    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.join(chosen.filter(F.col("rank") < rows_per_label), "key").select("text", "key", "label", F.xxhash64("text").alias("copy"))
    rows = rows.mapInArrow(features, f"key {kind}, label long, copy long, buckets array<int>")
    rows = rows.groupBy("key", "label").agg(F.min(F.struct("copy", "buckets")).alias("row")).select("label", "row.buckets").toArrow()
    label = np.asarray(rows.column("label"), float)
    lists = rows.column("buckets").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    place = np.zeros(1 << BITS, np.int32)
    place[bucket] = np.arange(len(bucket))
    column = place[np.asarray(lists.values)[offsets[0] : offsets[-1]]]
    del rows, lists  # the columns are all that is needed
    w, intercept = logistic(offsets[1:] - offsets[0], ratio, column, label, len(bucket))
    # The sample has more toxic rows than the table: the intercept goes back to the table's share.
    shares = np.log(n_toxic / n_clean) - np.log(max(1, label.sum()) / max(1, len(label) - label.sum()))
    weights[bucket] = w * ratio
    return Model(weights, float(intercept + shares))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts(batch)))], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learned from labelled documents outside the held-out fold."""
    known = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text")).filter(~held_out(F.col("key"), 5, 0))
    marks = labels.select(F.col("doc_id").alias("key"), F.col("toxic").cast("long").alias("label"))
    return train(known, marks.filter(~held_out(F.col("key"), 5, 0)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
