"""Resampling documents by importance towards a target distribution of hashed n-grams.

An untrained pre-tokeniser of the tokenizers library splits the ASCII-lowered text with a regular
expression and gives words with their offsets. Windows over the offset pairs are the features, runs
of 1 to ``NGRAMS`` words joined by one space; crc32 puts each into a bucket. Two histograms, of all
documents and of all target texts, give every bucket an integer gain, a scaled log ratio with one
added to each count. A document's weight is the floored mean of its features' gains; with Gumbel
noise from a hash of its id, the highest scores are a sample without replacement by weight.

Texts are tokenised once: the buckets of each document are written and read again for the weights. The
histograms (a number per bucket) and the counts by score (a bounded range of integers) are all that
is brought together; ranks come from those counts and an order inside one score.

Defined results: a missing text has no words; a document without features has weight 0. A missing id
hashes as the empty one and comes last among ties. Rows that are equal in id, features and weight
are interchangeable, each has a rank of its own. Very long texts are cut at separators for the
library, which changes no word. Without target texts the gains are those of an empty histogram. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from plumbline.llm.common import slices, table, texts
from plumbline.session import cut_lineage

NGRAMS, BUCKETS = 1, 10_000
SCALE, SEED = 1000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: What stands between words, once A-Z are lowered.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SLICE = 4_000_000  # bytes of text in hand at a time
PIECE = 1_000_000  # characters given to the library at once
REMEMBERED = 100_000  # features whose bucket is kept at hand
LONGEST = 64  # bytes of such a feature

_BREAK = re.compile(SEPARATOR)


def pieces(text: str, size: int) -> Iterator[str]:
    """The text, cut at separators into parts of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = _BREAK.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


class Hasher:
    """Texts to the buckets of their features; one for a worker."""

    def __init__(self, ngrams: int, buckets: int, piece: int) -> None:
        self.ngrams, self.buckets, self.piece = ngrams, buckets, piece
        self.splitter = pre_tokenizers.Split(Regex(SEPARATOR + "+"), "removed")
        self.known: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            data = feature.encode()
            found = zlib.crc32(data) % self.buckets
            if len(data) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[feature] = found
        return found

    def features(self, text: str) -> tuple[int, list[int]]:
        """Number of words, and the bucket of every run of 1 to ``ngrams`` words."""
        words, out, carried = 0, [], []
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        bucket = self.bucket
        for piece in pieces(lowered, self.piece):
            found = self.splitter.pre_tokenize_str(piece)
            words += len(found)
            out += [bucket(word) for word, _ in found]
            if self.ngrams > 1:
                # Windows over the offset pairs; the last words of a piece begin windows that end in the next.
                spans = carried + [(piece, offsets) for _, offsets in found]
                for length in range(2, self.ngrams + 1):
                    for i in range(len(spans) - length + 1):
                        if i + length > len(carried):
                            out.append(bucket(" ".join(p[a:b] for p, (a, b) in spans[i : i + length])))
                carried = [(p[a:b], (0, b - a)) for p, (a, b) in spans[1 - self.ngrams :]]
        return words, out


_HASHERS: dict[tuple[int, int, int], Hasher] = {}


def hashed(docs: DataFrame, key: str | None, text: str, ngrams: int, buckets: int) -> DataFrame:
    """``n_words`` and the array ``buckets`` of each row's features, beside its id."""
    piece = PIECE
    rows = docs.select((F.lit(None) if key is None else F.col(key)).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def hash_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _HASHERS.setdefault((ngrams, buckets, piece), Hasher(ngrams, buckets, piece))
        for batch in slices(batches, "text", SLICE):
            words, lists = zip(*map(hasher.features, texts(batch)))
            lists = pa.array([np.array(x, np.int32) for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), lists], ["doc_id", "n_words", "buckets"])

    return rows.mapInArrow(hash_texts, "doc_id long, n_words long, buckets array<int>")


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: counts by task, then their sums."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("buckets").flatten()), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratios of the target's share of a bucket to that of the documents, floored."""
    n, s, t = float(len(documents)), documents.astype(np.float64), target.astype(np.float64)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``n_features`` and ``weight`` of each row in the place of its buckets."""

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(gain[np.asarray(lists.flatten())])])
            bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            n = np.diff(bounds)
            weight = (ends[bounds[1:]] - ends[bounds[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise from the id, scaled and floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` for the highest scores among rows with enough words, null for the rest.

    Equal rows are counted first, so one row on a third of the table is a row a task. Counts by
    score, of which there are no more than gains and noise can make (some 200,000), give the number
    before each score; an order by id inside a score gives the rest.
    """
    same = ["doc_id", "n_features", "weight", "score"]
    long_enough = F.col("n_words") >= least_words
    counted = cut_lineage(scored.withColumn("able", long_enough).groupBy(*same, "able").agg(F.count("*").alias("copies")), "counted")
    able = counted.filter("able")
    totals = able.groupBy("score").agg(F.sum("copies").alias("n")).collect()
    quota = percent * sum(r["n"] for r in totals) // 100
    before, ahead = [], 0
    for score, n in sorted(((r["score"], r["n"]) for r in totals), reverse=True):
        if ahead >= quota:
            break
        before.append((score, ahead))
        ahead += n
    start = scored.sparkSession.createDataFrame(before, "score long, ahead long")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    reached = able.join(F.broadcast(start), "score")
    first = F.col("ahead") + F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    reached = reached.withColumn("first", first).select(*same, "able", "copies", "first")
    rest = counted.join(F.broadcast(start.select("score")), "score", "left_anti").union(able_not(counted, start))
    rest = rest.select(*same, "able", "copies", F.lit(None).cast("long").alias("first"))
    # Equal rows are as many rows again; a count is cut into thousands first, so that one isn't a single task's.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000")))
    every = reached.union(rest).withColumn("block", blocks)
    every = every.withColumn("copy", F.explode(F.sequence(F.col("block") * 1000, F.least(F.col("copies") - 1, F.col("block") * 1000 + 999))))
    place = F.col("first") + F.col("copy") + 1
    return every.select(*same, F.when(place <= quota, place).alias("rank"))


def able_not(counted: DataFrame, start: DataFrame) -> DataFrame:
    """Rows that may not be drawn though their score is among the drawn ones."""
    return counted.filter("NOT able").join(F.broadcast(start.select("score")), "score", "left_semi")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document with ``n_features, weight, score`` and its ``rank`` among the drawn, else null."""
    rows = cut_lineage(hashed(docs, key, text, ngrams, buckets), "buckets")
    gain = gains(histogram(rows, buckets), histogram(hashed(target, None, target_text, ngrams, buckets), buckets))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, percent, least_words).withColumnRenamed("doc_id", key)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` drawn towards the words of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
