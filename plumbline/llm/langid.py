"""Language identification: the family first, then linear support vector machines within it.

Features are the frequencies of hashed character n-grams of a whole text. One machine per family
against the rest chooses the family; inside a family every pair of languages has a machine of its
own, and the language that wins most of its pairs is predicted, by the larger sum of margins
where wins are equal. Machines minimise the squared hinge loss with an L2 penalty; each training
document takes part as a whole and with its opening words, so that short texts are learned too.

Defined results: a text that is missing or has no letter is ``und`` with score 0, as is every
text where nothing could be learned. Rows without a language are not learned from. Languages that
the table of families doesn't list form a family each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import held_out, slices, table, texts
from plumbline.llm.ngrams import Grams

# Families of common languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl mk be".split(),
    "uralic": "fi hu et".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "turkic": "tr az kk uz".split(),
    "semitic": "ar he mt am".split(),
}
UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BITS = 12
SLICE_BYTES = 4 << 20
TEXTS_AT_ONCE = 512
#: Training documents of each language, distinct keys with the smallest hash, and of all together.
ROWS_PER_LANGUAGE, ROWS = 300, 6_000
OPENING = 60
PENALTY, STEPS, SLOPE = 1e-3, 300, 3.0


def frequencies(batch: list[str]) -> np.ndarray:
    """Each text's share of every bucket."""
    width = (1 << BITS) + 1
    counts = np.zeros(len(batch) * width, np.int64)
    grams = Grams(batch, ORDERS, BITS)
    for start, bucket in grams:
        first, last = grams.owners(np.array([start, start + len(bucket) - 1]))
        stops = np.minimum(grams.ends[first : last + 1], start + len(bucket)) - start
        owner = np.repeat(np.arange(first, last + 1), np.diff(stops, prepend=0))
        low = first * width
        part = np.bincount(owner * width + bucket - low)
        counts[low : low + len(part)] += part
    counts = counts.reshape(-1, width)[:, :-1]
    return (counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last one for the constant, of a linear machine with squared hinge loss; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    step = 1 / (2 * float((balance * (x * x).sum(1)).sum()) + PENALTY)
    w = old = np.zeros(x.shape[1], x.dtype)
    for i in range(STEPS):
        v = w + i / (i + 3) * (w - old)
        gap = np.maximum(0, 1 - y * (x @ v))
        old, w = w, v - step * (PENALTY * v - 2 * x.T @ (balance * y * gap))
    return w


@dataclass(frozen=True)
class Model:
    """Languages by family and the machines: a column for each family, then one for each pair."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for i in range(0, len(batch), TEXTS_AT_ONCE):
            part = batch[i : i + TEXTS_AT_ONCE]
            margins = frequencies(part) @ self.weights[:-1] + self.weights[-1]
            chances = 1 / (1 + np.exp(-np.clip(SLOPE * margins, -40, 40)))
            for text, margin, chance in zip(part, margins, chances):
                language, score = self.choose(margin, chance) if any(map(str.isalpha, text)) else (UNDETERMINED, 0.0)
                languages.append(language)
                scores.append(score)
        return languages, scores

    def choose(self, margin: np.ndarray, chance: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNDETERMINED, 0.0
        n = len(self.families)
        family = int(margin[:n].argmax())
        sure = float(chance[family] / chance[:n].sum()) if n > 1 else 1.0
        wins = {language: [0, 0.0, 0.0] for language in self.families[family]}
        for (a, b), m, p in zip(self.pairs, margin[n:], chance[n:]):
            if a in wins:
                for language, sign, share in ((a, 1, p), (b, -1, 1 - p)):
                    wins[language][0] += sign * m > 0
                    wins[language][1] += sign * m
                    wins[language][2] += share
        best = max(sorted(wins), key=lambda x: wins[x][:2])
        return best, sure * (float(wins[best][2]) / (len(wins) - 1) if len(wins) > 1 else 1.0)


def train(docs: DataFrame, families: dict[str, list[str]] = FAMILIES) -> Model:
    """The model learned from ``docs`` (key, text, lang)."""
    spark = docs.sparkSession
    known = docs.filter("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    # Distinct ids, ranked by hash: only each task's smallest hashes of a language go to the ranking.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "key"))
    each = min(ROWS_PER_LANGUAGE, max(2, ROWS // max(1, len(languages))))
    keys = known.select("key", "lang").distinct().withColumn("order", F.xxhash64("key")).withColumn("place", place).filter(F.col("place") <= each)
    chosen = spark.createDataFrame(keys.select("key", "lang").toArrow()) if languages else keys.select("key", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            body, lang = texts(batch), batch.column(1)
            for i in range(0, len(body), TEXTS_AT_ONCE // 2):
                part = body[i : i + TEXTS_AT_ONCE // 2]
                rows = frequencies([*part, *(t[:OPENING] for t in part)])
                flat = pa.array(rows.ravel())
                lists = pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(pa.float32()))
                label = lang.slice(i, len(part))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([label, label]), lists], ["lang", "x"])

    # One row stands for a key in its language, however often it is repeated; this bounds what is collected.
    rows = known.join(F.broadcast(chosen), ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    rows = rows.select("text", "lang").mapInArrow(features, "lang string, x array<float>").toArrow()
    width = 1 << BITS
    label = np.array(rows.column("lang").to_pylist(), object)
    if not len(label):
        return Model([], [], np.zeros((width + 1, 1)))
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, width)
    scale = (1 / (x.std(0) + 1e-4)).astype(np.float32) / 8
    x = x * scale
    groups = {name: [v for v in languages if v in members] for name, members in families.items()}
    listed = {v for members in groups.values() for v in members}
    own = [members for members in groups.values() if members] + [[v] for v in languages if v not in listed]
    family_of = {v: i for i, members in enumerate(own) for v in members}
    family = np.array([family_of[v] for v in label])
    columns, pairs = [], []
    for i in range(len(own)):
        columns.append(machine(x, np.where(family == i, 1, -1).astype(np.float32)) if len(own) > 1 else np.ones(width + 1))
    for members in own:
        for a, b in combinations(members, 2):
            inside = (label == a) | (label == b)
            columns.append(machine(x[inside], np.where(label[inside] == a, 1, -1).astype(np.float32)))
            pairs.append((a, b))
    weights = np.stack(columns, 1)
    weights[:-1] *= scale[:, None]
    return Model(own, pairs, weights)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``lang_pred`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            languages, scores = model.predict(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def trained(docs: DataFrame) -> Model:
    """The model learned from the documents outside the held-out fold."""
    known = docs.select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return train(known.filter(~held_out(F.col("key"), 5, 0)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained(docs)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
