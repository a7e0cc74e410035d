"""Packing documents into sequences by non-negative least squares over the length histogram.

A document of n tokens is cut where it must be: whole windows first, then the largest part that
is a multiple of ``GRAIN`` tokens, then what is left, shorter than a grain. So there are
window / grain lengths of long parts and grain - 1 lengths of tails, and the same solver works
on both: tails combine into whole grains, grains and long parts into whole windows. For each
level all shallow combinations of lengths that fill the whole exactly are listed, a
non-negative least squares fit chooses how often to use each against the histogram, and the
repeats are rounded down. What remains is packed greedily by counts: a pattern is filled with the
longest part that still fits and then repeated as often as the counts allow.

Only the histogram reaches the driver; its size is the window's, whatever the table's. A part's
sequence and offset follow from its rank among the parts of its length; ranks come from counts
of blocks and a window inside each block, so a length that most parts share spreads over tasks.

Defined results: a missing text is empty; an empty document is its end token. Rows that are
equal in every way are interchangeable and each gets a place. An empty table gives no parts.
Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import bpe
from plumbline.llm.common import slices, table, texts
from plumbline.session import cut_lineage

WINDOW = 2048
GRAIN = 64
END = 1
DEPTH = 4
#: The tokenizer, and its vocabulary as ranks: between its added tokens both give the same ids.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS_PER_BLOCK = 200_000
#: The library's pattern fails on about a million white-space characters in a row.
LONG_SPACE = 60_000
SPACE_RUN = re.compile(r"\s{%d}" % LONG_SPACE)


class TokenEncoder:
    """Texts to packed ids by the library; the merge replay takes texts on which its pattern runs out of stack.

    The tokenizer's added tokens are found in a text before anything else and cut it, as its own library does.
    """

    def __init__(self, path: str, tokenizer: str):
        self.path = path
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        with open(tokenizer, encoding="utf-8") as text:
            self.added = {t["content"]: t["id"] for t in json.load(text)["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None

    def encode(self, text: str) -> bytes:
        if not self.cut or not self.cut.search(text):
            return self.ordinary(text)
        parts = self.cut.split(text)  # every second one is an added token
        return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else self.ordinary(p) for i, p in enumerate(parts))

    def ordinary(self, text: str) -> bytes:
        if len(text) >= LONG_SPACE and SPACE_RUN.search(text):
            return bpe.replay_encoder(self.path).encode([text])[0]
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()


_ENCODERS: dict[tuple[str, str], TokenEncoder] = {}


def token_encoder(path: str, tokenizer: str = TOKENIZER) -> TokenEncoder:
    """This worker's encoder for a rank file and the tokenizer it belongs to."""
    if (path, tokenizer) not in _ENCODERS:
        _ENCODERS[path, tokenizer] = TokenEncoder(path, tokenizer)
    return _ENCODERS[path, tokenizer]


def cuts(n: int, window: int, grain: int) -> list[tuple[int, int]]:
    """Start and length of each part of a document of n tokens."""
    parts = [(i, window) for i in range(0, n - n % window, window)]
    at = n - n % window
    long = (n - at) - (n - at) % grain
    if long:
        parts.append((at, long))
    if (n - at) % grain:
        parts.append((at + long, (n - at) % grain))
    return parts


def tokenized_parts(docs: DataFrame, key: str, text: str, ranks: str, window: int, grain: int) -> DataFrame:
    """Every document's parts: key, start, length, checksum of the ids, and the document's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = token_encoder(ranks), np.array([END], "<u4").tobytes()
        for batch in slices(batches, "text", bpe.SLICE_BYTES):
            owner, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(texts(batch)):
                ids = encoder.encode(value) + end
                for at, n in cuts(len(ids) // 4, window, grain):
                    owner.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    total.append(len(ids) // 4)
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(whole: int, lengths: list[int], depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` lengths with the sum ``whole``, longest first."""
    found = []

    def extend(chosen: tuple[int, ...], left: int, i: int) -> None:
        if not left:
            found.append(chosen)
        elif len(chosen) < depth:
            for k in range(i, len(lengths)):
                if lengths[k] <= left:
                    extend((*chosen, lengths[k]), left - lengths[k], k)

    lengths = sorted(lengths, reverse=True)
    extend((), whole, 0)
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1] + 10):
        gain = np.where(active, -np.inf, a.T @ (b - a @ x))
        if not len(gain) or gain.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[gain.argmax()] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            below = active & (trial <= 0)
            if not below.any():
                break
            step = np.min(x[below] / np.maximum(x[below] - trial[below], 1e-300))
            x = np.maximum(x + step * (trial - x), 0)
            active &= x > 1e-12
        x = trial
    return x


@dataclass(frozen=True)
class Repeat:
    """``count`` wholes, each of these lengths in this order."""

    lengths: tuple[int, ...]
    count: int


def fit(whole: int, counts: dict[int, int], depth: int) -> list[Repeat]:
    """Combinations that fill the whole exactly, repeated within the counts."""
    lengths = sorted(n for n, c in counts.items() if c > 0)
    listed = combinations(whole, lengths, depth)
    if not listed:
        return []
    row = {n: i for i, n in enumerate(lengths)}
    a = np.zeros((len(lengths), len(listed)))
    for j, chosen in enumerate(listed):
        for n in chosen:
            a[row[n], j] += 1
    b = np.array([counts[n] for n in lengths], float)
    weights = nnls(a / b.max(), b / b.max())
    left, plan = dict(counts), []
    # Rounded down, and never beyond what is there; then once more for what rounding left over.
    for pick in (weights, np.full(len(listed), np.inf)):
        for j in np.argsort(-weights, kind="stable"):
            needs = Counter(listed[j])
            repeats = int(min([pick[j], *(left[n] // k for n, k in needs.items())]))
            if repeats > 0:
                plan.append(Repeat(listed[j], repeats))
                for n, k in needs.items():
                    left[n] -= k * repeats
    return plan


def fill(whole: int, counts: dict[int, int]) -> list[Repeat]:
    """Patterns of the longest lengths that still fit, until nothing is left."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        room, chosen = whole, Counter()
        for n in sorted(left, reverse=True):
            k = min(left[n], room // n)
            if k:
                chosen[n] = k
                room -= k * n
        repeats = min(left[n] // k for n, k in chosen.items())
        plan.append(Repeat(tuple(sorted(chosen.elements(), reverse=True)), repeats))
        left = {n: c - chosen[n] * repeats for n, c in left.items() if c > chosen[n] * repeats}
    return plan


def used(plan: list[Repeat]) -> Counter:
    total = Counter()
    for r in plan:
        for n in r.lengths:
            total[n] += r.count
    return total


def places(plan: list[Repeat], first: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first whole, offset) for each place of each repeat, ranks counted by length."""
    seen, out = Counter(), []
    for r in plan:
        offset = 0
        for n in r.lengths:
            out.append((n, seen[n], r.count, first, offset))
            seen[n] += r.count
            offset += n
        first += r.count
    return out


def plan(counts: dict[int, int], window: int, grain: int, depth: int) -> tuple[list, list]:
    """Places of tails in grains and of everything else in sequences.

    The first list places tails in numbered grains; such a grain then takes part as a length of
    one grain, ranked after the table's own. The second list places lengths in sequences.
    """
    tails = {n: c for n, c in counts.items() if n < grain}
    inner = fit(grain, tails, depth)
    made = sum(r.count for r in inner)
    rest = Counter(tails) - used(inner)
    long = Counter({n: c for n, c in counts.items() if n >= grain})
    long[grain] += made
    outer = fit(window // grain, {n // grain: c for n, c in long.items() if c}, depth)
    outer = [Repeat(tuple(n * grain for n in r.lengths), r.count) for r in outer]
    rest += long - used(outer)
    return places(inner, 0), places(outer + fill(window, rest), 0)


def ranked(parts: DataFrame, blocks: int) -> DataFrame:
    """Each part's rank among the parts of its length, without a length in one task."""
    block = F.pmod(F.xxhash64("key", "start"), F.lit(blocks))
    rows = parts.withColumn("block", block)
    sums = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("key", "start", "ids_crc32", "doc_tokens")
    return rows.withColumn("k", F.row_number().over(inside) - 1).join(sums, ["length", "block"]).withColumn("rank", F.col("before") + F.col("k"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Every part's place: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Sequences hold at most ``window`` tokens, a multiple of ``grain``; offsets have no gaps.
    """
    if window % grain:
        raise ValueError("the window is a multiple of the grain")
    spark = docs.sparkSession
    parts = cut_lineage(tokenized_parts(docs, key, text, ranks, window, grain), "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    inner, outer = plan(counts, window, grain, depth)
    schema = "p_length long, p_from long, p_count long, p_first long, p_offset long"
    # At most depth places for each combination in use, and of those no more than lengths.
    small = lambda rows: F.broadcast(spark.createDataFrame(rows, schema))
    placed_at = lambda length, rank: (F.col("p_length") == length) & (rank >= F.col("p_from")) & (rank < F.col("p_from") + F.col("p_count"))
    rows = ranked(parts, 64 + sum(counts.values()) // PARTS_PER_BLOCK)
    own = counts.get(grain, 0)
    taken: Counter = Counter()
    for n, _, count, _, _ in inner:
        taken[n] += count
    # Tails left over are ranked anew, after those that went into grains.
    past = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in taken.items() for x in pair]), F.col("length")), F.lit(0)) if taken else F.lit(0)
    made = F.col("p_first").isNotNull()
    units = rows.join(small(inner), placed_at(F.col("length"), F.col("rank")), "left").select(
        "key",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.when(made, F.lit(grain)).otherwise(F.col("length")).alias("unit"),
        F.when(made, own + F.col("p_first") + F.col("rank") - F.col("p_from")).otherwise(F.col("rank") - past).alias("unit_rank"),
        F.coalesce("p_offset", F.lit(0)).alias("inner"),
    )
    return units.join(small(outer), placed_at(F.col("unit"), F.col("unit_rank"))).select(
        F.col("key").alias(key),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("p_first") + F.col("unit_rank") - F.col("p_from")).alias("sequence_id"),
        (F.col("p_offset") + F.col("inner")).alias("offset"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's parts in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
