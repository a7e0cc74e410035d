"""Byte-level BPE by replaying merges over a corpus, and the way back.

Each task takes its rows in slices of a bounded size. Of a slice, every distinct word goes once
through the replay: all words lie in one chain of tokens, an inverted index holds for each merge
the positions where it applies, and merges are taken in rank order. A merge touches its own two
neighbours and nothing else. Results of short units are kept for later slices up to a number of bytes.

Text is cut into units where the pattern cuts anyway: before a space that follows something other
than white space, and before single spaces in general. Units are then cut by the pattern. Encoding
and decoding share one pass over the rows where both are wanted.

Defined results: a missing text is empty and has no tokens. Rows are independent, so ties and
repeated rows need no rule. Ids are packed as little-endian unsigned 32-bit numbers, so a long
text is one binary value. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SLICE_BYTES = 4 << 20
KEPT_BYTES = 64 << 20  # of kept units and their ids
LONGEST_KEPT = 64  # characters of a kept unit
UNIT_BYTES = 160  # what a kept unit takes besides its characters and ids
INSIDE_SPACES = re.compile(r"\s (?:\s|\Z)")
AFTER_WORD = re.compile(r"(?<=\S) ")
NONE = -1
END_MARKS = (".", ",", "!", "?", ";", ":")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def units(text: str) -> list[str]:
    """The text cut before spaces; joined by one space the units give the text.

    With a space inside a longer run of white space only the spaces after a word are cuts: the
    rest of the run stays with what follows it, so that the pattern sees the whole run.
    """
    return AFTER_WORD.split(text) if INSIDE_SPACES.search(text) else text.split(" ")


class MergeReplay:
    """Encodes many words at once by applying each merge wherever it occurs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens whose bytes together are a token, sorted for lookups.
        made = {ranks[w[:i]] << 32 | ranks[w[i:]]: rank for w, rank in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.pairs = np.array(sorted(made) + [np.iinfo(np.int64).max], np.int64)
        self.makes = np.array([made[k] for k in self.pairs[:-1].tolist()] + [NONE], np.int64)
        # Tokens that with a neighbour may make one of a lower rank.
        left, right = self.pairs[:-1] >> 32, self.pairs[:-1] & 0xFFFFFFFF
        self.steps_back = set(left[self.makes[:-1] < left].tolist()) | set(right[self.makes[:-1] < right].tolist())

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that neighbours make, NONE where they make none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.makes[at], NONE)

    def lower_next(self, rank: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a token makes one of a lower rank with its neighbours or with its like."""
        same = np.full(len(left), rank)
        made = np.stack([self.merged(left, same), self.merged(same, right), self.merged(same, same)])
        return ((made >= 0) & (made < rank)).any(axis=0)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The packed tokens of each word."""
        whole = [self.ranks.get(w) for w in words]
        open_words = [w for w, rank in zip(words, whole) if rank is None and w]
        replayed = iter(self.replay(open_words) if open_words else ())
        return [rank.to_bytes(4, "little") if rank is not None else next(replayed) if w else b"" for w, rank in zip(words, whole)]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """All words as one chain of tokens, with NONE after each word."""
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        word = np.repeat(np.arange(len(words)), lengths + 1)
        token = self.byte_ids[raw]
        token[ends] = NONE
        makes = np.full(len(raw), NONE, np.int64)
        makes[:-1] = self.merged(token[:-1], token[1:])
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        # The inverted index: for each merge the positions of its left parts.
        index: dict[int, list] = {}
        heap: list[int] = []

        def note(found: np.ndarray, places: np.ndarray) -> None:
            some = found >= 0
            found, places = found[some], places[some]
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            begin = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else ()
            for f, p in zip(found[begin].tolist() if len(found) else (), np.split(places, begin[1:])):
                if f in index:
                    index[f].append(p)
                else:
                    index[f] = [p]
                    heapq.heappush(heap, f)

        note(makes, np.arange(len(raw)))
        while heap:
            rank = heapq.heappop(heap)
            listed = index.pop(rank)
            places = np.concatenate(listed) if len(listed) > 1 else listed[0]
            places = places[makes[places] == rank]
            if len(places) > 1:
                listed = np.unique(places)
                # Where merges overlap in a row, every second one from the left applies.
                at = np.arange(len(listed))
                fresh = np.append(True, after[listed[:-1]] != listed[1:])
                places = listed[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
                if rank in self.steps_back and (lower := self.lower_next(rank, token[before[places]], token[after[after[places]]])).any():
                    # In such words only the leftmost applies now: what it makes comes before the others.
                    stuck = np.unique(word[places[lower]])
                    waiting = listed[np.isin(word[listed], stuck)]
                    leads = np.unique(word[waiting], return_index=True)[1]
                    places = np.sort(np.append(places[~np.isin(word[places], stuck)], waiting[leads]))
                    index[rank] = [np.delete(waiting, leads)]
                    heapq.heappush(heap, rank)
            if not len(places):
                continue
            gone = after[places]
            right, left = after[gone], before[places]
            makes[gone] = NONE
            token[places], token[gone] = rank, NONE
            after[places], before[right] = right, places
            inner = (left >= 0) & (token[left] >= 0)
            left = left[inner]
            touched = np.concatenate([places, left])
            makes[touched] = found = self.merged(token[touched], token[np.concatenate([right, places[inner]])])
            note(found, touched)
        kept = token >= 0
        counts = np.add.reduceat(kept, ends - lengths)
        packed = token[kept].astype("<u4").tobytes()
        cuts = np.concatenate([[0], 4 * np.cumsum(counts)]).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]


class Encoder:
    """Texts to packed ids; ``encode_words`` gives the packed ids of distinct words."""

    def __init__(self, encode_words):
        self.encode_words = encode_words
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.held = 0

    def encode(self, batch: list[str]) -> list[bytes]:
        cut = [units(text) for text in batch]
        heads = {x[0] for x in cut}
        tails = set(chain.from_iterable(x[1:] for x in cut))
        for known, needed, before in ((self.first, heads, ""), (self.later, tails, " ")):
            new = needed - known.keys()
            self.learn(known, new, before)
            self.held += sum(len(unit) + len(known[unit]) + UNIT_BYTES for unit in new)
        out = [self.first[x[0]] + b"".join(map(self.later.__getitem__, x[1:])) for x in cut]
        if self.held > KEPT_BYTES:
            self.first.clear()
            self.later.clear()
            self.held = 0
        else:
            for known, needed in ((self.first, heads), (self.later, tails)):
                for unit in needed:
                    if len(unit) > LONGEST_KEPT:
                        self.held -= len(unit) + len(known.pop(unit)) + UNIT_BYTES
        return out

    def learn(self, known: dict[str, bytes], new: set[str], before: str) -> None:
        """Encode units that haven't been seen, each pattern match of them as a word of its own."""
        cut = [self.pieces(before, unit) for unit in new]
        words = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(words, self.encode_words([w.encode() for w in words])))
        known.update(zip(new, (ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for p in cut)))

    def pieces(self, before: str, unit: str) -> list[str]:
        """The pattern's matches; the two usual kinds of units need no pattern."""
        if unit.isalpha():
            return [before + unit]
        if unit[-1:] in END_MARKS and unit[:-1].isalpha():
            return [before + unit[:-1], unit[-1]]
        return self.pattern.findall(before + unit)


_ENCODERS: dict[tuple, Encoder] = {}
_VOCABULARIES: dict[str, list[bytes]] = {}


def replay_encoder(path: str) -> Encoder:
    """This worker's encoder for a rank file; one is kept, with the words it has seen."""
    if ("replay", path) not in _ENCODERS:
        _ENCODERS["replay", path] = Encoder(MergeReplay(read_ranks(path)).encode)
    return _ENCODERS["replay", path]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, decoded: bool = False) -> DataFrame:
    """The key, ``n_tokens`` and the packed ``ids`` of every row; if wanted, also the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(ranks)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = encoder.encode(texts(batch))
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns, names = [batch.column(0), counts, pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"]
            if decoded:
                columns, names = [*columns, pa.array(decoded_bytes(ids, ranks), pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def decoded_bytes(packed: list[bytes | None], ranks: str) -> list[bytes]:
    """What packed ids stand for."""
    if ranks not in _VOCABULARIES:
        known = read_ranks(ranks)
        _VOCABULARIES[ranks] = sorted(known, key=known.get)
    take = _VOCABULARIES[ranks].__getitem__
    return [b"".join(map(take, np.frombuffer(x or b"", "<u4").tolist())) for x in packed]


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """The columns in ``keep`` and the bytes that the packed ids stand for, as ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_ids", SLICE_BYTES):
            decoded = decoded_bytes(batch.column(batch.num_columns - 1).to_pylist(), ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    rows = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    coded = encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
