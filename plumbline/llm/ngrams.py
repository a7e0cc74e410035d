"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FACTOR = np.uint32(0x9E3779B1)
CHARS_AT_ONCE = 1 << 19


def normal(text: str) -> str:
    """Lower case, one space for white space, a space at both ends."""
    return " " + " ".join(text.lower().split()) + " "


class Grams:
    """The n-grams of a list of texts, in blocks of characters.

    Blocks overlap by the longest order, so arrays stay small however long a text is, and no
    n-gram is missed. ``ends`` are the texts' ends in the joined characters.
    """

    def __init__(self, texts: list[str], orders: tuple[int, ...], bits: int):
        parts = [normal(t) for t in texts]
        self.orders, self.bits = orders, bits
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first position of a block and the buckets of its n-grams, for each order.

        Where an n-gram would reach beyond its text, the bucket is ``1 << bits``.
        """
        longest = max(self.orders)
        for start in range(0, len(self.codes), CHARS_AT_ONCE):
            codes = self.codes[start : start + CHARS_AT_ONCE + longest - 1]
            near = self.ends[(self.ends > start) & (self.ends < start + len(codes) + longest)]
            h = np.zeros(len(codes), np.uint32)
            for n in range(1, longest + 1):
                count = min(CHARS_AT_ONCE, len(codes) - n + 1)
                if count <= 0:
                    break
                h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * FACTOR
                h ^= h >> np.uint32(15)
                if n in self.orders:
                    bucket = (h[:count] * FACTOR >> np.uint32(32 - self.bits)).astype(np.int32)
                    outside = (near[:, None] - np.arange(1, n) - start).ravel()
                    bucket[outside[(outside >= 0) & (outside < count)]] = 1 << self.bits
                    yield start, bucket

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """The texts that positions lie in."""
        return np.searchsorted(self.ends, positions, side="right")
