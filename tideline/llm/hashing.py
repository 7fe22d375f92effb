"""Hashed words and character n-grams of many texts at once, in numpy.

Texts are laid out in one byte array with a space before each. A prefix sum of byte values times powers of an odd number makes
the hash of any stretch a difference of two sums, so all n-grams of all texts cost a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SEGMENT = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_ODD), run(_INVERSE)


def segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text numbers, stretches) of about SEGMENT bytes each; a long text is cut at white space into several stretches."""
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = at + SEGMENT
            while end < len(text) and not _WHITE[text[end]]:
                end += 1
            numbers.append(i)
            parts.append(text[at:end])
            held += len(parts[-1]) + 1
            at = end
            if held >= SEGMENT:
                yield numbers, parts
                numbers, parts, held = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield numbers, parts


class Layout:
    """The bytes of some stretches of text, the places where each begins, and hashes of stretches of bytes."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        self.white = _WHITE[raw]
        self.bytes = np.where(self.white, np.uint8(32), raw)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        size = 1 << (len(raw) + 1).bit_length()
        up, self.back = _powers(size)
        values = (self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(raw)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        edge = np.flatnonzero(self.white[1:] != self.white[:-1]) + 1
        self.word_from, self.word_to = edge[0::2], edge[1::2]
        self.begins = np.zeros(len(raw) + 1, np.int32)
        self.begins[self.word_from] = 1

    def stretch(self, a, b) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.back[a]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-grams that lie in one word, with the space before or after it."""
        size = len(self.bytes)
        if size < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = (self.sums[n:] - self.sums[:-n]) * self.back[: size - n + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inner = np.zeros(size - n + 1, bool)
        for i in range(1, n - 1):
            inner |= self.white[i : size - n + 1 + i]
        places = np.flatnonzero(~inner)
        return places, h[places]

    def words(self) -> np.ndarray:
        return self.stretch(self.word_from, self.word_to)


def bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (((h + np.uint64(salt)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)).astype(np.int64)
