"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are the maximal runs of Unicode categories L and N, lower-cased. All texts of a block are laid
out as one array of code points; a prefix sum of code * B**position gives every word's polynomial
hash by one subtraction, so no Python code runs per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Code points above are no letters or numbers that have a lower case; those from here on count as separators.
TOP = 0x32400
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK_CHARS = 1 << 20
BLOCK_TEXTS = 4096
STRETCH = 1 << 21


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is part of a word, lower case) by code point."""
    chars = list(map(chr, range(TOP)))
    word = np.fromiter((unicodedata.category(c)[0] in "LN" for c in chars), bool, TOP)
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, TOP)
    lower[ord("ς")] = ord("σ")
    return word, lower


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in blocks of bounded total length; a longer text is a block of its own."""
    start, size, block = 0, 0, []
    for k, t in enumerate(texts):
        t = t or ""
        if block and (size + len(t) > BLOCK_CHARS or len(block) >= BLOCK_TEXTS):
            yield start, block
            start, size, block = k, 0, []
        block.append(t)
        size += len(t) + 1
    if block:
        yield start, block


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in text order."""
    is_word, lower = tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < TOP, codes, 0)
    mask = is_word[codes]
    if not mask.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return run_hashes(codes, lower, first, last), np.searchsorted(ends, first, side="right")


def run_hashes(codes: np.ndarray, lower: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run codes[first:last] in lower case; runs in order, none within another."""
    h = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):  # a long text goes a stretch of whole words at a time
        a = first[i]
        j = int(np.searchsorted(first, a + STRETCH))
        own = lower[codes[a : last[j - 1]]].astype(np.uint64) + np.uint64(1)
        p, q = powers(len(own) + 1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * p[:-1], out=total[1:])
        h[i:j] = (total[last[i:j] - a] - total[first[i:j] - a]) * q[first[i:j] - a]
        i = j
    h += (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def shingles(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k consecutive words, index of its text), repeats included."""
    w, doc = words(texts)
    if len(w) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xF1357AEA2E62A9C5) + w[j : j + n]
    own = doc[:n] == doc[k - 1 :]
    return mix(h)[own], doc[:n][own]
