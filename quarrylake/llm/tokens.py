"""A corpus encoded with a public byte-level BPE vocabulary.

A text falls into pieces by the vocabulary's own pattern; a piece is encoded by merging its adjacent
pair of lowest rank, the leftmost of equals, until none is left. A segment tree over the byte positions
holds the leftmost minimum of the pair ranks, so each merge is two or three point updates of its live
neighbours, and a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces remembered by a worker; beyond, the memory is emptied and filled anew.
REMEMBERED = 500_000
NONE = 1 << 40
# Fixed value: the pattern that the byte-level vocabularies of 50k tokens were made with.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class SegmentTree:
    """Leftmost minimum over positions 0..n-1."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        low = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b
        self.low = low

    def set(self, i: int, value: int) -> None:
        low = self.low
        i += self.size
        low[i] = value
        i >>= 1
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            least = a if a <= b else b
            if low[i] == least:
                break
            low[i] = least
            i >>= 1

    def least(self) -> tuple[int, int]:
        """(value, position) of the leftmost minimum."""
        low, i = self.low, 1
        value = low[1]
        while i < self.size:
            i *= 2
            if low[i] != value:
                i += 1
        return value, i - self.size


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    tree = SegmentTree([get(piece[i : i + 2], NONE) for i in range(n - 1)])
    while True:
        rank, i = tree.least()
        if rank == NONE:
            break
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            tree.set(i, get(part[i] + part[k], NONE))
        else:
            tree.set(i, NONE)
        if j < n - 1:
            tree.set(j, NONE)
        if (h := before[i]) >= 0:
            tree.set(h, get(part[h] + part[i], NONE))
    return [ranks[p] for p in part if p]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.known = ranks, regex.compile(pattern).finditer, {}

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for m in self.find(text):
            p = m[0]
            ids = known.get(p)
            if ids is None:
                ids = encode_piece(p.encode("utf-8", "surrogatepass"), self.ranks)
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


_encoders: dict[tuple[str, str], Encoder] = {}  # of a worker


def encode_corpus(df: DataFrame, text: str, vocabulary: str, pattern: str, to: str = "ids") -> DataFrame:
    """df with a column of token ids in place of its text. Empty and null texts have an empty list.

    vocabulary: path of the rank file, read once on the driver (its size doesn't depend on the corpus)
    and broadcast. Strings that look like special tokens are ordinary text. Rows keep their partitions.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rest = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get((vocabulary, pattern))
        if encode is None:
            _encoders.clear()
            encode = _encoders[vocabulary, pattern] = Encoder(shared.value, pattern)
        for b in batches:
            ids = [encode(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*rest, to])

    return df.select(*rest, F.col(text)).mapInArrow(run, ", ".join(filter(None, (kinds, f"`{to}` array<int>"))))
