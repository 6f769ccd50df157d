"""Oversized contents cut into overlapping pieces at natural boundaries, by pointer doubling.

A content is a row of units: its lines, or, within lines too long to repeat, sentences, words and at
last characters. Every unit is joined to the unit where the next piece would start if a piece started
there: its farthest end under the limit, then as far back as the overlap allows. Squaring that successor
table again and again (1, 2, 4 ... pieces ahead) and marking what is reached from the first unit gives
every cut of the greedy chain in a logarithmic number of array steps, for all contents of a batch at once.
Contents never leave their row, so no shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LONG_LINE = 2400, 400, 1000

_SENTENCE = re.compile(rb"(?<=[.!?])[ \t]+")


def _sub_units(line: bytes, most: int) -> list[int]:
    """Lengths of the parts of a long line: sentences packed up to `most`, else words, else characters."""
    out, size = [], 0

    def add(n: int) -> None:
        nonlocal size
        if size and size + n > most:
            out.append(size)
            size = 0
        size += n

    ends = [m.end() for m in _SENTENCE.finditer(line)]
    for a, b in zip([0, *ends], [*ends, len(line)]):
        if b - a <= most:
            add(b - a)
            continue
        for m in re.finditer(rb"[^ \t]+[ \t]*|[ \t]+", line[a:b]):
            word = m[0]
            while len(word) > most:
                cut = most
                while cut > 1 and word[cut] & 0xC0 == 0x80:
                    cut -= 1
                add(cut)
                word = word[cut:]
            add(len(word))
    if size:
        out.append(size)
    return out


def units_of(content: bytes, long_line: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bytes of each unit, line of each unit from 1, whether any line was divided)."""
    ends = np.flatnonzero(np.frombuffer(content, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(content):
        ends = np.append(ends, len(content))
    sizes = np.diff(ends, prepend=0)
    if sizes.max(initial=0) <= long_line:
        return sizes, np.arange(1, len(sizes) + 1), False
    parts, lines, at = [], [], 0
    for k, n in enumerate(sizes):
        own = [n] if n <= long_line else _sub_units(content[at : at + n], most)
        parts += own
        lines += [k + 1] * len(own)
        at += n
    return np.array(parts, np.int64), np.array(lines, np.int64), True


def greedy_cuts(sizes: np.ndarray, starts: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, unit after the last) of every piece of every content; starts[k]..starts[k+1] are the units of content k."""
    n = len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    close = np.repeat(starts[1:], np.diff(starts))
    unit = np.arange(n)
    end = np.maximum(np.minimum(np.searchsorted(total, total[:-1] + limit, side="right") - 1, close), unit + 1)
    back = np.searchsorted(total, total[end] - overlap, side="left")
    succ = np.append(np.where(end == close, n, np.maximum(back, unit + 1)), n)
    reached = np.zeros(n + 1, bool)
    reached[starts[:-1][np.diff(starts) > 0]] = True
    while True:
        ahead = succ[np.flatnonzero(reached)]
        if (ahead == n).all():
            break
        reached[ahead] = True
        succ = succ[succ]
    first = np.flatnonzero(reached[:n])
    return first, end[first]


def _cut_batch(keys: list, contents: list[str], limit: int, overlap: int, long_line: int) -> pa.RecordBatch:
    raw = [c.encode("utf-8", "surrogatepass") for c in contents]
    parts = [units_of(r, long_line, min(overlap, long_line) or 1) for r in raw]
    starts = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    sizes = np.concatenate([p[0] for p in parts])
    lines = np.concatenate([p[1] for p in parts])
    first, after = greedy_cuts(sizes, starts, limit, overlap)
    doc = np.searchsorted(starts, first, side="right") - 1
    total = np.concatenate(([0], np.cumsum(sizes)))
    base = total[starts[doc]]
    a, b = total[first] - base, total[after] - base
    no = np.arange(len(first)) - np.searchsorted(doc, doc)
    return pa.RecordBatch.from_arrays(
        [pa.array([keys[d] for d in doc]), pa.array(no.astype(np.int32)), pa.array(lines[first].astype(np.int32)), pa.array(lines[after - 1].astype(np.int32)), pa.array([not parts[d][2] for d in doc]), pa.array([raw[d][x:y].decode("utf-8", "surrogatepass") for d, x, y in zip(doc, a, b)])],
        ["key", "chunk_index", "first_line", "last_line", "whole_lines", "content"],
    )


def split_oversized(df: DataFrame, key: str, content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, long_line: int = LONG_LINE) -> DataFrame:
    """(key, chunk_index, first_line, last_line, whole_lines, content): pieces of every content over `limit` bytes.

    Lines count from 1; chunk_index from 0 within the content. whole_lines tells that no line was over
    `long_line` bytes, so that pieces are runs of whole lines. Null contents and those within the limit
    have no rows; equal contents in several rows are cut each. Characters are never cut apart.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(keys):  # a few MB of text at a time
                to, size = at, 0
                while to < len(keys) and (to == at or size + len(contents[to]) < 4_000_000):
                    size += len(contents[to])
                    to += 1
                yield _cut_batch(keys[at:to], contents[at:to], limit, overlap, long_line)
                at = to

    big = df.where(F.octet_length(content) > limit).select(F.col(key).alias("key"), F.col(content).alias("content"))
    return big.mapInArrow(run, f"key {kind}, chunk_index int, first_line int, last_line int, whole_lines boolean, content string").withColumnRenamed("key", key)
