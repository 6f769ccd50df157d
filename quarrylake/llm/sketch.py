"""Counters of a fixed number over all rows of a table, whatever its size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANGE_BITS = 16


def counter_classes(df: DataFrame, count: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """Class of each of 2**bits counters: 0 none, c for 2**(c-1) <= count < 2**c. count: (counters, what to add) of a batch.

    Tasks send their counts in ranges of 2**16 counters; ranges are summed in two steps. Only the classes,
    a byte each, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for b in batches:
            np.add.at(n, *count(b))
        at = np.flatnonzero(n)
        cuts = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << RANGE_BITS))
        for r in range(len(cuts) - 1):
            if cuts[r] < cuts[r + 1]:
                x = at[cuts[r] : cuts[r + 1]]
                x = x[np.argsort(n[x] > 1, kind="stable")]  # those counted once first: they need no count
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([int(x[0]) % 31], pa.int32()), pa.array([(x & ((1 << RANGE_BITS) - 1)).astype(np.uint16).tobytes()]), pa.array([n[x][n[x] > 1].tobytes()])], ["r", "part", "at", "n"])

    def add(t: pa.Table) -> np.ndarray:
        n = np.zeros(1 << RANGE_BITS, np.uint64)
        for at, c in zip(t["at"].to_pylist(), t["n"].to_pylist()):
            at, c = np.frombuffer(at, np.uint16), np.frombuffer(c, np.uint32)
            n[at] += np.concatenate((np.ones(len(at) - len(c), np.uint64), c))
        return np.minimum(n, 0xFFFFFFFF).astype(np.uint32)

    def merge(t: pa.Table) -> pa.Table:
        n = add(t)
        at = np.flatnonzero(n)
        at = at[np.argsort(n[at] > 1, kind="stable")]
        return pa.table({"r": pa.array([t["r"][0].as_py()], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [n[at][n[at] > 1].tobytes()]})

    def classes(t: pa.Table) -> pa.Table:
        return pa.table({"r": pa.array([t["r"][0].as_py()], pa.int32()), "c": [zlib.compress(np.frexp(add(t).astype(np.float64))[1].astype(np.uint8).tobytes(), 1)]})

    halves = df.mapInArrow(run, "r int, part int, at binary, n binary").groupBy("r", "part").applyInArrow(merge, "r int, at binary, n binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in halves.groupBy("r").applyInArrow(classes, "r int, c binary").collect():
        at = row["r"] << RANGE_BITS
        out[at : at + (1 << RANGE_BITS)] = np.frombuffer(zlib.decompress(row["c"]), np.uint8)
    return out
