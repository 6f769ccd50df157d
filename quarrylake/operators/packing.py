"""Items packed greedily into shards and bundles with limits of number and weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quarrylake.session import cut

# Fixed values.
SHARD_FILES, SHARD_BYTES = 5000, 256 << 20
SMALL_FILE, BUNDLE_BYTES = 8 << 20, 256 << 20


def starts(w: np.ndarray, most: int, limit: int, count: int = 0, size: int = 0) -> tuple[list[int], int, int]:
    """Where new shards start in a run of weights behind an open shard; number and weight in the last one."""
    c, at, out = np.concatenate([[0], np.cumsum(w)]), 0, []
    while True:
        fits = max(at, int(np.searchsorted(c, c[at] + limit - size, side="right")) - 1)
        end = min(fits, at + most - count)
        if not count:
            end = max(end, at + 1)  # an empty shard takes an item of any weight
        if end >= len(w):
            return out, count + len(w) - at, size + int(c[-1] - c[at])
        out.append(end)
        at, count, size = end, 0, 0


def pack(df: DataFrame, group: str, order: str, weight: str, most: int = SHARD_FILES, limit: int = SHARD_BYTES, slice_rows: int = 50_000) -> DataFrame:
    """df with `shard`, from 0 in each group: a shard is closed when the next item would exceed either limit.

    Each group is one sequence in the order of `order`, whatever its size. The rows are cut into slices of
    about `slice_rows` by ranges of (group, order). One pass over the weights alone, streamed group by group,
    finds the open shard at the start of each slice; from there the slices are walked side by side.
    A null weight weighs nothing.
    """
    by = [F.col(group), F.col(order).asc_nulls_last()]
    parts = max(1, -(-df.count() // slice_rows))
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"__slice": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()})
    rows = cut(rows) if parts > 1 else rows  # ranges are sampled: both passes must see the same ones

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, shard, count, size = None, None, 0, 0, 0
        for b in batches:
            t, out = b.to_pandas(), []
            new = np.flatnonzero((t["__key"] != t["__key"].shift()) | (t["__slice"] != t["__slice"].shift()))
            for x, y in zip(new, [*new[1:], len(t)]):
                key, here = t["__key"].iat[x], int(t["__slice"].iat[x])
                if key != last:
                    shard, count, size = 0, 0, 0
                elif here != part:
                    out.append((here, key, shard, count, size))
                last, part = key, here
                more, count, size = starts(t["__w"].to_numpy()[x:y], most, limit, count, size)
                shard += len(more)
            yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(carried.names)}, pa.schema([("__slice", pa.int32()), ("__key", pa.string()), ("__shard", pa.int32()), ("__count", pa.int64()), ("__size", pa.int64())]))

    carried = StructType([StructField("__slice", IntegerType()), StructField("__key", StringType()), StructField("__shard", IntegerType()), StructField("__count", LongType()), StructField("__size", LongType())])
    keyed = rows.withColumns({"__key": F.coalesce(F.col(group).cast("string"), F.lit("")), "__w": F.coalesce(F.col(weight).cast("long"), F.lit(0))})
    schema = StructType([*df.schema.fields, StructField("shard", IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        shards = np.zeros(len(pdf), np.int32)
        keys, w = pdf["__key"], pdf["__w"].to_numpy()
        new = np.flatnonzero(keys != keys.shift())
        for x, y in zip(new, [*new[1:], len(pdf)]):
            shard, count, size = 0, 0, 0
            if not x and "__shard" in pdf and pdf["__first"].iat[0] == keys.iat[0]:
                shard, count, size = (int(pdf[c].iat[0]) for c in ("__shard", "__count", "__size"))
            shards[x:y] = shard
            np.add.at(shards[x:y], at := np.array(starts(w[x:y], most, limit, count, size)[0], int), 1)
            shards[x:y] = shard + np.cumsum(shards[x:y] - shard) if len(at) else shard
        return pdf[names].assign(shard=shards)

    names = df.columns
    if parts > 1:
        slim = keyed.select("__key", "__pos", "__slice", "__w").repartition("__key").sortWithinPartitions("__key", "__pos")
        keyed = keyed.join(slim.mapInArrow(entries, carried).withColumnRenamed("__key", "__first"), "__slice", "left")
    return keyed.groupBy("__slice").applyInPandas(run, schema)


def change_shards(changes: DataFrame) -> DataFrame:
    """Changes (without UNCHANGED) in shards; the weight is source_length where it is positive, else size."""
    w = F.when(F.col("source_length") > 0, F.col("source_length")).otherwise(F.col("size")) if "source_length" in changes.columns else F.col("size")
    return pack(changes.where(F.col("status") != "UNCHANGED").withColumn("__w", w), "root_id", "path", "__w").drop("__w")


def bundles(files: DataFrame) -> DataFrame:
    """Small files with bundle number and byte offset in it; empty and larger files stand alone (bundle null)."""
    small = (F.col("size") > 0) & (F.col("size") <= SMALL_FILE)
    packed = pack(files.where(small), "root_id", "path", "size", most=1 << 30, limit=BUNDLE_BYTES).withColumnRenamed("shard", "bundle")
    w = Window.partitionBy("root_id", "bundle").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    inside = packed.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))
    alone = files.where(~small).withColumns({"bundle": F.lit(None).cast("int"), "offset": F.lit(None).cast("long")})
    return inside.unionByName(alone)
