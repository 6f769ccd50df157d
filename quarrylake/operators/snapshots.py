"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.hashes import packed_hash

#: A table of snapshots up to this many rows is broadcast (about 60 bytes each); a larger one is joined by shuffle.
BROADCAST_SNAPSHOTS = 100_000


def snapshot_index(df: DataFrame) -> DataFrame:
    """(root_id, generation_seq, i, next_seq): the place of each snapshot in its root, from 1."""
    w = Window.partitionBy("root_id").orderBy("generation_seq")
    return (
        df.select("root_id", "generation_seq").where(F.col("generation_seq").isNotNull()).distinct()
        .select("root_id", "generation_seq", F.row_number().over(w).alias("i"), F.lead("generation_seq").over(w).alias("next_seq"))
    )


def current_states(df: DataFrame) -> DataFrame:
    """One row per root, snapshot and path: the reading with the greatest mtime (then the last received)."""
    path = F.regexp_replace("path", r"^(\./)+", "")
    return (
        df.where(F.col("generation_seq").isNotNull() & F.col("path").isNotNull())
        .select("root_id", "generation_seq", path.alias("path"), F.struct("mtime", "received_at", packed_hash(F.col("content_hash")).alias("h")).alias("x"))
        .groupBy("root_id", "path", "generation_seq")
        .agg(F.max("x").alias("x"))
        .select("root_id", "path", "generation_seq", F.col("x.h").alias("h"))
    )


def snapshot_changes(df: DataFrame) -> DataFrame:
    """(root_id, generation_seq, path, status) for each snapshot but a root's first.

    Each path's rows are ordered by the place of their snapshot: a lagged hash that differs is
    CHANGED, a gap before a row is ADDED, a gap after it is REMOVED at the snapshot that follows.
    Repeated readings are reduced map-side before any row moves, so a path has at most one row per
    snapshot in the window. Null hashes are no change; rows without path or seq count nowhere.
    """
    index = snapshot_index(df)
    if index.limit(BROADCAST_SNAPSHOTS + 1).count() <= BROADCAST_SNAPSHOTS:
        index = F.broadcast(index)
    w = Window.partitionBy("root_id", "path").orderBy("i")
    lag = (
        current_states(df).join(index, ["root_id", "generation_seq"])
        .select("*", F.lag("i").over(w).alias("pi"), F.lag("h").over(w).alias("ph"), F.lead("i").over(w).alias("ni"))
    )
    event = lambda on, seq, status: F.when(on, F.struct(F.col(seq).alias("generation_seq"), F.lit(status).alias("status")))
    i = F.col("i")
    gap_before = F.coalesce(F.col("pi") < i - 1, i > 1)
    events = F.array(
        event(gap_before, "generation_seq", "ADDED"),
        event((F.col("pi") == i - 1) & (F.col("ph") != F.col("h")), "generation_seq", "CHANGED"),
        event(F.col("next_seq").isNotNull() & F.coalesce(F.col("ni") > i + 1, F.lit(True)), "next_seq", "REMOVED"),
    )
    return lag.select("root_id", "path", F.explode(events).alias("x")).where(F.col("x").isNotNull()).select("root_id", "x.generation_seq", "path", "x.status")
