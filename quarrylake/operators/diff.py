"""Differences of two states of one or many roots.

A state is a DataFrame (root_id, path, size, content_hash) with unique (root_id, path).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.paths import ignore_regex, moved_kind, selected
from quarrylake.operators.ranks import spread_rank

KEY = ["root_id", "path"]


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda d, n: d.select(*KEY, F.col("size").alias(f"{n}_size"), F.col("content_hash").alias(f"{n}_hash"), F.lit(True).alias(f"in_{n}"))
    return side(old, "old").join(side(new, "new"), KEY, "full_outer")


def _side(c: str) -> Column:
    return F.when(F.col("in_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))


def _change(status: Column) -> list[Column]:
    return [*map(F.col, KEY), status.alias("status"), _side("hash").alias("content_hash"), _side("size").alias("size")]


def diff_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root_id, path, status, content_hash, size) with ADDED, REMOVED, MODIFIED or UNCHANGED. Null hashes equal each other."""
    status = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "UNCHANGED").otherwise("MODIFIED")
    return _joined(old, new).select(*_change(status))


def forced_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """As diff_states, but every path in both counts as MODIFIED."""
    status = F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED").otherwise("MODIFIED")
    return _joined(old, new).select(*_change(status))


def changed(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status") != "UNCHANGED")


def with_moves(changes: DataFrame, classify_rename: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Pairs each REMOVED with an ADDED of the same content in its root, one to one, as MOVED or RENAMED with old_path.

    Of several of one content, both sides are paired in the order of their paths' hashes, in buckets,
    so that a content shared by any number of files (empty ones, say) isn't ranked in one task.
    max_bytes: larger files aren't paired. Null contents never are.
    """
    can = F.col("content_hash").isNotNull()
    if max_bytes is not None:
        can = can & (F.col("size") <= max_bytes)
    group = ["root_id", "content_hash"]
    gone = spread_rank(changes.where((F.col("status") == "REMOVED") & can), group, "path").select(*group, "rn", F.col("path").alias("old_path"))
    come = spread_rank(changes.where((F.col("status") == "ADDED") & can), group, "path").select(*group, "rn", "path", "size")
    pairs = come.join(gone, [*group, "rn"]).drop("rn")
    kind = moved_kind(F.col("old_path"), F.col("path")) if classify_rename else F.lit("MOVED")
    moved = pairs.select("root_id", "path", kind.alias("status"), "content_hash", "size", "old_path")
    used = pairs.select("root_id", "path", F.lit("ADDED").alias("status")).unionByName(pairs.select("root_id", F.col("old_path").alias("path"), F.lit("REMOVED").alias("status")))
    rest = changes.join(used, ["root_id", "path", "status"], "left_anti")
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(moved)


def diff_stats(changes: DataFrame, by: Sequence[str] = ("root_id",)) -> DataFrame:
    """Changes of each status, and bytes to upload (ADDED and MODIFIED)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    up = F.col("status").isin("ADDED", "MODIFIED")
    return changes.groupBy(*by).agg(*map(of, ["ADDED", "MODIFIED", "REMOVED", "MOVED", "RENAMED", "UNCHANGED"]), F.count_if(up).alias("uploads"), F.coalesce(F.sum(F.when(up, F.col("size"))), F.lit(0)).alias("upload_bytes"))


def subset_diff(base: DataFrame, local: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), force: bool = False) -> DataFrame:
    """Changes of the selected paths only; what isn't selected stays as it is in the base."""
    mine = lambda d: d.where(selected(F.col("path"), include, exclude))
    return (forced_diff if force else diff_states)(mine(base), mine(local))


def merged_state(base: DataFrame, local: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """The full state after a subset sync: selected paths as they are locally, all others as in the base."""
    on = selected(F.col("path"), include, exclude)
    cols = [*KEY, "size", "content_hash"]
    return base.where(~on).select(*cols).unionByName(local.where(on).select(*cols))


def selection_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(root_id, path, status): matched, missing or stale in the remote state."""
    r = remote.select(*KEY, F.col("content_hash").alias("theirs"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("content_hash").eqNullSafe(F.col("theirs")), "matched").otherwise("stale")
    return local.join(r, KEY, "left").select(*KEY, status.alias("status"))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state that results from changes (with or without moves)."""
    cols = [*KEY, "size", "content_hash"]
    new = changes.where(F.col("status").isin("ADDED", "MODIFIED", "MOVED", "RENAMED")).select(*cols)
    gone = changes.where(F.col("status").isin("REMOVED", "MODIFIED")).select(*KEY)
    if "old_path" in changes.columns:
        gone = gone.unionByName(changes.where(F.col("old_path").isNotNull()).select("root_id", F.col("old_path").alias("path")))
    return state.select(*cols).join(gone.distinct(), KEY, "left_anti").unionByName(new)


def repeated_paths(changes: DataFrame) -> DataFrame:
    """Paths that occur more than once."""
    return changes.groupBy(*KEY).agg(F.count("*").alias("times")).where("times > 1")


def reused_hashes(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """A listing (root_id, path, size, mtime) with hashes taken from a cached state where size and mtime agree and it has one."""
    c = cache.select(*KEY, F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), "content_hash")
    same = (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime")) & (F.col("content_hash") != "")
    return listing.join(c, KEY, "left").select(*KEY, "size", "mtime", F.when(same, F.col("content_hash")).alias("content_hash"))


def policy_paths(changes: DataFrame) -> DataFrame:
    """Changes whose path a policy has to allow: all but removed ones; of moved files the new path counts, blank paths don't."""
    return changes.where((F.col("status") != "REMOVED") & (F.trim("path") != ""))


def policy_violations(changes: DataFrame, org_lines: Sequence[str], user_lines: Sequence[str] = ()) -> DataFrame:
    """Changes that the policy of organisation and user together forbids. No lines forbid nothing, not even what is ignored by default."""
    found = [r for line in [*org_lines, *user_lines] if (r := ignore_regex(line))]
    return policy_paths(changes).where(F.col("path").rlike("|".join(found)) if found else F.lit(False))
