"""Index namespaces: a root's active shards and the one that holds a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.hashes import path_shard


def active_shards(namespaces: DataFrame) -> DataFrame:
    """Namespaces that aren't retired, in the order of root and shard."""
    return namespaces.where("retired_at is null").orderBy("root_id", "shard_index")


def shard_errors(namespaces: DataFrame) -> DataFrame:
    """(root_id, error) of roots whose active shards don't make up a whole: none active, different counts, an index outside the count, or gaps.

    A count that is null or 0 stands for the number of active shards, where the first shard has it.
    """
    one = namespaces.groupBy("root_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("retired_at").isNull(), F.struct("shard_index", F.coalesce("shard_count", F.lit(0)).alias("n"))))).alias("a"),
        F.count_if(F.col("retired_at").isNull()).alias("rows"),
    )
    first = F.try_element_at("a", F.lit(1))["n"]
    n = one.withColumn("n", F.when(first > 0, first).otherwise(F.col("rows").cast("int")))
    outside = F.exists("a", lambda s: (s["shard_index"] < 0) | (s["shard_index"] >= F.col("n")))
    known = F.size(F.array_distinct(F.transform("a", lambda s: s["shard_index"])))
    error = F.when(F.col("rows") == 0, "no active namespaces").when(F.exists("a", lambda s: (s["n"] > 0) & (s["n"] != F.col("n"))), "shard count mismatch").when(outside, "invalid shard index").when(known != F.col("n"), "missing shards")
    return n.select("root_id", error.alias("error")).where("error is not null")


def path_namespaces(paths: DataFrame, namespaces: DataFrame, path: str = "path") -> DataFrame:
    """paths (root_id, path, ...) with `namespace`, null for roots without a whole set of active shards.

    A root has at most 256 shards, so the namespaces are joined by root and shard as one row each.
    """
    good = namespaces.where("retired_at is null").join(shard_errors(namespaces).select("root_id"), "root_id", "left_anti")
    sizes = good.groupBy("root_id").agg(F.countDistinct("shard_index").cast("int").alias("__n"))
    shards = good.groupBy("root_id", F.col("shard_index").alias("__shard")).agg(F.max("namespace").alias("namespace"))
    at = paths.join(sizes, "root_id", "left").withColumn("__shard", path_shard(F.col(path), F.coalesce("__n", F.lit(1))))
    return at.join(shards, ["root_id", "__shard"], "left").drop("__n", "__shard")
