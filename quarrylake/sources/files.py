"""Folders of files as states and contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions.hashes import file_hash
from quarrylake.functions.paths import ignored, secret, selected
from quarrylake.operators.diff import reused_hashes


def listing(spark: SparkSession, folder: str, root_id: str, ignore: Sequence[str] = (), scoped: Sequence[tuple[str, str]] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), secrets: bool = False) -> DataFrame:
    """(root_id, path, size, mtime, content) of the files below a folder, without ignored and secret ones.

    content is only read by plans that use it: Spark's binary source leaves it out otherwise.
    """
    lead = folder.rstrip("/").removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.substring_index(F.col("path"), f"{lead}/", -1)
    out = files.select(F.lit(root_id).alias("root_id"), path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), "content")
    keep = ~ignored(F.col("path"), ignore, scoped) & selected(F.col("path"), include, exclude)
    return out.where(keep if secrets else keep & ~secret(F.col("path")))


def scan(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(root_id, path, size, content_hash, mtime): the state of a listing. With a cached state, files whose size
    and mtime agree keep its hash and aren't read."""
    if cache is None:
        return files.select("root_id", "path", "size", file_hash(F.col("content")).alias("content_hash"), "mtime")
    known = reused_hashes(files.drop("content"), cache)
    old = known.where(F.col("content_hash").isNotNull()).select("root_id", "path", "size", "content_hash", "mtime")
    todo = known.where(F.col("content_hash").isNull()).select("root_id", "path")
    return old.unionByName(files.join(todo, ["root_id", "path"], "left_semi").select("root_id", "path", "size", file_hash(F.col("content")).alias("content_hash"), "mtime"))


def read_ranges(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, offset, length) with `content`: the whole object where length isn't positive, else that range."""
    whole = wanted.join(objects.select(F.col("path").alias("key"), F.col("content").alias("all")), "key")
    part = F.when(F.coalesce("length", F.lit(0)) > 0, F.substring("all", F.col("offset").cast("int") + 1, F.col("length").cast("int"))).otherwise(F.col("all"))
    return whole.withColumn("content", part).drop("all")


def secrets_in(state: DataFrame) -> DataFrame:
    """Files of a state whose names look secret."""
    return state.where(secret(F.col("path")))
