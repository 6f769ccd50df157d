"""Hash and identifier expressions. They must agree bit for bit with the ids in stored tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_hash(h: Column) -> Column:
    """Hex digits of a hash whatever its letter case and with or without `sha256:`; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(h)), "^sha256:", ""), F.lit(""))


def packed_hash(h: Column) -> Column:
    """bare_hash as bytes (half the width of hex); digits that are no hex stay as their text."""
    b = bare_hash(h)
    return F.coalesce(F.unhex(b), F.encode(b, "UTF-8"))


def chunk_id(root: Column, path: Column, index: Column) -> Column:
    """First 16 hex digits of sha256(root:path), a colon, the index."""
    return F.concat(F.substring(F.sha2(F.concat_ws(":", root, path), 256), 1, 16), F.lit(":"), index.cast("string"))


def generation_chunk_id(root: Column, generation: Column, path: Column, index: Column) -> Column:
    """As chunk_id, with the generation between root and path."""
    return F.concat(F.substring(F.sha2(F.concat_ws(":", root, generation, path), 256), 1, 16), F.lit(":"), index.cast("string"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def path_shard(path: Column, shards: int | Column) -> Column:
    """Unsigned value of the first 8 bytes of sha256(path), modulo the number of shards."""
    if isinstance(shards, int) and not 1 <= shards <= 256:
        raise ValueError("shards must be in 1..256")
    u64 = F.conv(F.substring(F.sha2(path, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (u64 % (F.lit(shards) if isinstance(shards, int) else shards)).cast("int")


def shard_namespace(org: Column, root: Column, shard: Column) -> Column:
    """Name of a physical shard: pfs_<org>_<root>_sNNN, ids as 10 hex digits of their sha256."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 10)
    return F.concat(F.lit("pfs_"), short(org), F.lit("_"), short(root), F.format_string("_s%03d", shard.cast("int")))
