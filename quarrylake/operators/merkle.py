"""Merkle trees, content proofs and similarity hashes over flat states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.hashes import bare_hash
from quarrylake.functions.paths import ancestors, base_name, depth, dir_name


def tree(state: DataFrame) -> DataFrame:
    """(root_id, path, is_dir, hash, depth) of every file and folder; the root itself has path '' and depth 0.

    A folder's hash is sha256 over `name:hash` and LF of its children in order of name. Levels are
    built from the deepest up, each with one aggregation over (root, folder); only folders go on to
    the next level. Files without a hash count with an empty one.
    """
    files = state.select("root_id", "path", F.lit(False).alias("is_dir"), F.concat(F.lit("sha256:"), F.coalesce(bare_hash(F.col("content_hash")), F.lit(""))).alias("hash"), depth(F.col("path")).alias("depth"))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    out, dirs = files, None
    for level in range(deepest, 0, -1):
        below = files.where(F.col("depth") == level)
        if dirs is not None:
            below = below.unionByName(dirs)
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(base_name(F.col("path")).alias("name"), "hash"))), lambda c: F.concat(c["name"], F.lit(":"), c["hash"], F.lit("\n"))), "")
        dirs = below.groupBy("root_id", dir_name(F.col("path")).alias("path")).agg(F.sha2(lines, 256).alias("h"))
        dirs = dirs.select("root_id", "path", F.lit(True).alias("is_dir"), F.concat(F.lit("sha256:"), "h").alias("hash"), F.lit(level - 1).alias("depth"))
        out = out.unionByName(dirs)
    return out


def content_proof(nodes: DataFrame) -> DataFrame:
    """(root_id, kind, path, hash): every file, every folder but the root, and the root's hash."""
    kind = F.when(~F.col("is_dir"), "file").when(F.col("path") == "", "root").otherwise("dir")
    return nodes.select("root_id", kind.alias("kind"), "path", "hash")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root_id, path, status) of two trees, without looking below folders whose hash is the same.

    Folders of equal hash in both are named first; files under one of them leave both sides by an
    anti-join on their ancestors before the files themselves are compared.
    """
    same = old.where("is_dir").select("root_id", "path", "hash").join(new.where("is_dir").select("root_id", "path", "hash"), ["root_id", "path", "hash"]).select("root_id", F.col("path").alias("folder"))

    def open_files(nodes: DataFrame) -> DataFrame:
        files = nodes.where("not is_dir").select("root_id", "path", "hash")
        under = files.select("root_id", "path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("folder"))
        shut = under.join(same, ["root_id", "folder"], "left_semi").select("root_id", "path").distinct()
        return files.join(shut, ["root_id", "path"], "left_anti")

    a, b = open_files(old).withColumnRenamed("hash", "a"), open_files(new).withColumnRenamed("hash", "b")
    status = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("MODIFIED")
    return a.join(b, ["root_id", "path"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("root_id", "path", status.alias("status"))


def simhash(state: DataFrame) -> DataFrame:
    """(root_id, simhash): 256-bit majority hash of the file hashes, as hex. Files without a hash don't vote.

    Votes are counted by hex digit and place (64 places of 16 digits), combined map-side; the bits
    follow from those counts.
    """
    h = state.select("root_id", bare_hash(F.col("content_hash")).alias("h")).where(F.length("h") == 64)
    digits = h.select("root_id", F.posexplode(F.split("h", "")).alias("place", "digit")).where("place < 64").groupBy("root_id", "place", "digit").agg(F.count("*").alias("n"))
    value = F.conv("digit", 16, 10).cast("int")
    vote = lambda bit: F.sum(F.when(F.shiftright(value, bit).bitwiseAND(1) == 1, F.col("n")).otherwise(-F.col("n"))) > 0
    nibble = sum((F.when(vote(bit), 1 << bit).otherwise(0) for bit in range(4)), F.lit(0))
    places = digits.groupBy("root_id", "place").agg(F.lower(F.hex(nibble)).alias("x"))
    return places.groupBy("root_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]), "").alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-digit hex hashes."""
    word = lambda c, k: F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(4)), F.lit(0))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 256.0
