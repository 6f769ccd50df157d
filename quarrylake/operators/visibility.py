"""Generation validity of index rows: visible at a seq, closed by later generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.hashes import generation_chunk_id


def visible(seq: int, start: str = "valid_from_generation_seq", end: str = "valid_to_generation_seq") -> Column:
    """Rows valid at seq: begun by then and not ended by then (0 = open). Seq 0 sees nothing."""
    if seq <= 0:
        return F.lit(False)
    return (F.col(start) <= seq) & ((F.col(end) == 0) | (F.col(end) > seq))


def with_closes(rows: DataFrame, closes: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Rows with valid_to_generation_seq from an append-only log of closes (root_id, file_path, base_seq, gen_seq).

    A close ends the rows of its path that were active at its base; it never touches rows of its own
    generation. The earliest counts. Rows and closes of generations not in `committed` (gen_seq)
    are as if they weren't there. Closes are reduced to one row per path and seq first.
    """
    if committed is not None:
        seqs = committed.select("gen_seq").distinct()
        closes = closes.join(seqs, "gen_seq", "left_semi")
        rows = rows.join(seqs.withColumnRenamed("gen_seq", "valid_from_generation_seq"), "valid_from_generation_seq", "left_semi")
    # one pass over each path from its latest place down: the earliest of the closes at or above each row
    c = closes.groupBy("root_id", "file_path", F.col("gen_seq").alias("c")).agg(F.max("base_seq").alias("base"))
    c = c.select("root_id", "file_path", F.least(F.col("base"), F.col("c") - 1).alias("at"), "c")
    begun = rows.select("root_id", "file_path", F.col("valid_from_generation_seq").alias("at")).distinct().withColumn("c", F.lit(None).cast("long"))
    down = Window.partitionBy("root_id", "file_path").orderBy(F.col("at").desc(), F.col("c").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = begun.unionByName(c).withColumn("end", F.min("c").over(down)).where("c is null and end is not null").select("root_id", "file_path", F.col("at").alias("valid_from_generation_seq"), F.col("end").alias("valid_to_generation_seq"))
    return rows.drop("valid_to_generation_seq").join(ends, ["root_id", "file_path", "valid_from_generation_seq"], "left").fillna(0, ["valid_to_generation_seq"])


def active_rows_of(rows: DataFrame, paths: DataFrame, base_seq: int) -> DataFrame:
    """Index rows of the given (root_id, file_path) that are active at base_seq."""
    return rows.where(visible(base_seq)).join(paths.select("root_id", "file_path").distinct(), ["root_id", "file_path"], "left_semi")


def carried_over(rows: DataFrame, moves: DataFrame, base_seq: int, generation: str, seq: int) -> DataFrame:
    """Rows of moved files as rows of a new generation under the new path, vector included: no new chunks or embeddings.

    moves: (root_id, old_path, path). Only a null chunk_index falls back to 0, a 0 stays.
    """
    m = moves.select("root_id", F.col("old_path").alias("file_path"), F.col("path").alias("new_path"))
    index = F.coalesce("chunk_index", F.lit(0))
    return (
        rows.where(visible(base_seq)).join(m, ["root_id", "file_path"])
        .withColumn("id", generation_chunk_id(F.col("root_id"), F.lit(generation), F.col("new_path"), index))
        .withColumn("file_path", F.col("new_path")).drop("new_path")
        .withColumns({"chunk_index": index, "generation_id": F.lit(generation), "valid_from_generation_seq": F.lit(seq).cast("long"), "valid_to_generation_seq": F.lit(0).cast("long")})
    )


def rolled_back(rows: DataFrame, seq: int) -> DataFrame:
    """Rows as if generation seq had never been: its rows gone, those it closed open again."""
    end = F.when(F.col("valid_to_generation_seq") == seq, 0).otherwise(F.col("valid_to_generation_seq"))
    return rows.where(F.col("valid_from_generation_seq") != seq).withColumn("valid_to_generation_seq", end.cast("long"))


def vacuumed(rows: DataFrame, keep_seq: int) -> DataFrame:
    """Rows that some seq from keep_seq on can still see."""
    return rows.where((F.col("valid_to_generation_seq") == 0) | (F.col("valid_to_generation_seq") > keep_seq))


def patched(rows: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: columns of the latest patch of each key replace those of its row where the patch has them."""
    cols = [c for c in patches.columns if c not in (key, order) and c in rows.columns]
    latest = patches.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__p"))
    return rows.join(latest, key, "left").select(*[F.coalesce(F.col(f"__p.{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns])


def patched_where(rows: DataFrame, predicate: Column, **values) -> DataFrame:
    """Rows with the given columns set where the predicate holds."""
    return rows.withColumns({c: F.when(predicate, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
