"""What becomes of queue messages: retries, barriers between stages, progress, and the objects to delete afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.jobs import attempts_delay, deletable_keys

# Fixed values.
LONG_STAGES, LONG_ATTEMPTS, ATTEMPTS = ["commit", "cleanup"], 30, 3
NOT_READY_DELAY = 5  # seconds until a commit looks again whether its shards are done


def outcomes(deliveries: DataFrame, failed: Column, not_ready: Column, stage: str = "stage", attempts: str = "attempts") -> DataFrame:
    """deliveries with `action` (ack, wait, fail, retry) and `delay` in seconds, null where nothing comes back.

    A delivery that isn't ready waits, whatever its attempts. One that failed is tried again after attempts * attempts * 10
    seconds, a second at least, until its stage's attempts are used up. Null attempts count as none, null
    conditions as false.
    """
    n = F.coalesce(F.col(attempts), F.lit(0))
    most = F.when(F.col(stage).isin(LONG_STAGES), LONG_ATTEMPTS).otherwise(ATTEMPTS)
    action = F.when(not_ready, "wait").when(failed & (n >= most), "fail").when(failed, "retry").otherwise("ack")
    delay = F.when(F.col("action") == "wait", NOT_READY_DELAY).when(F.col("action") == "retry", F.greatest(attempts_delay(n), F.lit(1)))
    return deliveries.withColumn("action", action).withColumn("delay", delay)


def barrier(shards: DataFrame, keys: list[str], state: Column, total: str = "total_shards", shard: str = "shard_index") -> DataFrame:
    """(keys, done, total, failed, open, ready) of each stage: ready when every shard from 0 to total - 1 is done.

    A shard is done if any of its deliveries is; failed and open count shards that are none of the others. A total
    that differs between rows counts as the greatest, one that is null everywhere as no shard: not ready.
    """
    rank = F.max(F.when(state == "done", 3).when(state == "failed", 2).otherwise(1))
    one = shards.groupBy(*keys, shard).agg(rank.alias("r"), F.max(total).alias("t"))
    known = F.col(shard).isNotNull() & (F.col(shard) >= 0)
    count = lambda r: F.count_if((F.col("r") == r) & known)
    of = one.groupBy(*keys).agg(count(3).alias("done"), F.coalesce(F.max("t"), F.lit(0)).cast("long").alias("total"), count(2).alias("failed"), count(1).alias("open"), F.count_if((F.col("r") == 3) & known & (F.col(shard) < F.col("t"))).alias("__in"))
    return of.withColumn("ready", (F.col("total") > 0) & (F.col("__in") >= F.col("total"))).drop("__in")


def progress_files(jobs: DataFrame, keys: list[str], artifacts: DataFrame | None = None, own: str = "files_in_shard") -> DataFrame:
    """jobs with `files`: their own count if above 0, else the number of files that `artifacts` (keys, files) knows of the shard, else 0."""
    fall = jobs.withColumn("__files", F.lit(None).cast("long")) if artifacts is None else jobs.join(artifacts.groupBy(*keys).agg(F.max("files").alias("__files")), keys, "left")
    return fall.withColumn("files", F.coalesce(F.when(F.col(own) > 0, F.col(own).cast("long")), F.col("__files").cast("long"), F.lit(0).cast("long"))).drop("__files")


def cleanup_objects(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """(generation_id, key): the objects that a finished generation leaves, once each.

    requests: generation_id, root_id, total_shards, manifest_ref, proof_ref, change_refs (array); changes: generation_id,
    status, path, source_key. These are the request, one done marker a shard, the refs, and the sources of added and modified files,
    by their key or else by root and path. Only keys below the prefixes that cleanup may touch come out.
    """
    g = F.col("generation_id")
    done = F.when(F.col("total_shards") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("total_shards"), F.lit(1)) - 1), lambda i: F.format_string("syncs/%s/done/shard-%06d.done", g, i))).otherwise(F.array().cast("array<string>"))
    fixed = F.concat(F.array(F.format_string("syncs/%s/request.json", g), F.col("manifest_ref"), F.col("proof_ref")), done, F.coalesce("change_refs", F.array().cast("array<string>")))
    own = requests.select("generation_id", F.explode(fixed).alias("key"))
    source = changes.where(F.col("status").isin("ADDED", "MODIFIED")).join(requests.select("generation_id", "root_id").distinct(), "generation_id")
    key = F.coalesce(F.nullif("source_key", F.lit("")), F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("files/"), "root_id", F.lit("/"), "path")))
    every = own.unionByName(source.select("generation_id", key.alias("key")))
    return every.join(deletable_keys(every, "key"), "key", "left_semi").select("generation_id", "key").distinct()
