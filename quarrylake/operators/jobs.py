"""Sync jobs, generations and keyed tables of the control plane, as plain relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in order; partial aggregation, no window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """Stored rows with those of `new` in place of (or, without replace, beside) rows of equal keys."""
    if replace:
        return stored.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new)
    return stored.unionByName(new.join(stored.select(*keys).distinct(), [*keys], "left_anti"))


def job_progress(shards: DataFrame, job: str, done: str, total: str) -> DataFrame:
    return shards.groupBy(job).agg(F.coalesce(F.sum(done), F.lit(0)).alias("done"), F.coalesce(F.sum(total), F.lit(0)).alias("total"))


def status_counts(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count("*").alias("n"))


def active_exists(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """(key) for which any of several tables has a row."""
    out = None
    for p in parts:
        out = p.select(key) if out is None else out.unionAll(p.select(key))
    return out.distinct()


def recent(df: DataFrame, order: str, n: int = 20, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.col(order).desc(), *([tie] if tie else [])).limit(n)


def roots_with_generation(roots: DataFrame, generations: DataFrame) -> DataFrame:
    """Roots with the seq of their visible generation, 0 without."""
    g = generations.select(F.col("generation_id").alias("visible_generation_id"), F.col("generation_seq").alias("seq"))
    return roots.drop("visible_generation_seq").join(g, "visible_generation_id", "left").withColumn("visible_generation_seq", F.coalesce("seq", F.lit(0))).drop("seq")


def stale_jobs(jobs: DataFrame, generations: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Running jobs without progress for so long, or of a failed generation."""
    failed = generations.where("status = 'failed'").select("generation_id").distinct()
    marked = jobs.join(failed.withColumn("__failed", F.lit(True)), "generation_id", "left")
    old = F.col("updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return marked.where(F.col("status").isin("running", "queued") & (old | F.col("__failed").isNotNull())).drop("__failed")


def resolved_keys(keys: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """API keys of members, not expired: inner join on (org_id, user_id)."""
    live = keys.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.join(members.select("org_id", "user_id", "role"), ["org_id", "user_id"])


def distinct_files(upserts: DataFrame, closes: DataFrame) -> DataFrame:
    """One row: how many files an artifact touches by rows or closes."""
    return upserts.select("file_path").unionAll(closes.select("file_path")).agg(F.countDistinct("file_path").alias("files"))


def deletable_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct object keys below the prefixes that cleanup may touch."""
    return df.where(F.col(key).rlike("^(syncs|files|bundles)/")).select(key).distinct()


def cached_embeddings(chunks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with the cached vector of their content, distinct contents without one).

    cache: org_id, model_version, content_hash, vector. The cache is reduced to one row per content first.
    """
    keys = ["org_id", "content_hash"]
    c = cache.where(F.col("model_version") == model).groupBy(*keys).agg(F.first("vector").alias("vector"))
    hits = chunks.drop("vector").join(c, keys, "left")
    misses = chunks.join(c, keys, "left_anti").groupBy(*keys).agg(F.first("content").alias("content"))
    return hits, misses


def gaps_and_islands(df: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Debounced bursts: (key, first, last, events) with pauses under `seconds` inside. The batch twin of a session window."""
    return df.groupBy(F.session_window(F.col(ts), f"{int(seconds * 1000)} milliseconds").alias("w"), key).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "first", "last", "events")


def attempts_delay(attempts: Column) -> Column:
    """Seconds until a failed message is tried again."""
    return attempts * attempts * 10


def in_flight(jobs: DataFrame, key: str, order: str, most: int = 32) -> DataFrame:
    """The first `most` unfinished shards of each job, those that may run now."""
    w = Window.partitionBy(key).orderBy(order)
    return jobs.where("status <> 'done'").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
