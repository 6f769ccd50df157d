"""A sync: state -> diff -> chunks -> vectors -> rows and closes -> commit, as one plan per stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.hashes import generation_chunk_id
from quarrylake.operators.chunking import chunk_files
from quarrylake.operators.diff import changed, diff_states, merged_state, with_moves
from quarrylake.operators.jobs import cached_embeddings
from quarrylake.operators.visibility import carried_over
from quarrylake.plans.store import Conflict, Store
from quarrylake.sources.files import scan

BATCH = 16
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embedded(contents: DataFrame, embed: Embed, prefix: str = "search_document: ") -> DataFrame:
    """(org_id, content_hash, vector) of distinct contents, in batches, each vector of length one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            texts = [prefix + t for t in b["content"]]
            for i in range(0, len(texts), BATCH):
                for v in embed(texts[i : i + BATCH]):
                    n = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([float(x) / n for x in v])
            yield pd.DataFrame({"org_id": b["org_id"], "content_hash": b["content_hash"], "vector": out})

    return contents.select("org_id", "content_hash", "content").mapInPandas(run, "org_id string, content_hash string, vector array<double>")


def plan_generation(store: Store, root: str, files: DataFrame, seq: int, generation: str, profile: str = "local", embed: Embed | None = None, cache: DataFrame | None = None, model: str = "", include: Sequence[str] = (), exclude: Sequence[str] = ()):
    """(rows, closes, state, changes) of a generation over the visible one. files: root_id, path, size, mtime, content.

    Moved files carry their rows over; only added and modified ones are cut and embedded. With include or
    exclude, paths outside the selection stay as they are.
    """
    base = store.visible_seq(root)
    old = store.state(root)
    local = scan(files, old)
    state = local
    if include or exclude:
        keep = merged_state(old, local, include, exclude)
        times = old.select("path", "mtime").unionByName(local.select("path", "mtime")).groupBy("path").agg(F.max("mtime").alias("mtime"))
        state = keep.join(times, "path", "left").select("root_id", "path", "size", "content_hash", "mtime")
    changes = changed(with_moves(diff_states(old, state)))
    fresh = changes.where(F.col("status").isin("ADDED", "MODIFIED")).select("path", F.col("content_hash").alias("file_hash"))
    chunks = chunk_files(files.join(fresh.select("path"), "path", "left_semi"), profile).join(fresh.withColumnRenamed("path", "file_path"), "file_path")
    made = chunks.withColumns({
        "id": generation_chunk_id(F.col("root_id"), F.lit(generation), F.col("file_path"), F.col("chunk_index")),
        "generation_id": F.lit(generation), "valid_from_generation_seq": F.lit(seq).cast("long"), "org_id": F.lit(""),
    })
    if embed is None:
        made = made.withColumn("vector", F.lit(None).cast("array<double>"))
    else:
        cache = cache if cache is not None else store.spark.createDataFrame([], "org_id string, model_version string, content_hash string, vector array<double>")
        hits, misses = cached_embeddings(made, cache, model)
        new = embedded(misses, embed).withColumnRenamed("vector", "__v")
        made = hits.join(new, ["org_id", "content_hash"], "left").withColumn("vector", F.coalesce("vector", "__v")).drop("__v")
    moves = changes.where(F.col("old_path").isNotNull()).select("root_id", "old_path", "path")
    names = [f.split()[0] for f in _fields()]
    rows = made.select(*names).unionByName(carried_over(store.rows(root), moves, base, generation, seq).select(*names))
    gone = changes.where(F.col("status").isin("MODIFIED", "REMOVED")).select("root_id", F.col("path").alias("file_path")).unionByName(moves.select("root_id", F.col("old_path").alias("file_path")))
    closes = gone.select("root_id", "file_path", F.lit(base).cast("long").alias("base_seq"), F.lit(seq).cast("long").alias("gen_seq"))
    return rows, closes, state, changes


def _fields() -> list[str]:
    from quarrylake.plans.store import ROWS

    return [f.strip() for f in ROWS.split(", ")]


def sync(store: Store, root: str, files: DataFrame, **options) -> int:
    """Ingest and commit; on a conflict once more against the newer base. Returns the visible seq.

    InProgress, if another generation of the root is being built, is the caller's to wait for.
    """
    for again in (True, False):
        g = store.begin(root)
        try:
            rows, closes, state, _ = plan_generation(store, root, files, g.seq, g.token, **options)
            store.write(g, rows, closes, state)
            store.commit(g)
            return g.seq
        except Conflict:
            store.drop(g)
            if not again:
                raise
        except BaseException:
            store.drop(g)
            raise
    return 0
