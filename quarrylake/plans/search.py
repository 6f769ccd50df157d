"""One search over many roots as one plan: access and validity below the ranking, so k results are found if there are k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.paths import glob_filter
from quarrylake.operators.access import proven, without_denied
from quarrylake.operators.ranking import bm25, by_vector, hybrid, merged_roots, overfetch, top
from quarrylake.operators.visibility import visible

RESULT = ["root_id", "file_path", "chunk_index", "content", "file_type", "page_number"]


def chosen_roots(root_id: str | None = None, root_ids: Sequence[str] | None = None, all_roots: bool = False) -> list[str] | None:
    """Exactly one way of naming roots; duplicates go. None: all that are readable."""
    if (root_id is not None) + (root_ids is not None) + all_roots != 1:
        raise ValueError("name roots by exactly one of root_id, root_ids, all_roots")
    return None if all_roots else list(dict.fromkeys([root_id] if root_id is not None else root_ids))


def candidates(rows: DataFrame, seq: int, readable: DataFrame, roots: list[str] | None = None, glob: str | None = None, denies: DataFrame | None = None, proof: DataFrame | None = None) -> DataFrame:
    """Rows a user may find: visible at seq, of readable (and named) roots, matching the glob, not denied, proven."""
    out = rows.where(visible(seq))
    if roots is not None:
        out = out.where(F.col("root_id").isin(*roots))
    out = out.join(readable.select("root_id").distinct(), "root_id", "left_semi")
    if glob:
        out = out.where(glob_filter(F.col("file_path"), glob))
    if denies is not None:
        out = without_denied(out, denies)
    return proven(out, proof) if proof is not None else out


def search(rows: DataFrame, query: str, mode: str = "hybrid", k: int = 10, embedding: Sequence[float] | None = None, per_root: bool = False) -> DataFrame:
    """The k best of candidate rows by fts, vector or hybrid; without an embedding hybrid is fts, vector an error."""
    if mode not in ("fts", "vector", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "vector" and embedding is None:
        raise ValueError("vectors are disabled here")
    tie = ["id"]
    if mode == "hybrid" and embedding is not None:
        best = hybrid(rows, "id", "content", "vector", query, embedding, k)
        return top(rows.join(best, "id"), k, tie).select("id", *RESULT, "score")
    scored = by_vector(rows, "vector", embedding).drop("distance") if mode == "vector" else bm25(rows, "content", query)
    scored = scored.select("id", *RESULT, "score")
    return merged_roots(scored, "root_id", k, tie) if per_root else top(scored, k, tie)


def search_then_filter(rows: DataFrame, query: str, k: int, denies: DataFrame) -> DataFrame:
    """Compatible with engines that filter after the limit: over-fetch, then deny, then k; may find fewer than k."""
    found = top(bm25(rows, "content", query), overfetch(k), ["id"])
    return top(without_denied(found, denies), k, ["id"]).select("id", *RESULT, "score")
