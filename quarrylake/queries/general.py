"""Queries of the general training-data operators (problems 1, 3 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators.delivery import admit, best_first, message_key, surplus_deliveries
from quarrylake.operators.history import file_versions
from quarrylake.operators.snapshots import snapshot_changes
from quarrylake.session import table

#: Deliveries of batches from here on are "new" in p1_admitted.
NEW_BATCH = 1000


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "queue_jobs").select("delivery_id", "job_id", "attempts", "lease_until")
    return surplus_deliveries(jobs, message_key(F.col("job_id")), best_first(), ["delivery_id"]).select("delivery_id")


def p1_admitted(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "queue_jobs").select("delivery_id", "batch_id", "job_id", "attempts", "lease_until")
    new = F.col("batch_id") >= NEW_BATCH
    return admit(jobs.where(new), jobs.where(~new), "job_id", best_first(), ["delivery_id"]).select("delivery_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return file_versions(table(spark, folder, "indexed_chunks")).drop("file_hash")


def p3_versions(spark: SparkSession, folder: str) -> DataFrame:
    return file_versions(table(spark, folder, "indexed_chunks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "root_states"))


QUERIES = {"p1_found": p1_found, "p1_admitted": p1_admitted, "p3_found": p3_found, "p3_versions": p3_versions, "p7_found": p7_found}

_VERSIONS = """
WITH ev AS (
  SELECT root_id, file_path, valid_from_generation_seq AS seq, written_at, row_no,
         nullif(regexp_replace(lower(trim(file_hash)), '^sha256:', ''), '') AS h
  FROM indexed_chunks WHERE op = 'upsert' AND file_hash IS NOT NULL AND valid_from_generation_seq IS NOT NULL
  UNION ALL
  SELECT root_id, file_path, valid_to_generation_seq, written_at, row_no, NULL
  FROM indexed_chunks
  WHERE valid_to_generation_seq > 0 AND (op = 'close' OR (op = 'upsert' AND valid_to_generation_seq > valid_from_generation_seq))
), unit AS (
  SELECT root_id, file_path, seq, h FROM (
    SELECT *, row_number() OVER (PARTITION BY root_id, file_path, seq ORDER BY (h IS NULL), written_at DESC, row_no DESC) AS rn FROM ev)
  WHERE rn = 1
), chg AS (
  SELECT *, lag(coalesce(h, '')) OVER (PARTITION BY root_id, file_path ORDER BY seq) AS ph FROM unit
), runs AS (
  SELECT root_id, file_path, h, seq, lead(seq) OVER (PARTITION BY root_id, file_path ORDER BY seq) AS nxt
  FROM chg WHERE ph IS DISTINCT FROM coalesce(h, '')
)
SELECT root_id, file_path, {hash} seq AS valid_from_generation_seq, coalesce(nxt, 0) AS valid_to_generation_seq FROM runs WHERE h IS NOT NULL
"""

ORACLE = {
    "p1_found": """
SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY k ORDER BY attempts DESC NULLS LAST, lease_until DESC NULLS LAST, delivery_id) AS rn
  FROM (SELECT *, nullif(lower(trim(job_id, chr(32) || chr(9) || chr(13) || chr(10))), '') AS k FROM queue_jobs) WHERE k IS NOT NULL)
WHERE rn > 1""",
    "p1_admitted": f"""
WITH j AS (SELECT *, nullif(lower(trim(job_id, chr(32) || chr(9) || chr(13) || chr(10))), '') AS k FROM queue_jobs),
n AS (SELECT delivery_id, k, row_number() OVER (PARTITION BY k ORDER BY attempts DESC NULLS LAST, lease_until DESC NULLS LAST, delivery_id) AS rn
      FROM j WHERE batch_id >= {NEW_BATCH})
SELECT delivery_id FROM n WHERE k IS NULL OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM j WHERE j.batch_id < {NEW_BATCH} AND j.k = n.k))""",
    "p3_found": _VERSIONS.format(hash=""),
    "p3_versions": _VERSIONS.format(hash="h AS file_hash,"),
    "p7_found": r"""
WITH s AS (
  SELECT root_id, generation_seq, row_number() OVER (PARTITION BY root_id ORDER BY generation_seq) AS i
  FROM (SELECT DISTINCT root_id, generation_seq FROM root_states)
), d AS (
  SELECT root_id, path, generation_seq, h FROM (
    SELECT root_id, regexp_replace(path, '^(\./)+', '') AS path, generation_seq,
           nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS h,
           row_number() OVER (PARTITION BY root_id, regexp_replace(path, '^(\./)+', ''), generation_seq
                              ORDER BY mtime DESC, received_at DESC NULLS LAST,
                                       nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') DESC NULLS LAST) AS rn
    FROM root_states) WHERE rn = 1
), x AS (SELECT d.*, s.i FROM d JOIN s USING (root_id, generation_seq)
), pairs AS (
  SELECT coalesce(a.root_id, b.root_id) AS root_id, coalesce(a.path, b.path) AS path, coalesce(a.i, b.i + 1) AS i,
         CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'REMOVED' WHEN a.h <> b.h THEN 'CHANGED' END AS status
  FROM x a FULL JOIN x b ON a.root_id = b.root_id AND a.path = b.path AND a.i = b.i + 1
)
SELECT p.root_id, s.generation_seq, p.path, p.status FROM pairs p JOIN s ON s.root_id = p.root_id AND s.i = p.i
WHERE p.status IS NOT NULL AND p.i > 1""",
}
