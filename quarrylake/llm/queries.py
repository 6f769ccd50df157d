"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm.neardup import similar_rows
from quarrylake.llm.leaks import leaked_items
from quarrylake.llm.mojibake import garbled_texts
from quarrylake.llm.neighbours import nearest_neighbours
from quarrylake.llm.scans import repaired_pages, scan_traces
from quarrylake.llm.splitting import LIMIT, split_oversized
from quarrylake.llm.tokens import BYTE_BPE_PATTERN, encode_corpus
from quarrylake.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_key", "content")
    return similar_rows(chunks, "chunk_key").select(F.col("a").alias("chunk_key_a"), F.col("b").alias("chunk_key_b"))


def _pages() -> Column:
    return F.col("page_number").isNotNull() | F.col("image_path").isNotNull()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_key", "file_path", "chunk_index", "page_number", "image_path", "content")
    return scan_traces(chunks, _pages())


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_key", "file_path", "chunk_index", "page_number", "image_path", "content")
    return repaired_pages(chunks, _pages())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(table(spark, folder, "chunks").select("chunk_key", "content"), "chunk_key")
    return pieces.where("whole_lines").select("chunk_key", "first_line", "last_line")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces with lines of their own: counted from the chunk's line_start where it is known."""
    chunks = table(spark, folder, "chunks").select("chunk_key", "line_start", "content")
    pieces = split_oversized(chunks, "chunk_key").join(chunks.where(F.octet_length("content") > LIMIT).select("chunk_key", "line_start"), "chunk_key")
    shift = F.coalesce("line_start", F.lit(1)) - 1
    return pieces.select("chunk_key", "chunk_index", (F.col("first_line") + shift).alias("line_start"), (F.col("last_line") + shift).alias("line_end"), "content")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest_neighbours(table(spark, folder, "indexed_chunks").select("id", "vector"), "id", "vector")
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_regions(spark, folder).where("exact").select("doc_id", "item_id")


def p9_regions(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text")
    return leaked_items(documents, items, "doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_restored(spark, folder).select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_regions": p9_regions, "p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {
    "p2_found": r"""
WITH w AS (SELECT chunk_key, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT chunk_key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, range(1, len(w) - 1) AS t(i)),
n AS (SELECT chunk_key, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_key AS x, b.chunk_key AS y, count(*) AS o FROM s a JOIN s b USING (s) WHERE a.chunk_key < b.chunk_key GROUP BY 1, 2)
SELECT x AS chunk_key_a, y AS chunk_key_b FROM p JOIN n nx ON nx.chunk_key = x JOIN n ny ON ny.chunk_key = y WHERE 17 * o >= 7 * (nx.n + ny.n)""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM d, range(1, len(w) - 11) AS t(i)),
h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM e, range(1, len(w) - 11) AS t(i))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)""",
    "p5_found": """
WITH RECURSIVE c AS (SELECT chunk_key, string_split(content, chr(10)) AS l FROM chunks WHERE strlen(content) > 2400),
u AS (SELECT chunk_key, i, strlen(l[i]) + CASE WHEN i < len(l) THEN 1 ELSE 0 END AS n FROM c, range(1, len(l) + 1) AS t(i)),
v AS (SELECT chunk_key, i, n, sum(n) OVER (PARTITION BY chunk_key ORDER BY i) AS b, max(n) OVER (PARTITION BY chunk_key) AS longest FROM u WHERE n > 0),
k AS (SELECT chunk_key, i, n, b, max(i) OVER (PARTITION BY chunk_key) AS last FROM v WHERE longest <= 1000),
e AS (SELECT a.chunk_key, a.i, a.last, max(z.i) AS e, max(z.b) AS eb FROM k a JOIN k z ON z.chunk_key = a.chunk_key AND z.i >= a.i AND z.b - (a.b - a.n) <= 2400 GROUP BY 1, 2, 3),
s AS (SELECT e.chunk_key, e.i, e.e, e.last, greatest(e.i + 1, coalesce(min(z.i), e.e + 1)) AS nxt
      FROM e LEFT JOIN k z ON z.chunk_key = e.chunk_key AND z.i <= e.e AND e.eb - (z.b - z.n) <= 400 GROUP BY 1, 2, 3, 4),
r AS (SELECT chunk_key, i, e, last, nxt FROM s WHERE i = 1
      UNION ALL SELECT s.chunk_key, s.i, s.e, s.last, s.nxt FROM r JOIN s ON s.chunk_key = r.chunk_key AND s.i = r.nxt WHERE r.e < r.last)
SELECT chunk_key, i::int AS first_line, e::int AS last_line FROM r""",
}
