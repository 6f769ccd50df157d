"""Deterministic slices of a file: pages and lines of its chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 1000


def checked(start: int, end: int, most: int = MOST) -> None:
    if start < 1 or end < start or end - start + 1 > most:
        raise ValueError(f"a range is positive, in order and of at most {most}")


def parse_range(text: str) -> tuple[int, int]:
    """`a:b`, or `a` for one."""
    a, colon, b = text.partition(":")
    start = int(a)
    end = int(b) if colon else start
    checked(start, end)
    return start, end


def read_pages(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of pages start..end, counted from 1 (stored from 0), in order."""
    checked(start, end)
    return rows.where(F.col("page_number").between(start - 1, end - 1)).orderBy("page_number", "chunk_index")


def read_lines(rows: DataFrame, start: int, end: int, keys: tuple[str, ...] = ("root_id", "file_path")) -> DataFrame:
    """(keys, line, content) of lines start..end. Chunks overlap: of several copies of a line, that of the
    chunk that begins first counts (then of the lowest chunk_index)."""
    checked(start, end)
    over = rows.where((F.col("line_end") >= start) & (F.col("line_start") <= end) & F.col("content").isNotNull())
    lines = over.select(*keys, "line_start", "line_end", "chunk_index", F.posexplode(F.filter(F.split("content", r"(?<=\n)"), lambda x: x != "")).alias("pos", "text"))
    at = lines.withColumn("line", F.col("line_start") + F.col("pos")).where((F.col("line") <= F.col("line_end")) & F.col("line").between(start, end))
    first = at.groupBy(*keys, "line").agg(F.min_by("text", F.struct("line_start", "chunk_index")).alias("content"))
    return first.orderBy(*keys, "line")


def ranges(rows: DataFrame, keys: tuple[str, ...] = ("root_id", "file_path")) -> DataFrame:
    """First and last page (from 1) and line of each file, and its type."""
    return rows.groupBy(*keys).agg(
        (F.min("page_number") + 1).alias("first_page"), (F.max("page_number") + 1).alias("last_page"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"),
        F.min_by("file_type", "chunk_index").alias("file_type"),
    )


def path_scan(rows: DataFrame, limit: int, prefix: str = "") -> DataFrame:
    """Paths in order, with a limit as the feature."""
    return rows.where(F.col("file_path").startswith(prefix)).orderBy("file_path", "chunk_index").limit(limit)


def numbered_best(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key (last of `order`)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")
