"""Intermediate tables: JSON lines, sharded manifests, compressed states, tables that may not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_jsonl(df: DataFrame, path: str, per_file: int | None = None, gzip: bool = False) -> None:
    """One JSON object a line, null fields left out; at most per_file rows a file."""
    w = df.write.mode("errorifexists")
    if per_file:
        w = w.option("maxRecordsPerFile", per_file)
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table; one that doesn't exist is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def replace_partition(df: DataFrame, path: str) -> None:
    """Write one generation's folder; a retried write replaces what an earlier attempt left."""
    df.write.mode("overwrite").parquet(path)
