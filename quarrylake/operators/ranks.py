"""Ranks in groups of any size: a hot group is ranked in buckets by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, keys: Sequence[str], text: str, to: str = "rn") -> DataFrame:
    """Rank from 1 of each row in its group, in the order of (sha256(text), text).

    The first two digits of the hash are a bucket. Rows are ranked in their bucket, and the buckets'
    sizes (at most 256 rows a group) say how many rows come before. Keys must not be null.
    """
    keyed = df.withColumn("__h", F.sha2(text, 256)).withColumn("__b", F.substring("__h", 1, 2))
    local = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", text)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = keyed.groupBy(*keys, "__b").agg(F.count("*").alias("__n")).select(*keys, "__b", before.alias("__before"))
    return local.join(sizes, [*keys, "__b"]).withColumn(to, (F.col("__before") + F.col("__r")).cast("long")).drop("__h", "__b", "__r", "__before")
