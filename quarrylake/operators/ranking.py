"""Top-k by BM25, by vector, and by both.

Scores are computed from each row in one pass; a query's document frequencies and the collection's size
and mean length are one aggregation before it. No posting list is exploded and nothing but the k best
rows of each partition moves.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.text import tokens
from quarrylake.functions.vectors import constant, cosine

K1, B = 1.2, 0.75
RRF_K = 60
OVERFETCH = (10, 50, 1000)  # times k, at least, at most


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))


def bm25(rows: DataFrame, text: str, query: str, by: str | None = None) -> DataFrame:
    """rows that hold a term of the query, with `score`. Statistics are those of `rows`, or of each group of `by`.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); null texts are empty documents. A query without terms finds nothing.
    """
    terms = terms_of(query)
    if not terms:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    counted = rows.withColumn("__t", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    tf = lambda t: F.size(F.filter("__t", lambda x: x == t))
    counted = counted.select(*rows.columns, F.size("__t").alias("__dl"), *[tf(t).alias(f"__tf{i}") for i, t in enumerate(terms)])
    stats = [F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))]]
    any_term = sum((F.col(f"__tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    if by is None:
        s = counted.agg(*stats).first()
        known = {c: F.lit(s[c]) for c in s.asDict()}
        found = counted.where(any_term)
    else:
        # one row of statistics a group; few groups beside rows, so Spark picks how to join them
        found = counted.where(any_term).join(counted.groupBy(by).agg(*stats), by)
        known = {c: F.col(c) for c in ["__n", "__avg", *[f"__df{i}" for i in range(len(terms))]]}
    part = lambda i: F.log(1 + (known["__n"] - known[f"__df{i}"] + 0.5) / (known[f"__df{i}"] + 0.5)) * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + K1 * (1 - B + B * F.col("__dl") / known["__avg"]))
    return found.withColumn("score", sum((part(i) for i in range(len(terms))), F.lit(0.0))).select(*rows.columns, "score")


def by_vector(rows: DataFrame, vector: str, query: Sequence[float]) -> DataFrame:
    """rows with a comparable vector, with `score` (cosine similarity) and `distance`."""
    return rows.withColumn("score", cosine(F.col(vector), constant(query))).where(F.col("score").isNotNull()).withColumn("distance", 1 - F.col("score"))


def top(scored: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """The k best rows; ties by the given columns, ascending."""
    return scored.orderBy(F.col("score").desc(), *tie).limit(k)


def ranked(best: DataFrame, tie: Sequence[str], lists: str | None = None) -> DataFrame:
    """A short list (a top-k result) with its rank from 0."""
    w = Window.partitionBy(*([lists] if lists else [F.lit(0)])).orderBy(F.col("score").desc(), *tie)
    return best.withColumn("rank", F.row_number().over(w) - 1)


def rrf(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked lists with `rank` from 0."""
    all_ = None
    for one in lists:
        one = one.select(key, "rank")
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy(key).agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"))


def overfetch(k: int) -> int:
    times, least, most = OVERFETCH
    return min(max(times * k, least), most)


def hybrid(rows: DataFrame, key: str, text: str, vector: str, query: str, embedding: Sequence[float], k: int) -> DataFrame:
    """(key, score) of the k best by fusion of both rankings, each over-fetched."""
    n = overfetch(k)
    a = ranked(top(bm25(rows, text, query).select(key, "score"), n, [key]), [key])
    b = ranked(top(by_vector(rows, vector, embedding).select(key, "score"), n, [key]), [key])
    return top(rrf([a, b], key), k, [key])


def merged_roots(scored: DataFrame, root: str, k: int, tie: Sequence[str]) -> DataFrame:
    """Each root's k best, then the k best of all."""
    w = Window.partitionBy(root).orderBy(F.col("score").desc(), *tie)
    return top(scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"), k, tie)


def merged_shards(scored: DataFrame, key: str, shard: Column, shards: int, k: int, fetch: int) -> DataFrame:
    """(key, score): one shard's own scores, or fusion of the ranks of several shards (in which raw scores are lost)."""
    if shards == 1:
        return top(scored.select(key, "score"), k, [key])
    w = Window.partitionBy("__s").orderBy(F.col("score").desc(), key)
    lists = scored.withColumn("__s", shard).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < fetch)
    return top(rrf([lists], key), k, [key])
