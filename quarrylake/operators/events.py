"""Product events and printed reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.text import byte_size


def enriched(events: DataFrame, props: Column, shared: dict[str, str], to: str = "props") -> DataFrame:
    """Events with shared properties added to their own map; properties without a value are left out.

    An event's own property goes before a shared one of its name. A null map counts as empty.
    """
    own = F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    fixed = F.create_map(*map(F.lit, chain.from_iterable(shared.items()))).cast("map<string,string>")
    rest = F.map_filter(fixed, lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    return events.withColumn(to, F.map_concat(own, rest))


def dry_run(stats: DataFrame) -> DataFrame:
    """(root_id, report): what a sync would do, of diff_stats."""
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}")))
    counts = F.concat_ws(", ", *[part(c, c) for c in ("added", "modified", "removed", "moved", "renamed")])
    line = F.concat(F.coalesce(F.nullif(counts, F.lit("")), F.lit("nothing to do")), F.when(F.col("uploads") > 0, F.concat(F.lit("; "), F.col("uploads").cast("string"), F.lit(" uploads, "), byte_size(F.col("upload_bytes")))).otherwise(""))
    return stats.select("root_id", line.alias("report"))


def result_lines(results: DataFrame, several_roots: bool) -> DataFrame:
    """(line) of search results: score with four decimals, root only if several were searched."""
    place = F.concat_ws("/", *(["root_id"] if several_roots else []), "file_path")
    return results.select(F.concat(F.format_string("%.4f", "score"), F.lit("  "), place, F.lit("#"), F.col("chunk_index").cast("string")).alias("line"))
