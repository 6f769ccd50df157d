"""History of changing attributes by tree reduction of unit intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions.hashes import bare_hash

FAN_BITS = 5  # one shuffled round merges 2**5 neighbouring blocks, pairwise in order
CLOSED = ""  # payload of "no open version"


def file_events(df: DataFrame) -> DataFrame:
    """(root_id, file_path, seq, at, no, hash) stated by the rows of an index log; null hash = closed.

    An upsert with a hash states it at its valid_from; a close row, and an upsert whose valid_to
    lies above its valid_from, state a close at valid_to. 0 and null ends state nothing.
    """
    f, t = F.col("valid_from_generation_seq"), F.col("valid_to_generation_seq")
    h = bare_hash(F.col("file_hash"))
    upsert = F.col("op") == "upsert"
    ends = (t > 0) & ((F.col("op") == "close") | (upsert & (t > f)))
    event = lambda on, seq, value: F.when(on, F.struct(seq.alias("seq"), value.alias("hash")))
    both = F.array(event(upsert & h.isNotNull() & f.isNotNull(), f, h), event(ends, t, F.lit(None).cast("string")))
    return (
        df.select("root_id", "file_path", F.col("written_at").alias("at"), F.col("row_no").alias("no"), F.explode(both).alias("x"))
        .where(F.col("x").isNotNull())
        .select("root_id", "file_path", "x.seq", "at", "no", "x.hash")
    )


def unit_states(events: DataFrame, entity: Sequence[str]) -> DataFrame:
    """One payload per entity and seq: the latest stated hash, else CLOSED (partial aggregation)."""
    latest = F.max(F.when(F.col("hash").isNotNull(), F.struct("at", "no", "hash")))
    return events.groupBy(*entity, "seq").agg(latest.alias("m")).select(*entity, "seq", F.coalesce(F.col("m.hash"), F.lit(CLOSED)).alias("p"))


def _coalesced(a: Column) -> Column:
    """Runs (s, e, p) in order of s; e null = end not known yet. Neighbours of equal payload become one."""
    joins = lambda i: (i > 0) & F.get(a, i - 1)["e"].isNull() & (F.get(a, i - 1)["p"] == F.get(a, i)["p"])
    heads = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~joins(i))

    def run(i: Column, j: Column) -> Column:
        after = F.get(F.col("heads"), j + 1)
        tail = F.get(a, F.coalesce(after, F.size(a)) - 1)
        return F.struct(F.get(a, i)["s"].alias("s"), F.coalesce(tail["e"], F.get(a, after)["s"]).alias("e"), F.get(a, i)["p"].alias("p"))

    return heads, lambda: F.transform(F.col("heads"), run)


def coalesce_runs(units: DataFrame, entity: Sequence[str], lowest: int, highest: int) -> DataFrame:
    """Tree reduction of unit states to maximal runs (entity, s, e, p), e null for the last.

    Block b of round r covers the seqs with seq >> (FAN_BITS * r) = b. A round merges the blocks of
    one parent; of the result only the first and the last run can still change, so only these two
    go on and the runs between are final. A group therefore never holds more than 2 * 2**FAN_BITS
    runs, however many versions or repeated rows one entity has, and log(range) rounds suffice.
    """
    bits, shift, done = max(1, (highest - lowest).bit_length()), 0, []
    state = units.select(*entity, (F.col("seq") - F.lit(lowest)).alias("b"), F.array(F.struct(F.col("seq").alias("s"), F.lit(None).cast("long").alias("e"), "p")).alias("runs"))
    while shift < bits:
        shift += FAN_BITS
        up = state.groupBy(*entity, F.shiftright("b", FAN_BITS).alias("b")).agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("a"))
        heads, merged = _coalesced(F.col("a"))
        up = up.withColumn("heads", heads).withColumn("m", merged()).drop("a", "heads")
        if shift >= bits:
            done.append(up.select(*entity, F.inline("m")))
        else:
            done.append(up.where(F.size("m") > 2).select(*entity, F.inline(F.slice("m", F.lit(2), F.size("m") - 2))))
            ends = F.when(F.size("m") > 2, F.array(F.get("m", F.lit(0)), F.get("m", F.size("m") - 1))).otherwise(F.col("m"))
            state = up.select(*entity, "b", ends.alias("runs"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def file_versions(df: DataFrame) -> DataFrame:
    """Versions (root_id, file_path, hash, valid_from_generation_seq, valid_to_generation_seq) of each file.

    A version starts where a hash is stated and none or another is open, and ends (exclusive) at the
    next other hash or close; 0 = still open. Rows of any order; within a generation the latest
    written_at wins (then the greatest row_no). Rows without hash state none; an empty log has no versions.
    """
    events = file_events(df)
    lo, hi = events.agg(F.min("seq"), F.max("seq")).first()
    entity = ["root_id", "file_path"]
    runs = coalesce_runs(unit_states(events, entity), entity, lo or 0, hi or 0)
    return runs.where(F.col("p") != CLOSED).select(
        *entity, F.col("p").alias("file_hash"), F.col("s").alias("valid_from_generation_seq"), F.coalesce("e", F.lit(0)).cast("long").alias("valid_to_generation_seq")
    )
