"""Continuous ingestion with Structured Streaming: debounced bursts, deduplicated messages, idempotent batches, failure streaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 32, name: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time (back-pressure).

    name: only the file, or the folder of files, of that name in it.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name is None:
        return reader.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def debounced(events: DataFrame, key: str, ts: str, pause: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """One row per burst of events of a key, once no event has come for the pause."""
    w = F.session_window(F.col(ts), pause).alias("w")
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "events")


def deduplicated(messages: DataFrame, key: str, ts: str, window: str = "24 hours") -> DataFrame:
    """Messages without repeats of an identifier within the window."""
    return messages.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def into_table(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch, transformed, as its own folder of a Parquet table: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Fixed values.
FIRST_DELAY, MOST_DELAY, MOST_SAME, MOST_SECONDS = 1.0, 60.0, 8, 600.0


@dataclass
class Streak:
    """Failures of one kind in a row."""

    kind: str = ""
    times: int = 0
    since: float = 0.0

    def failed(self, kind: str, at: float) -> None:
        if self.times and kind == self.kind:
            self.times += 1
        else:
            self.kind, self.times, self.since = kind, 1, at

    @property
    def delay(self) -> float:
        """Seconds to wait: one, then twice as long each time."""
        return min(FIRST_DELAY * 2 ** max(self.times - 1, 0), MOST_DELAY)

    def exhausted(self, at: float) -> bool:
        return self.times >= MOST_SAME or (self.times > 0 and at - self.since >= MOST_SECONDS)


def failure_streaks(results: DataFrame, key: str, ts: str, error: str) -> DataFrame:
    """(key, at, times, delay, exhausted) for each failure in a stream of results (error null = success), with state by key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Streak(*state.get) if state.exists else Streak()
        out = []
        for b in batches:
            for at, e in b.sort_values("at")[["at", "error"]].itertuples(index=False):
                second = at.timestamp()
                if e is None or pd.isna(e):
                    s = Streak()
                    continue
                s.failed(e, second)
                out.append((k[0], at, s.times, s.delay, s.exhausted(second)))
        state.update((s.kind, s.times, s.since))
        yield pd.DataFrame(out, columns=[key, "at", "times", "delay", "exhausted"])

    kind = results.schema[key].dataType.simpleString()
    given = results.select(key, F.col(ts).alias("at"), F.col(error).alias("error"))
    return given.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, times int, delay double, exhausted boolean", "kind string, times int, since double", "append", GroupStateTimeout.NoTimeout)


def stalled(progress: DataFrame, key: str, ts: str, minutes: int = 30) -> DataFrame:
    """Keys whose last progress lies so long before the newest event of the table."""
    last = progress.groupBy(key).agg(F.max(ts).alias("last"))
    newest = progress.agg(F.max(ts)).first()[0]
    return last.where(F.col("last") < F.lit(newest) - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
