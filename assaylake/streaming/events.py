"""Streams over events and growing corpora; additions to the batch operators, which have no stream of their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums for each window and type; events that come later than ``late`` are dropped, repeats counted once."""
    fresh = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return fresh.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running_outcomes(turns: DataFrame) -> DataFrame:
    """For each conversation of a stream of turns the turns so far, those right, and the first error; state is three numbers."""

    def update(key, frames, state):
        n, right, first = state.get if state.exists else (0, 0, -1)
        for frame in frames:
            for turn, ok in sorted(zip(frame["turn"], frame["passed"], strict=True)):
                n, right = n + 1, right + int(bool(ok))
                if not ok and (first < 0 or turn < first):
                    first = int(turn)
        state.update((n, right, first))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "n_right": [right], "first_error": [first]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, n_turns long, n_right long, first_error long", "n long, r long, f long", "update", "NoTimeout")


def build_missing(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Build rows (embeddings, page texts) for the keys that a table does not have yet, batch by batch; a restart goes on
    where it stopped, and a batch that runs twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(target).select(key)
            todo = batch.dropDuplicates([key]).join(done, key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = batch.dropDuplicates([key])
        build(todo).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
