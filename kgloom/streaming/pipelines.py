"""Incremental processing by Structured Streaming.

Every pipeline reads files as a stream, keeps its progress in a checkpoint, and runs as far as there is input
(``availableNow``); the same code runs continuously with another trigger. Sinks are idempotent a batch, so that a
crash between writing and committing repeats a batch without doubling it. State is bounded by watermarks; the
ones without are keyed states that the reference keeps for ever, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.sources.writers import scratch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of ``path``, a folder or one file, as a stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream reads folders only
    return stream.option("pathGlobFilter", name).parquet(folder)


def run(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Run a stream until its input is used up; gives the number of batches written."""
    seen: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        write(batch, number)
        seen.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return len(seen)


def append_batches(root: str) -> Callable[[DataFrame, int], None]:
    """ST1, ST13: a sink with one folder a batch; a repeated batch replaces its own folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}")


def replace(root: str) -> Callable[[DataFrame, int], None]:
    """A sink for complete results: each batch is a version of its own, the last one counts."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/v={number}")


def last_version(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(root)
    return rows.join(F.broadcast(rows.agg(F.max("v").alias("v"))), "v").drop("v")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """ST2: the last value of each key of an event log."""
    stream = read_stream(spark, path, EVENTS)
    state = stream.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.count("*").alias("entries"))
    root = scratch(spark, "latest")
    run(state.select("user_id", "event_type", F.round("m.value", 6).alias("value"), "entries"), replace(root), scratch(spark, "latest-progress"), "complete")
    return last_version(spark, root)


def rates(spark: SparkSession, path: str, width: str = "1 hour", late: str = "365 days") -> DataFrame:
    """ST4: events a window; ``late`` is how long a window waits for late events."""
    stream = read_stream(spark, path, EVENTS).withWatermark("ts", late)
    state = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    root = scratch(spark, "rates")
    run(state.select(F.col("w.start").alias("hour"), "event_type", "n"), replace(root), scratch(spark, "rates-progress"), "complete")
    return last_version(spark, root)


def first_only(spark: SparkSession, path: str) -> DataFrame:
    """Events of the first batch that brings their key, repeats dropped by streaming state."""
    stream = read_stream(spark, path, EVENTS).dropDuplicates(["user_id", "event_type"])
    root = scratch(spark, "first")
    run(stream.select("user_id", "event_type"), append_batches(root), scratch(spark, "first-progress"))
    return spark.read.parquet(root).select("user_id", "event_type")


def resumed(spark: SparkSession, path: str) -> DataFrame:
    """ST1, ST13, S20: rows loaded exactly once although the stream is started twice on one checkpoint."""
    root, progress = scratch(spark, "resumed"), scratch(spark, "resumed-progress")
    for _ in range(2):
        run(read_stream(spark, path, EVENTS).select("event_id", "event_type"), append_batches(root), progress)
    return spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_events"))


def pending(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """ST3: streamed events whose user is not in the static set of done ones."""
    stream = read_stream(spark, path, EVENTS).join(done.select("user_id").distinct(), "user_id", "left_anti")
    root = scratch(spark, "pending")
    run(stream.select("event_id", "user_id"), append_batches(root), scratch(spark, "pending-progress"))
    return spark.read.parquet(root).select("event_id", "user_id")


def tailed(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """ST15: JSON lines appended to a log in parts, streamed after each one from where the stream stopped; every line once, with the part it came in."""
    path, root, progress = scratch(spark, "log"), scratch(spark, "tail"), scratch(spark, "tail-progress")
    for part in parts:
        part.write.mode("append").json(path)
        stream = spark.readStream.schema(parts[0].schema).json(path)
        run(stream, append_batches(root), progress)
    return spark.read.parquet(root)


def coalesced(spark: SparkSession, path: str, ranks: dict[str, int]) -> DataFrame:
    """ST5: queue entries of one key coalesced; the highest rank of their kinds wins."""
    rank = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])[F.col("event_type")]
    stream = read_stream(spark, path, EVENTS).groupBy("user_id").agg(F.max(rank).alias("rank"), F.count("*").alias("requests"))
    root = scratch(spark, "queue")
    run(stream, replace(root), scratch(spark, "queue-progress"), "complete")
    return last_version(spark, root)


def trailing_failures(spark: SparkSession, path: str) -> DataFrame:
    """A28 as a keyed state: events and failures since the last success of each user, in order of time within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401
        n, failed = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for kind in rows["event_type"]:
            n, failed = n + 1, failed + 1 if kind == "error" else 0
        state.update((n, failed))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "trailing": [failed]})

    stream = read_stream(spark, path, EVENTS).groupBy("user_id").applyInPandasWithState(step, "user_id long, events long, trailing long", "n long, failed long", "update", "NoTimeout")
    root = scratch(spark, "trailing")
    run(stream, append_batches(root), scratch(spark, "trailing-progress"), "update")
    rows = spark.read.parquet(root)
    return rows.groupBy("user_id").agg(F.max_by("events", "batch").alias("events"), F.max_by("trailing", "batch").alias("trailing"))
