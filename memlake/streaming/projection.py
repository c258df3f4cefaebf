"""Structured Streaming forms of the event log: exactly-once intake, rate limits, dropped memories, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.sources.traces import EVENT


def event_stream(spark: SparkSession, path: str, late: str = "1 hour", per_trigger: int = 1000) -> DataFrame:
    """New trace files as a stream, one row an event_id within the lateness bound.

    The batch import replays however late an event comes; a stream needs a bound, and a repeat that is later than it passes. Sinks
    that must not see it merge by event_id, as apply_batches does.
    """
    lines = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)
    return lines.where("event_id is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(events: DataFrame, key: str = "run_id", window: str = "1 minute", most: int = 60) -> DataFrame:
    """(key, window, n) of tumbling windows that hold more than `most` events."""
    return events.groupBy(F.window("ts", window), key).count().where(F.col("count") > most).select(key, F.col("window.start").alias("start"), F.col("count").alias("n"))


def regrets(dropped: DataFrame, cited: DataFrame, ttl: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(memory_id, dropped_at, cited_at): citations of a memory within ttl of its being dropped; both sides are (memory_id, ts).

    Watermarks on both sides and the bounded interval let the join forget its state.
    """
    d = dropped.select(F.col("memory_id").alias("d_id"), F.col("ts").alias("dropped_at")).withWatermark("dropped_at", late)
    c = cited.select("memory_id", F.col("ts").alias("cited_at")).withWatermark("cited_at", late)
    near = F.expr(f"d_id = memory_id AND cited_at >= dropped_at AND cited_at <= dropped_at + INTERVAL {ttl}")
    return d.join(c, near).select("memory_id", "dropped_at", "cited_at")


def outcome_counts(events: DataFrame) -> DataFrame:
    """Running counts by kind, for a complete or update sink."""
    return events.groupBy("kind").count()


def apply_batches(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's events to the Parquet log, each micro-batch to its own folder of the log.

    A batch that is run again after a failure overwrites its own folder, so events are there once. Readers take the log's folders
    as one table through read_log.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log's events, one row an event_id."""
    from memlake.sources.traces import first_by_id

    return first_by_id(spark.read.schema(EVENT).parquet(log))
