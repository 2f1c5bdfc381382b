"""Structured Streaming jobs. On bounded input each gives the rows of its batch twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import scans
from corpuslab.operators.guards import MAX_FAILURES, MAX_STEPS
from corpuslab.streaming import stateful

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The event log as a stream, ``files`` files a batch. Timestamps without zone are taken in the session's."""
    schema = EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """Cost and calls by ``keys`` (provider, model, path) in tumbling windows; events later than ``late`` are dropped once
    a window is closed."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 6).alias("cost"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "calls", "cost")


def running_totals(windows: DataFrame, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """Closed windows of ``rollup`` with calls and cost of their keys up to and with each, calls_so_far and cost_so_far. A key's
    windows are scanned by slices, however many it has."""
    keyed = windows.withColumn("__keys", F.to_json(F.struct(*keys)))
    rows = scans.prefix(scans.sliced(keyed, "__keys", ["start"]), "__keys", ["start"], {"calls_so_far": ("sum", F.col("calls")), "cost_so_far": ("sum", F.col("cost"))})
    return scans.bare(rows).withColumn("cost_so_far", F.round("cost_so_far", 6)).drop("__keys")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with no longer gap between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def sliding(events: DataFrame, window: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in overlapping windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; repeats within ``late`` of it are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def budget_crossings(events: DataFrame, limit: float, idle: str = "90 days", late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, so_far): the event of each user whose cost reaches the limit, once. A user without events for
    ``idle`` is forgotten, and starts anew."""
    return stateful.run(events, "user_id", stateful.Budget(limit, idle), "user_id long, event_id long, so_far double", late)


def breaker_trips(events: DataFrame, max_failures: int = MAX_FAILURES, max_steps: int = MAX_STEPS, idle: str = "90 days", late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id): the event of each user at which the breaker trips. `error` is a failure, `purchase` a
    success, `signup` a step. A user without events for ``idle`` is forgotten, and its breaker is whole again."""
    return stateful.run(events, "user_id", stateful.Breaker(max_failures, max_steps, idle), "user_id long, event_id long", late)


SPAN = "trace_id long, span_id string, parent string, name string, kind string, start double, end double, status string, error string, meta map<string,string>, dur_ms double"


def closed_spans(events: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of events (trace_id, seq, ts, type, step, tool, tools, confirm_id, approved, result, error, reason, thought) as
    they close, with the columns and rows of ``traces.spans``. A trace without events for ``idle`` is given up:
    what it has open is abandoned."""
    return stateful.run(stateful.bucketed(events), "bucket", stateful.Traces(idle), SPAN, late)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a table of that name in memory; for small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream into a Parquet folder, read back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
