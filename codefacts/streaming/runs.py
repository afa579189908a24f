"""Run tracking over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.runs import STALE_SECONDS
from ..session import new_table_path
from .sinks import insert_batch, read_batches, run_batches, run_to_table, write_batch
from .state import PARTIAL, STRETCH, RunFold, Silences, merged_runs, open_stretches, stretch_times, with_state_store


GRACE_SECONDS = 24 * 3600


def _processed(stream: DataFrame, key: str, processor: StatefulProcessor, columns: str, watermark: str, mode: str) -> DataFrame:
    with_state_store(stream.sparkSession)
    named = next(f for f in stream.schema if f.name == key)
    schema = StructType([named, *StructType.fromDDL(columns).fields])
    return stream.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts")).groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime")


def stale_sessions(heartbeats: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """Silences of a stream ``(run_id, ts)``: a row per stretch of heartbeats that ended ``seconds`` ago.

    A timer per run reports a stretch when the watermark, which any run moves on, has passed its end by ``seconds``; the state
    of the run goes with it.
    """
    return stretch_times(_processed(heartbeats, "run_id", Silences(seconds), STRETCH, f"{int(seconds)} seconds", "Append"))


def run_stale_sessions(heartbeats: DataFrame, seconds: int = STALE_SECONDS, now: Column | None = None) -> DataFrame:
    """The silences of everything available, the last ones included: those the stream has reported, and from its state
    those that nobody's later heartbeat closed, if they began ``seconds`` before ``now`` (default: after the input's end)."""
    path = new_table_path(heartbeats.sparkSession, "stale")
    closed = run_to_table(stale_sessions(heartbeats, seconds), "stale", path=path)
    left = open_stretches(heartbeats.sparkSession, f"{path}/state", "run_id")
    if now is not None:
        left = left.filter(F.col("finished_at") + F.expr(f"INTERVAL {int(seconds)} SECONDS") <= now)
    return closed.unionByName(left)


def run_fold(events: DataFrame, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """Current state of every run from a stream of run events.

    Each batch writes the folds of the runs it touched; folds of one run are merged when they are read, so the state of a
    run can go once it has been silent for ``grace_seconds`` of event time.
    """
    folds = _processed(events, "run_id", RunFold(grace_seconds), PARTIAL, f"{int(grace_seconds)} seconds", "Update")
    path = run_batches(folds, "runs", write_batch, mode="update")
    schema = StructType([*folds.schema.fields, StructField("batch_id", IntegerType())])
    return merged_runs(events.sparkSession.read.schema(schema).option("basePath", path).parquet(path))


def throttled(events: DataFrame, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """One progress row per run and interval of a stream with event time ``ts``."""
    per = events.withWatermark("ts", late).groupBy(key, F.window("ts", width)).agg(
        F.count("*").alias("n"), F.max("ts").alias("flushed_at")
    )
    return per.select(key, F.col("window.start").alias("bucket"), "n", "flushed_at")


def run_throttled(events: DataFrame, key: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The progress rows of a stream, intervals that are still open included: the latest update of each interval."""
    per = throttled(events, key, width, late)
    path = run_batches(per, "progress", write_batch, mode="update")
    schema = StructType([*per.schema.fields, StructField("batch_id", IntegerType())])
    updates = events.sparkSession.read.schema(schema).option("basePath", path).parquet(path)
    latest = updates.groupBy(key, "bucket").agg(F.max_by(F.struct("n", "flushed_at"), "batch_id").alias("_r"))
    return latest.select(key, "bucket", "_r.*")


def late_rows(events: DataFrame, emitted: DataFrame, on: list[str]) -> DataFrame:
    """Rows a stream left out (behind its watermark or not closed yet), by comparison with a batch read."""
    return events.join(emitted.select(*on), on, "left_anti")


def run_insert(stream: DataFrame, keys: list[str], name: str = "inserted") -> DataFrame:
    """Store every key of a stream once, whatever is replayed or repeated."""
    path = run_batches(stream, name, insert_batch(keys))
    return read_batches(stream.sparkSession, path, stream.schema)


def first_per_key(stream: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``horizon`` of event time; state older than that is forgotten."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)
