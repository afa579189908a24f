"""State of runs, folded from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_SECONDS = 450  # fixed value
# Fixed value: what a stale run reports.
STALE_ERROR = "Analysis interrupted (server restart or stalled). Please retry."


def latest_runs(runs: DataFrame, key: str = "repo_id", order: list[str] | None = None) -> DataFrame:
    """Latest run of each repository: partial maxima, no window."""
    rest = [c for c in runs.columns if c != key]
    place = F.struct(*(order or ["started_at", "run_id"]))
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(key, "_r.*")


def detect_stale(heartbeats: DataFrame, runs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Runs with their stored state, or failed when a running one has been silent for too long.

    ``heartbeats(run_id, ts)``, ``runs(run_id, status, finished_at, error)``. A run without heartbeat is left alone.
    """
    last = heartbeats.groupBy("run_id").agg(F.max("ts").alias("last_heartbeat_at"))
    joined = runs.join(last, "run_id", "left")
    limit = now - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    stale = F.coalesce((F.col("status") == "running") & (F.col("last_heartbeat_at") < limit), F.lit(False))
    return joined.select(
        "run_id",
        F.when(stale, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(stale, F.col("last_heartbeat_at")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(stale, F.lit(STALE_ERROR)).otherwise(F.col("error")).alias("error"),
        F.when(~stale, F.col("last_heartbeat_at")).alias("last_heartbeat_at"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """Current state of each run from ``(run_id, ts, event_id, status, message)``; null fields change nothing.

    The first terminal status wins over anything later, and completion drops the message. All of it is plain
    aggregates, so it gives the same result for any order of arrival, in batch and as a stream.
    """
    place = F.struct("ts", "event_id")
    terminal = F.col("status").isin("completed", "failed")
    folded = events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        F.min_by("status", F.when(terminal, place)).alias("_ended"),
        F.min(F.when(terminal, F.col("ts"))).alias("finished_at"),
        F.max_by("status", F.when(F.col("status").isNotNull(), place)).alias("_latest"),
        F.max_by("message", F.when(F.col("message").isNotNull(), place)).alias("_message"),
    )
    status = F.coalesce("_ended", "_latest", F.lit("pending"))
    return folded.select(
        "run_id", status.alias("status"), "started_at", "finished_at",
        F.when(status != "completed", F.col("_message")).alias("message"),
    )


def throttle(events: DataFrame, key: str, width: str = "1 second") -> DataFrame:
    """At most one progress update per run and interval, with the running count of events."""
    per = events.groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n"), F.max("ts").alias("flushed_at"))
    return per.select(key, F.col("window.start").alias("bucket"), "n", "flushed_at")


def purge(runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Runs to keep: completed ones created more than ``days`` days before ``now`` go."""
    old = (F.col("status") == "completed") & (F.col("created_at") < now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return runs.filter(~F.coalesce(old, F.lit(False)))
