"""Stateful processors of run tracking: what a run needs to be remembered for, and timers that forget it.

Event-time timers fire as the watermark passes them, whichever run moved it on. They stand for a time to live, which Spark
offers on the processing clock only, where a run over available input would never end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.runs import STALE_SECONDS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A fold of run events that can be merged with another fold of the same run. Times are microseconds, whatever the time zone.
PARTIAL = (
    "started_at long, ended_at long, ended_id long, ended string, latest_at long, latest_id long, latest string, "
    "message_at long, message_id long, message string"
)
TERMINAL = ("completed", "failed")
STRETCH = "first_heartbeat_at long, finished_at long, heartbeats long"
#: What is open of a run: when its timer fires, in milliseconds, and the columns of its stretches.
OPEN = "timer long, " + STRETCH.replace(" long", " array<long>")


def with_state_store(spark: SparkSession) -> None:
    """Processors with timers need the store on disk; keys that are not in use take no executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _row_maker(key: str, columns: str):
    """Rows with the names of a schema."""
    return Row(key, *(c.split()[0] for c in columns.split(", ")))


def _earlier(old: tuple, new: tuple) -> tuple:
    return new if old[0] is None or new[:2] < old[:2] else old


def _later(old: tuple, new: tuple) -> tuple:
    return new if old[0] is None or new[:2] > old[:2] else old


def _replace_timer(handle, at: int) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
    handle.registerTimer(at)


class RunFold(StatefulProcessor):
    """The fold of a run's events; the state goes when the run has been silent for a grace time.

    Folds are merged when they are read, so an event after the grace time costs no more than another row.
    """

    def __init__(self, grace_seconds: int):
        self.grace, self.row = grace_seconds * 1_000_000, _row_maker("run_id", PARTIAL)

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", f"last long, {PARTIAL}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.fold.get()) if self.fold.exists() else (0, *[None] * 10)
        last, started, ended, latest, message = state[0], state[1], state[2:5], state[5:8], state[8:11]
        for r in rows:
            last = max(last, r.at)
            started = r.at if started is None else min(started, r.at)
            if r.status is not None:
                latest = _later(latest, (r.at, r.event_id, r.status))
                if r.status in TERMINAL:
                    ended = _earlier(ended, (r.at, r.event_id, r.status))
            if r.message is not None:
                message = _later(message, (r.at, r.event_id, r.message))
        partial = (started, *ended, *latest, *message)
        self.fold.update((last, *partial))
        _replace_timer(self.handle, (last + self.grace) // 1000 + 1)
        yield self.row(*key, *partial)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.fold.clear()
        return iter(())

    def close(self) -> None:
        pass


def merged_runs(partials: DataFrame) -> DataFrame:
    """Current state of each run from all its folds: what :func:`runs.fold_runs` gives for all its events."""
    ended, latest, message = (F.struct(f"{n}_at", f"{n}_id") for n in ("ended", "latest", "message"))
    folded = partials.groupBy("run_id").agg(
        F.timestamp_micros(F.min("started_at")).alias("started_at"),
        F.min_by("ended", F.when(F.col("ended").isNotNull(), ended)).alias("_ended"), F.timestamp_micros(F.min("ended_at")).alias("finished_at"),
        F.max_by("latest", F.when(F.col("latest").isNotNull(), latest)).alias("_latest"),
        F.max_by("message", F.when(F.col("message").isNotNull(), message)).alias("_message"),
    )
    status = F.coalesce("_ended", "_latest", F.lit("pending"))
    return folded.select("run_id", status.alias("status"), "started_at", "finished_at", F.when(status != "completed", F.col("_message")).alias("message"))


def join_stretch(stretches: list[tuple], at: int, gap: int) -> None:
    """Add a heartbeat to sorted stretches that are more than ``gap`` apart."""
    if not stretches or at > stretches[-1][1] + gap:
        stretches.append((at, at, 1))
        return
    if at >= stretches[-1][0]:  # times mostly rise, and then only the last stretch changes
        first, last, n = stretches[-1]
        stretches[-1] = (first, max(last, at), n + 1)
        return
    i = bisect_right(stretches, at, key=lambda s: s[0])
    first, last, n = at, at, 1
    if i < len(stretches) and stretches[i][0] - at <= gap:
        last, n = stretches[i][1], n + stretches[i][2]
        del stretches[i]
    if i and at - stretches[i - 1][1] <= gap:
        i -= 1
        first, last, n = stretches[i][0], max(last, stretches[i][1]), n + stretches[i][2]
        del stretches[i]
    stretches.insert(i, (first, last, n))


class Silences(StatefulProcessor):
    """Stretches of heartbeats of a run; a timer per run reports a stretch once nothing can join it any more.

    The state holds the stretches that are open (rows may come out of order, so there can be two), and goes with the last. It
    is one value with a list per column and the time of the timer, since every call and every row of a state variable crosses
    to Spark by itself.
    """

    def __init__(self, seconds: int = STALE_SECONDS):
        self.gap, self.row = seconds * 1_000_000, _row_maker("run_id", STRETCH)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def _state(self) -> tuple[int | None, list[tuple]]:
        state = self.open.get()
        return (None, []) if state is None else (state[0], list(zip(*state[1:], strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, stretches = self._state()
        for r in rows:  # a busy run's rows are never a list, only its stretches are
            join_stretch(stretches, r.at, self.gap)
        return self._report(key, stretches, timerValues, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._report(key, self._state()[1], timerValues, None)

    def _report(self, key, stretches: list[tuple], timers, timer: int | None) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs() * 1000
        over = [s for s in stretches if s[1] + self.gap < now]
        left = stretches[len(over):]
        if left:
            at = (left[0][1] + self.gap) // 1000 + 1
            if at != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
            self.open.update((at, *(list(c) for c in zip(*left, strict=True))))
        else:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.open.clear()
        return iter([self.row(*key, *s) for s in over])

    def close(self) -> None:
        pass


def open_stretches(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The stretches a finished query still holds, from its state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    columns = F.arrays_zip(*(F.col(f"value.{c.split()[0]}") for c in STRETCH.split(", ")))
    return stretch_times(state.select(F.col(f"key.{key}").alias(key), F.inline(columns)))


def stretch_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in ("first_heartbeat_at", "finished_at")})
