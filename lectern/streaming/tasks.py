"""Tasks, batches and sessions followed as streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.tasks import DONE, FAILED, is_running, rolled_state

#: Seconds after its first event at which a task that has not ended is given up.
DEADLINE = 600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: pd.Timestamp | datetime) -> int:
    return pd.Timestamp(ts).value // 1000


def millis(ts: pd.Timestamp | datetime) -> int:
    return micros(ts) // 1000


class TaskTracker(StatefulProcessor):
    """Follows each task until it is done or failed, or its deadline after its least event time passes.

    With `settle` nothing is said before the watermark has passed the moment that
    decides, when no earlier event can come: any order of arrival gives one
    outcome. Else an end is told as it arrives. What has ended is remembered for
    `remember` seconds of event time, in which further events of it count for
    nothing; then its state is gone.
    """

    def __init__(self, deadline: int = DEADLINE, remember: int = DEADLINE, settle: bool = False):
        self.deadline, self.remember, self.settle = deadline * 1000, remember * 1000, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # times in microseconds; timer in milliseconds; end is null as long as there is no last state
        self.last = handle.getValueState("last", "first_us long, end string, end_us long, timer long, ended boolean")

    def due(self, first: int) -> int:
        """The deadline in microseconds, of the whole milliseconds that timers know."""
        return (first // 1000 + self.deadline) * 1000

    def wake(self, before: int | None, at: int) -> int:
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.last.get() if self.last.exists() else None
        if now is not None and now[4]:
            for _ in rows:
                pass
            return
        first, end, timer = (now[0], (now[2], now[1]) if now[1] is not None else None, now[3]) if now is not None else (None, None, None)
        for part in rows:
            at = part["ts"].map(micros)
            first = int(at.min()) if first is None else min(first, int(at.min()))
            for us, state in zip(at, part["state"], strict=True):
                if state in (DONE, FAILED) and (end is None or (us, state) < end):
                    end = (int(us), state)
        within = end is not None and end[0] <= self.due(first)
        if within and not self.settle:
            yield self.told(key, end[1], end[0], timer, first)
            return
        timer = self.wake(timer, (end[0] if within else self.due(first)) // 1000)
        self.last.update((first, end[1] if end else None, end[0] if end else None, timer, False))

    def told(self, key, outcome: str, us: int, timer: int | None, first: int) -> pd.DataFrame:
        timer = self.wake(timer, us // 1000 + max(1, self.remember))
        self.last.update((first, outcome, us, timer, True))
        return pd.DataFrame({"task_id": [key[0]], "outcome": [outcome], "ts": [pd.Timestamp(us, unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.last.get() if self.last.exists() else None
        if now is None:
            return
        if now[4]:
            self.last.clear()
            return
        first, end, us, _, _ = now
        within = end is not None and us <= self.due(first)
        yield self.told(key, end if within else "timeout", us if within else self.due(first), None, first)

    def close(self) -> None:
        pass


def use_rocksdb(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def track_tasks(events: DataFrame, deadline: int = DEADLINE, late: str = "1 hour", remember: int | None = None, settle: bool = False) -> DataFrame:
    """(task_id, outcome, ts) once for each task of a stream (task_id, state, ts): done, failed or timeout. See TaskTracker; `remember` is the deadline unless given."""
    timed = use_rocksdb(events).withWatermark("ts", late)
    kind = dict(events.dtypes)["task_id"]
    tracker = TaskTracker(deadline, deadline if remember is None else remember, settle)
    return timed.groupBy("task_id").transformWithStateInPandas(tracker, f"task_id {kind}, outcome string, ts timestamp", "Append", "EventTime")


class TaskChange(StatefulProcessor):
    """Tells, for a task whose last state changes, the new one and the one before."""

    def __init__(self, batch_kind: str, ttl: int | None):
        self.batch_kind, self.ttl = batch_kind, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"us long, state string, batch_id {self.batch_kind}", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        order = lambda e: (e[0], e[1] is not None, e[1] or "", e[2] is not None, e[2] if e[2] is not None else 0)
        best = None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for e in zip(part["ts"].map(micros), part["state"], part["batch_id"], strict=True):
                if best is None or order(e) > order(best):
                    best = e
        if best is None or before is not None and order(best) <= order(tuple(before)):
            return
        self.last.update(best)
        old = tuple(before) if before is not None else (None, None, None)
        yield pd.DataFrame({"task_id": [key[0]], "batch_id": [best[2]], "state": [best[1]], "ts": [pd.Timestamp(best[0], unit="us")], "old_batch_id": [old[2]], "old_state": [old[1]], "is_new": [before is None]})

    def close(self) -> None:
        pass


MARKER = "version long, snapshot long"
COUNTS = ("total", "done", "bad", "going")


def marker(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The last version that is there as a whole, and the snapshot that it goes on from (-1: none); None before the first."""
    try:
        found = spark.read.schema(MARKER).parquet(f"{path}/markers").agg(F.max(F.struct("version", "snapshot")).alias("m")).first()["m"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return (found["version"], found["snapshot"]) if found else None


def set_marker(spark: SparkSession, path: str, version: int, snapshot: int) -> None:
    """Say that a version is there: the last thing that is written of it."""
    spark.createDataFrame([(version, snapshot)], MARKER).coalesce(1).write.mode("overwrite").parquet(f"{path}/markers/of={version}-{snapshot}")


def kept_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All rows of a kept table that count for its last whole version: its snapshot's and those of the changes since; with `version`."""
    version, snapshot = marker(spark, path)
    changes = spark.read.parquet(f"{path}/{name}/changes").where((F.col("version") > snapshot) & (F.col("version") <= version))
    if snapshot < 0:
        return changes
    base = spark.read.parquet(f"{path}/{name}/snapshots/version={snapshot}").withColumn("version", F.lit(snapshot))
    return base.unionByName(changes.select(*base.columns))


def current_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, batch_id, state, ts): the last state of each task that track_batches() keeps at path, as of its last whole micro-batch."""
    last = kept_rows(spark, path, "tasks").groupBy("task_id").agg(F.max_by(F.struct("batch_id", "state", "ts"), "version").alias("e"))
    return last.select("task_id", "e.*")


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    return kept_rows(spark, path, "batches").groupBy("batch_id").agg(*(F.sum(n).alias(n) for n in COUNTS))


def current_batches(spark: SparkSession, path: str, batches: DataFrame) -> DataFrame:
    """(batch_id, state, done, total) of batches as of the last whole micro-batch; one without tasks is unknown."""
    counts = batches.join(batch_counts(spark, path), "batch_id", "left").select("batch_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in COUNTS))
    return counts.select("batch_id", rolled_state(*map(F.col, COUNTS)).alias("state"), "done", "total")


def compact_kept(spark: SparkSession, path: str) -> None:
    """Write the tables kept at path anew as of their last version, so that readers need no change before it."""
    version, _ = marker(spark, path)
    current_tasks(spark, path).write.mode("overwrite").parquet(f"{path}/tasks/snapshots/version={version}")
    batch_counts(spark, path).write.mode("overwrite").parquet(f"{path}/batches/snapshots/version={version}")
    set_marker(spark, path, version, version)


def track_batches(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact: int | None = None, ttl: int | None = None) -> StreamingQuery:
    """Keep the last state of each task, and the counts of each batch, of a stream (task_id, batch_id, state, ts) at path; see current_tasks, current_batches.

    The state is a row for each task. A micro-batch yields the tasks whose state
    changed, with the one before: what it adds to its batches' counts and takes
    from them is summed over its changes, so that it costs what has changed, and a
    batch of any size has no key of its own. Changes lie in a folder for each
    micro-batch: one that is repeated replaces itself. A version counts once its
    marker is written, which is the last thing done, and no file of a version is ever
    removed: readers find whole versions. Every `compact` micro-batches the tables
    are written anew (compact_kept), as a reader adds up all changes since. With `ttl` (milliseconds) the
    state of tasks without events for so long is dropped; an event after that counts them
    again.
    """
    kinds = dict(events.dtypes)
    schema = f"task_id {kinds['task_id']}, batch_id {kinds['batch_id']}, state string, ts timestamp, old_batch_id {kinds['batch_id']}, old_state string, is_new boolean"

    def merge(changed: DataFrame, number: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{path}/tasks/changes/version={number}")
        rows = spark.read.schema(changed.schema).parquet(f"{path}/tasks/changes/version={number}")
        sides = F.array(F.struct(F.col("batch_id"), F.col("state"), F.lit(1).alias("n")), F.struct(F.col("old_batch_id").alias("batch_id"), F.col("old_state").alias("state"), F.when(~F.col("is_new"), -1).alias("n")))
        moved = rows.select(F.explode(sides).alias("s")).select("s.*").where("n IS NOT NULL")
        state = F.col("state")
        tests = {"total": F.lit(True), "done": state == DONE, "bad": state == FAILED, "going": is_running(state)}
        sums = moved.groupBy("batch_id").agg(*(F.sum(F.when(tests[n], F.col("n")).otherwise(0)).alias(n) for n in COUNTS))
        sums.write.mode("overwrite").parquet(f"{path}/batches/changes/version={number}")
        before = marker(spark, path)
        set_marker(spark, path, number, before[1] if before else -1)
        if compact and (number + 1) % compact == 0:
            compact_kept(spark, path)

    told = use_rocksdb(events.select("task_id", "batch_id", "state", "ts")).groupBy("task_id").transformWithStateInPandas(TaskChange(kinds["batch_id"], ttl), schema, "Update", "ProcessingTime" if ttl else "None")
    return told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(merge).start()


class SessionClock(StatefulProcessor):
    """Says when a session has been idle for its time to live."""

    def __init__(self, hours: int):
        self.ttl = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(millis(r["ts"].max()) for r in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.ttl)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"session_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def expire_sessions(uploads: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(session_id, last_ts) of the sessions of a stream (session_id, ts) as event time passes their time to live."""
    kind = dict(uploads.dtypes)["session_id"]
    return use_rocksdb(uploads).withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(SessionClock(hours), f"session_id {kind}, last_ts timestamp", "Append", "EventTime")
