"""Keyed state of streams: the life of jobs with overdue timers, and the pacing of requests.

Both are state machines on Spark's state store, one small state for each key whatever
its history. Rows of a key are taken in the order of (at, seq) inside a batch; a stream
whose batches follow one another in time, with a watermark, therefore gives what one
pass over all rows gives. Every emission is numbered inside its key, so that the sink can
repeat a batch and readers find the latest state (`latest`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarry.sources.sinks import exists

#: States that wait for something to happen; a key that stays in one for too long has failed.
WAITING = ("PENDING", "RUNNING")
INTERRUPTED = "interrupted"
WINDOW, EASE_EVERY, EASE, BACK_OFF = 50, 25, 0.92, 2.5
JOBS = "key string, version long, status string, progress string, error string, attempts long, overdue long, events long, at long"
PACING = "key string, version long, requests long, challenges long, delay double, streak long, recent string"


def _row(fields: str, key: tuple, state) -> Row:
    return Row(**dict(zip((f.split()[0] for f in fields.split(", ")), (*key, *state))))


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["at"], r["seq"]))


class JobLife(StatefulProcessor):
    """Events (key, at in microseconds, seq, status, progress, error) set a job's status; null fields leave what is known.

    A job that stays PENDING or RUNNING for more than ``patience`` microseconds fails as
    interrupted: by a timer when the watermark passes, or at its next event if that
    comes first. A later event revives it. attempts counts how often it began to run.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOBS.split(", ", 1)[1])

    def _emit(self, key: tuple, state: list) -> Row:
        state[0] += 1
        self.state.update(tuple(state))
        return _row(JOBS, key, state)

    def _overdue(self, state: list) -> None:
        state[1], state[3], state[5] = "FAILED", INTERRUPTED, state[5] + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = list(self.state.get() or (0, None, None, None, 0, 0, 0, 0))
        for r in _in_order(rows):
            if state[1] in WAITING and r["at"] - state[7] > self.patience:
                self._overdue(state)
            if r["status"] is not None:
                state[4] += r["status"] == "RUNNING" and state[1] != "RUNNING"
                state[1] = r["status"]
                state[3] = r["error"] if r["status"] == "FAILED" else None
            if r["progress"] is not None:
                state[2] = r["progress"]
            state[6], state[7] = state[6] + 1, r["at"]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[1] in WAITING:
            self.handle.registerTimer((state[7] + self.patience) // 1000 + 1)
        yield self._emit(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = list(self.state.get())
        if state[1] in WAITING:
            self._overdue(state)
            yield self._emit(key, state)

    def close(self) -> None:
        pass


class Pacing(StatefulProcessor):
    """Outcomes (key, at, seq, challenged) of requests: the delay to keep, and the flags of the last WINDOW requests.

    A challenge multiplies the delay, every EASE_EVERY-th clean request in a row eases it,
    both within bounds.
    """

    def __init__(self, start: float = 1.0, least: float = 0.5, most: float = 60.0):
        self.start, self.least, self.most = start, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pacing", PACING.split(", ", 1)[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, requests, challenges, delay, streak, recent = self.state.get() or (0, 0, 0, self.start, 0, "")
        for r in _in_order(rows):
            hit = bool(r["challenged"])
            requests, challenges, streak = requests + 1, challenges + hit, 0 if hit else streak + 1
            recent = (recent + str(int(hit)))[-WINDOW:]
            if hit:
                delay = min(max(delay * BACK_OFF, self.least), self.most)
            elif streak % EASE_EVERY == 0:
                delay = min(max(delay * EASE, self.least), self.most)
        state = (version + 1, requests, challenges, delay, streak, recent)
        self.state.update(state)
        yield _row(PACING, key, state)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: StatefulProcessor, fields: str, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    spark, setting = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that keeps timers
    states = rows.groupBy("key").transformWithState(processor, fields, "Update", mode)

    def batch(some: DataFrame, number: int) -> None:
        some.write.mode("overwrite").parquet(f"{path}/batch={number}")

    try:
        return states.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # the started query has taken the setting; other streams keep theirs
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def job_states(events: DataFrame, path: str, checkpoint: str, patience_seconds: int, late: str = "1 hour") -> StreamingQuery:
    """Follow a stream of (key, ts, seq, status, progress, error); states go to the table at path."""
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "status", "progress", "error")
    return _run(rows.withWatermark("ts", late), JobLife(patience_seconds * 1_000_000), JOBS, path, checkpoint, "EventTime")


def paces(outcomes: DataFrame, path: str, checkpoint: str, start: float = 1.0, least: float = 0.5, most: float = 60.0) -> StreamingQuery:
    """Follow a stream of (key, ts, seq, challenged); states go to the table at path."""
    rows = outcomes.select(F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "challenged")
    return _run(rows, Pacing(start, least, most), PACING, path, checkpoint, "None")


def latest(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The last state of each key in a table of states; none before the first batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(fields).parquet(path).drop("batch")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def with_rate(states: DataFrame) -> DataFrame:
    """Pacing states with ``rate``, the share of challenges among the last WINDOW requests."""
    return states.withColumn("rate", F.round(F.regexp_count("recent", F.lit("1")) / F.char_length("recent"), 4))
