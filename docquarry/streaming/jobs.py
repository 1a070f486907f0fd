"""Streams: job progress as a state machine, token streams, windowed counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquarry.shared_files import fresh_name

STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
FINAL = ("succeeded", "failed", "cancelled")
STAGES = {"queued": (0, 0), "parsing": (0, 60), "chunking": (60, 70), "embedding": (70, 90), "indexing": (90, 99), "done": (100, 100)}
JOB = "job_id long, status string, stage string, progress int, n_events long"


def advance(state: tuple, status: str, stage: str, ratio: float, start: bool) -> tuple:
    """(status, stage, progress, n) after an event.

    A job starts anew only by a start event; else progress never falls, stages never go back and
    nothing follows a final status.  Events with an unknown status or stage change nothing.
    """
    old_status, old_stage, progress, n = state
    if start:
        return "running", "queued", 0, n + 1
    if status not in STATUSES or stage not in STAGES or old_status in FINAL:
        return old_status, old_stage, progress, n + 1
    order = list(STAGES)
    low, high = STAGES[stage]
    at = low + int((high - low) * min(max(ratio or 0.0, 0.0), 1.0))
    return status, max(old_stage, stage, key=order.index), 100 if status == "succeeded" else max(progress, at), n + 1


def job_states(events: DataFrame) -> DataFrame:
    """A stream of events (job_id, event_id, status, stage, ratio, start) as a stream of job states."""
    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("queued", "queued", 0, 0)
        for frame in frames:
            for e in frame.sort_values("event_id").itertuples():
                state = advance(tuple(state), e.status, e.stage, e.ratio, bool(e.start))
        held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["job_id", "status", "stage", "progress", "n_events"])

    return events.groupBy("job_id").applyInPandasWithState(fold, JOB, "status string, stage string, progress int, n long", "update", GroupStateTimeout.NoTimeout)


def sse(event: Column) -> Column:
    """A server-sent event line of a struct."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def parse_sse(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Events of well-formed ``data:`` lines; others are left out (``until_final`` ends each message's events)."""
    body = F.regexp_extract(column, r"^data:\s*(\{.*\})\s*$", 1)
    return lines.withColumn("event", F.from_json(F.nullif(body, F.lit("")), schema, {"mode": "PERMISSIVE"})).filter("event.type IS NOT NULL")


def token_events(messages: DataFrame, text: str = "text") -> DataFrame:
    """position, type, payload per message: a status, one event per token, a final one with the text."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+\s*"), F.lit(0))
    make = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("payload"))
    events = F.concat(F.array(make("status", F.lit("generating"))), F.transform(tokens, lambda t: make("token", t)), F.array(make("final", F.coalesce(text, F.lit("")))))
    return messages.select(*[c for c in messages.columns if c != text], F.posexplode(events).alias("position", "event")).select("*", "event.type", "event.payload").drop("event")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts per window and key behind a watermark (an addition for event streams)."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def unexpired(rows: DataFrame, minutes: int = 15, created: str = "created_at", now: Column | None = None) -> DataFrame:
    return rows.filter(F.col(created) + F.expr(f"INTERVAL {minutes} MINUTES") > (now if now is not None else F.current_timestamp()))


def until_final(events: DataFrame, message: str, position: str, kind: str = "type") -> DataFrame:
    """Events up to the first ``final`` one of each message, that one included."""
    before = Window.partitionBy(message).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    over = fresh_name("over", events)
    return events.withColumn(over, F.coalesce(F.max((F.col(kind) == "final").cast("int")).over(before), F.lit(0))).filter(F.col(over) == 0).drop(over)


def read_csv_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """CSV files of a folder as a stream of rows, ``files`` a step, with the file each row comes from."""
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(folder)
    return rows.withColumn("source", F.col("_metadata.file_name"))


WATCHED = "job_id long, kind string, status string, stage string, progress int, n_events long, at timestamp"


class JobWatch(StatefulProcessor):
    """One job: its state after each batch of events, and a ``stalled`` row for each time it is silent for too long.

    The state lives as long as the job does: a timer in event time follows the last event; when it fires, a job
    that has not ended is reported, and either way its state goes.  An event that comes later begins anew.
    Rows come and go as they are, times as numbers: a frame for each job or report costs many times what a row does.
    """

    def __init__(self, silent_seconds: int) -> None:
        self.silent = silent_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, stage string, progress int, n long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = ("queued", "queued", 0, 0)
        held = self.state.get()
        *state, last = held or (*fresh, None)
        timer = None if last is None else last + self.silent  # the one that is set, as it follows the last event
        for e in sorted(rows, key=lambda e: (e["micros"], e["event_id"] is None, e["event_id"])):
            at = e["micros"] // 1000
            if last is not None and at - last >= self.silent:  # the timer has not fired yet, as both events are of one batch
                if state[0] not in FINAL:
                    yield self._row(key, "stalled", state, last + self.silent)
                state, last = fresh, at
            state, last = advance(tuple(state), e["status"], e["stage"], e["ratio"], bool(e["start"])), at if last is None else max(last, at)
        self.state.update((*state, last))
        if timer != last + self.silent:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.silent)
        yield self._row(key, "state", state, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        if held is None:
            return
        *state, _ = held
        self.state.clear()
        if state[0] not in FINAL:
            yield self._row(key, "stalled", state, expiredTimerInfo.getExpiryTimeInMs())

    def _row(self, key, kind: str, state, at: int) -> Row:
        status, stage, progress, n = state
        return Row(job_id=key[0], kind=kind, status=status, stage=stage, progress=progress, n_events=n, at=at)

    def close(self) -> None:
        pass


def watch_jobs(events: DataFrame, silent_seconds: int, late: str = "0 seconds") -> DataFrame:
    """A stream of events (job_id, event_id, ts, status, stage, ratio, start) as a stream of WATCHED rows.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  ``silent_seconds`` stays the
    same as long as a checkpoint is used.
    """
    used = events.select("job_id", "event_id", "ts", "status", "stage", "ratio", "start", F.unix_micros("ts").alias("micros"))
    keyed = used.withWatermark("ts", late).groupBy("job_id")
    watched = keyed.transformWithState(JobWatch(silent_seconds), outputStructType=WATCHED.replace("at timestamp", "at long"), outputMode="Update", timeMode="EventTime")
    return watched.withColumn("at", F.timestamp_millis("at"))


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, which keyed state with timers needs."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class CodeCheck(StatefulProcessor):
    """Reset codes of one address: only the latest counts, it works once, and it is forgotten ``minutes`` after it was issued."""

    def __init__(self, minutes: int) -> None:
        self.life = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("code", "code string, issued long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, held = [], tuple(self.state.get()) if self.state.exists() else None
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = int(r.ts.timestamp() * 1000)
            if r.issue:
                held = (r.code, at)
                continue
            good = held is not None and held[0] == r.code and at - held[1] < self.life
            held = None if good else held
            out.append((key[0], r.event_id, good))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)
            self.handle.registerTimer(held[1] + self.life)
        yield pd.DataFrame(out, columns=["email", "event_id", "accepted"]).astype({"event_id": "int64", "accepted": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def check_codes(events: DataFrame, minutes: int = 15, late: str = "0 seconds") -> DataFrame:
    """A stream of (email, event_id, ts, code, issue) as a stream of attempts (email, event_id, accepted)."""
    keyed = events.withWatermark("ts", late).groupBy("email")
    return keyed.transformWithStateInPandas(CodeCheck(minutes), outputStructType="email string, event_id long, accepted boolean", outputMode="Update", timeMode="EventTime")


class Cancelled(Exception):
    pass


def run_batches(
    stream: DataFrame, path: str, checkpoint: str, cancelled: Callable[[], bool], *, compensate: bool = True,
    retry_on: tuple[type[Exception], ...] = (), retries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep,
    emit: Callable[[DataFrame, str], None] | None = None,
) -> int:
    """Write a stream's batches below ``path`` until all is read or ``cancelled`` says so; the number of batches written.

    A batch is data and a commit record beside it.  Spark delivers a batch again if it did not finish: without its
    record it is written anew, with it it is left alone.  So after a crash at any place, or a cancel, another
    call goes on where this one stopped, and ``read_batches`` gives each row once.  A cancelled run stops before the
    next batch, undoes the whole work (output and checkpoint, so that another call begins anew) and raises
    ``Cancelled``; without ``compensate`` it keeps what is committed.  Errors of the kinds ``retry_on`` are tried
    again after ``wait`` seconds, doubled each time; others end the run.  ``emit`` writes a batch to a folder.
    """
    spark, done, stopped = stream.sparkSession, [], []
    emit = emit or (lambda batch, to: batch.write.mode("overwrite").parquet(to))
    fs, at = _files(spark, path)
    if fs.exists(at("_undo")):  # a crash while work was undone
        _undo(spark, path, checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        if fs.exists(at(f"_commits/{n}")):
            return
        if cancelled():
            stopped.append(n)
            raise Cancelled
        for attempt in range(retries + 1):
            try:
                emit(batch, f"{path}/batch={n}")
                break
            except retry_on:
                if attempt == retries:
                    raise
                sleep(wait * 2**attempt)
        fs.create(at(f"_commits/{n}"), True).close()
        done.append(n)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
        if compensate:
            fs.create(at("_undo"), True).close()
            _undo(spark, path, checkpoint)
        raise Cancelled from None
    return len(done)


def _undo(spark: SparkSession, path: str, checkpoint: str) -> None:
    for folder in (checkpoint, path):  # the note that this goes on is in the last one
        files, inside = _files(spark, folder)
        files.delete(inside(), True)


def _files(spark: SparkSession, path: str):
    """(file system, function from a name below the path to Hadoop's path)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name="": make(f"{path}/{name}" if name else path)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the committed batches below ``path``."""
    fs, at = _files(spark, path)
    records = fs.listStatus(at("_commits")) if fs.exists(at("_commits")) else []
    committed = [f"{path}/batch={r.getPath().getName()}" for r in records]
    return spark.read.schema(schema).parquet(*committed) if committed else spark.createDataFrame([], schema)
