"""Streams that are stopped, fail and come back; keyed state with timers and expiry."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docquarry.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.csv").write_text(f"a,b\n{k},x\n")
        time.sleep(0.01)
    return lambda: jobs.read_csv_stream(spark, f"{tmp_path}/in", "a int, b string")


SCHEMA = "a int, b string, source string"


def rows(spark, path):
    return sorted(r["a"] for r in jobs.read_batches(spark, path, SCHEMA).collect())


@pytest.mark.parametrize("compensate", [True, False])
def test_cancel_and_resume(spark, tmp_path, source, compensate):
    out, checkpoint, asked = f"{tmp_path}/out", f"{tmp_path}/c", []
    with pytest.raises(jobs.Cancelled):
        jobs.run_batches(source(), out, checkpoint, lambda: asked.append(1) or len(asked) > 2, compensate=compensate)
    assert rows(spark, out) == ([] if compensate else [0, 1])
    assert jobs.run_batches(source(), out, checkpoint, lambda: False) == (4 if compensate else 2)
    assert rows(spark, out) == [0, 1, 2, 3]
    assert jobs.run_batches(source(), out, checkpoint, lambda: False) == 0 and rows(spark, out) == [0, 1, 2, 3]


def test_crash_between_data_and_commit(spark, tmp_path, source):
    out, checkpoint, tried = f"{tmp_path}/out", f"{tmp_path}/c", []

    def dies(batch, to):
        batch.write.mode("overwrite").parquet(to)
        tried.append(to)
        if len(tried) == 2:
            raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        jobs.run_batches(source(), out, checkpoint, lambda: False, emit=dies)
    assert rows(spark, out) == [0]
    jobs.run_batches(source(), out, checkpoint, lambda: False)
    assert rows(spark, out) == [0, 1, 2, 3]


def test_a_failure_is_no_cancellation(spark, tmp_path, source):
    def dies(batch, to):
        raise RuntimeError("crash")

    states = iter([False, True, True])
    with pytest.raises(Exception, match="crash"):
        jobs.run_batches(source(), f"{tmp_path}/out", f"{tmp_path}/c", lambda: next(states), emit=dies)


def test_crash_while_work_is_undone(spark, tmp_path, source, monkeypatch):
    out, checkpoint, undo = f"{tmp_path}/out", f"{tmp_path}/c", jobs._undo
    monkeypatch.setattr(jobs, "_undo", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    asked = []
    with pytest.raises(RuntimeError):
        jobs.run_batches(source(), out, checkpoint, lambda: asked.append(1) or len(asked) > 2)
    monkeypatch.setattr(jobs, "_undo", undo)
    assert jobs.run_batches(source(), out, checkpoint, lambda: False) == 4 and rows(spark, out) == [0, 1, 2, 3]


def test_retries_with_back_off(spark, tmp_path, source):
    waits, tries = [], []

    def flaky(batch, to):
        tries.append(to)
        if len(tries) in (1, 2):
            raise TimeoutError
        batch.write.mode("overwrite").parquet(to)

    jobs.run_batches(source(), f"{tmp_path}/out", f"{tmp_path}/c", lambda: False, retry_on=(TimeoutError,), sleep=waits.append, emit=flaky)
    assert waits == [1.0, 2.0] and rows(spark, f"{tmp_path}/out") == [0, 1, 2, 3]
    with pytest.raises(Exception, match="TimeoutError"):
        jobs.run_batches(source(), f"{tmp_path}/out2", f"{tmp_path}/c2", lambda: False, retry_on=(TimeoutError,), retries=1, sleep=waits.append, emit=lambda *a: (_ for _ in ()).throw(TimeoutError()))


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(frame, tmp_path, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


EVENT = "job_id long, event_id long, ts timestamp, status string, stage string, ratio double, start boolean"


def test_silent_jobs_are_reported_and_forgotten(rocks, tmp_path):
    spark = rocks
    batches = [
        [(1, 1, 0, "running", "parsing", 0.5, False), (2, 2, 5, "succeeded", "done", 1.0, False), (3, 3, 100, "running", "chunking", 0.0, False)],
        [(3, 4, 150, "running", "embedding", 0.5, False), (1, 5, 170, "running", "parsing", 0.0, False)],
        [(4, 6, 900, "queued", "queued", 0.0, False)], [(4, 7, 901, "running", "parsing", 1.0, False)],
    ]
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(j, e, t, *rest) for j, e, t, *rest in batch], EVENT.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1000))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        time.sleep(0.02)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    found = run(jobs.watch_jobs(events, 60), tmp_path, "watched").select("job_id", "kind", "progress", "n_events", (F.unix_timestamp("at") - 1000).alias("at")).collect()
    stalled = sorted(tuple(r) for r in found if r["kind"] == "stalled")
    assert stalled == [(1, "stalled", 0, 1, 230), (1, "stalled", 30, 1, 60), (3, "stalled", 80, 2, 210)]
    assert {(r["job_id"], r["n_events"]) for r in found if r["kind"] == "state"} == {(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)}


def test_codes_expire_and_work_once(rocks, tmp_path):
    spark = rocks
    schema = "email string, event_id long, ts long, code string, issue boolean"
    batches = [
        [("a", 1, 1, "11", True), ("b", 2, 2, "22", True), ("a", 3, 3, "33", True), ("d", 10, 4, "44", True)],
        [("a", 4, 60, "11", False), ("a", 5, 61, "33", False), ("a", 6, 62, "33", False), ("c", 7, 63, "22", False), ("d", 11, 903, "44", False)],
        [("b", 8, 902, "22", False), ("e", 12, 2000, "55", True)], [("e", 13, 2001, "55", False)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/codes")
        time.sleep(0.02)
    stream = spark.readStream.schema(schema.replace("ts long", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/codes")
    found = {r["event_id"]: r["accepted"] for r in run(jobs.check_codes(stream, 15, "100 seconds"), tmp_path, "checked").collect()}
    assert found == {4: False, 5: True, 6: False, 7: False, 8: False, 11: True, 13: True}


def test_a_job_costs_a_call_for_each_change_and_no_frames():
    calls, held = [], {}
    note = lambda name: lambda *args: calls.append((name, *args))
    state = SimpleNamespace(get=lambda: held.get("state"), update=lambda v: held.update(state=v), clear=held.clear)
    watch = jobs.JobWatch(60)
    watch.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=note("set"), deleteTimer=note("unset")))
    event = lambda at, n: Row(event_id=n, micros=at * 1_000_000, status="running", stage="parsing", ratio=None, start=None)
    rows = list(watch.handleInputRows((7,), iter([event(200, 3), event(0, 1), event(100, 2)]), None))
    assert [(r["kind"], r["n_events"], r["at"]) for r in rows] == [("stalled", 1, 60_000), ("stalled", 1, 160_000), ("state", 1, 200_000)]
    assert all(isinstance(r, Row) for r in rows) and calls == [("set", 260_000)]
    list(watch.handleInputRows((7,), iter([event(200, 4)]), None))
    assert calls == [("set", 260_000)]  # the timer stays where it is
    list(watch.handleInputRows((7,), iter([event(210, 5)]), None))
    assert calls[1:] == [("unset", 260_000), ("set", 270_000)] and held["state"][3:] == (3, 210_000)
