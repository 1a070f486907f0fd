"""Tables by document and version: changes touch their partitions only and survive crashes."""

import os

import pytest
from pyspark.sql import functions as F

from docquarry.operators import versioned

COLUMNS = "document_id string, pipeline_version string, chunk_id int, text string"


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(f"d{d}", v, c, f"{d}{v}{c}") for d in range(40) for v in ("v1", "v/2") for c in range(2)] + [(None, "v1", 0, "no document"), ("d0", None, 0, "no version")]
    path = f"{tmp_path}/chunks"
    versioned.create(spark.createDataFrame(rows, COLUMNS), path, n_buckets=8)
    return path, {tuple(r) for r in rows}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(spark, path):
    rows = [tuple(r) for r in versioned.read(spark, path).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_replacement_leaves_other_files_alone(spark, table):
    path, rows = table
    before = files(path)
    new = [("d3", "v/2", 0, "new"), ("d3", "v/2", 5, "more"), ("d77", "v1", 0, "first")]
    touched = versioned.replace_versions(spark, path, spark.createDataFrame(new, COLUMNS))
    assert len(touched) == 2 and {v for _, v in touched} == {"v/2", "v1"}
    assert state(spark, path) == {r for r in rows if r[:2] != ("d3", "v/2")} | set(new)
    folders = {os.path.dirname(f) for f in before ^ files(path)}
    assert len(folders) == 2 and len(before & files(path)) == len(before) - len({f for f in before if os.path.dirname(f) in folders})


def test_only_touched_partitions_are_read(spark, table):
    path, _ = table
    plan = versioned.of_documents(spark, path, ["d3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r["document_id"] for r in versioned.of_documents(spark, path, ["d3", "nobody"]).collect()} == {"d3"}


def test_deletion_empties_partitions_and_is_idempotent(spark, table):
    path, rows = table
    gone = spark.createDataFrame([(f"d{d}", "v/2") for d in range(40)] + [("nobody", "v9")], "document_id string, pipeline_version string")
    for _ in range(2):
        versioned.delete_versions(spark, path, gone)
        assert state(spark, path) == {r for r in rows if r[1] != "v/2"}
    assert not any("pipeline_version=v%2F2" in f for f in files(path))
    assert versioned.delete_versions(spark, path, gone.limit(0)) == []


def test_upsert_by_chunk(spark, table):
    path, rows = table
    new = [("d1", "v1", 1, "other"), ("d1", "v1", 2, "added")]
    versioned.upsert(spark, path, spark.createDataFrame(new, COLUMNS), ["document_id", "pipeline_version", "chunk_id"])
    assert state(spark, path) == {r for r in rows if r[:3] != ("d1", "v1", 1)} | set(new)
    with pytest.raises(ValueError, match="pipeline_version"):
        versioned.upsert(spark, path, spark.createDataFrame(new, COLUMNS), ["document_id", "chunk_id"])


@pytest.mark.parametrize("crash", ["before", "after", "between"])
def test_a_crash_loses_nothing(spark, table, monkeypatch, crash):
    """The change has happened from the moment on that its new partitions are complete."""
    path, rows = table
    new = spark.createDataFrame([("d3", "v1", 0, "new")], COLUMNS)
    done = versioned.recover
    calls = []

    def broken(s, p):
        calls.append(1)
        if len(calls) == 1:
            return done(s, p)
        if crash == "before":
            os.remove(f"{p}.next/_SUCCESS")
        if crash == "between":  # the partitions are overwritten, but not cleared up
            fs = s.read.schema(versioned._stored(s, p).schema).parquet(f"{p}.next")
            fs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*versioned.PARTITION).parquet(p)
        raise RuntimeError("crash")

    monkeypatch.setattr(versioned, "recover", broken)
    with pytest.raises(RuntimeError):
        versioned.replace_versions(spark, path, new)
    monkeypatch.setattr(versioned, "recover", done)
    want = rows if crash == "before" else {r for r in rows if r[:2] != ("d3", "v1")} | {("d3", "v1", 0, "new")}
    assert state(spark, path) == want and not os.path.exists(f"{path}.next")


def test_a_table_needs_its_keys(spark, tmp_path):
    with pytest.raises(ValueError, match="document_id"):
        versioned.create(spark.range(2).withColumn("pipeline_version", F.lit("v1")), f"{tmp_path}/t")
