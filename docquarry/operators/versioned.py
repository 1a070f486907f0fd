"""Chunks and vectors by document and pipeline version, in partitions that are replaced one by one.

A table is a folder of Parquet in partitions by ``bucket`` (a hash of the document's identifier) and
``pipeline_version``.  A replacement or deletion reads and rewrites only the partitions of the keys that it
names; the files of all others stay as they are.

A change first writes the new state of its partitions beside the table (``path``.next), then overwrites those
partitions (dynamic partition overwrite) and removes those that became empty.  It has happened once
``path``.next is complete: after a crash ``recover`` repeats what is left to do, which every later
change does by itself.  One writer at a time.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["document_id", "pipeline_version"]
PARTITION = ["bucket", "pipeline_version"]


def _files(spark: SparkSession, path: str):
    """(file system, function from a name below the path to Hadoop's path)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name="": make(f"{path}/{name}" if name else path)


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(n_buckets)).cast("int")


def _layout(spark: SparkSession, path: str) -> dict:
    """What ``create`` has noted: the number of buckets and the columns."""
    return json.loads(spark.read.text(f"{path}.layout").first()[0])


def create(rows: DataFrame, path: str, n_buckets: int = 64) -> None:
    """A new table of ``rows`` with document_id, pipeline_version and any other columns.

    Each bucket should hold what one task can rewrite; rows of one document and version lie in one partition.
    """
    if missing := [c for c in KEYS if c not in rows.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    spark = rows.sparkSession
    note = json.dumps({"n_buckets": n_buckets, "columns": rows.columns, "schema": rows.schema.json()})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.layout")
    placed = rows.withColumn("bucket", _bucket(n_buckets))
    placed.repartition(*PARTITION).write.mode("overwrite").partitionBy(*PARTITION).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was given, after finishing what a crash has left; filters on version and ``bucket_of`` prune partitions."""
    recover(spark, path)
    return _stored(spark, path).select(*_layout(spark, path)["columns"])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType.fromJson(json.loads(_layout(spark, path)["schema"]))
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)


def of_documents(spark: SparkSession, path: str, document_ids: list) -> DataFrame:
    """The rows of some documents; only their buckets are read."""
    recover(spark, path)
    layout = _layout(spark, path)
    named = spark.createDataFrame([(d,) for d in document_ids], "document_id string").select(_bucket(layout["n_buckets"]).alias("b")).distinct()
    buckets = [r["b"] for r in named.collect()]
    return _stored(spark, path).filter(F.col("bucket").isin(buckets) & F.col("document_id").isin(document_ids)).select(*layout["columns"])


def _change(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], new: DataFrame | None) -> list[tuple[int, str]]:
    """Rows whose ``keys`` are among those of ``gone`` go, rows of ``new`` come; the partitions that were rewritten."""
    recover(spark, path)
    layout = _layout(spark, path)
    gone = gone.select(*dict.fromkeys([*KEYS, *keys])).distinct()
    touched = gone.select(_bucket(layout["n_buckets"]).alias("bucket"), "pipeline_version").distinct()
    parts = [(r["bucket"], r["pipeline_version"]) for r in touched.collect()]  # buckets times versions at most
    if not parts:
        return []
    by_version: dict[str, list[int]] = {}
    for b, v in parts:
        by_version.setdefault(v, []).append(b)
    here = reduce(or_, [F.col("pipeline_version").eqNullSafe(F.lit(v)) & F.col("bucket").isin(bs) for v, bs in by_version.items()])
    state = _stored(spark, path).filter(here).join(gone.select(*keys), keys, "left_anti").select(*layout["columns"], "bucket")
    if new is not None:
        state = state.unionByName(new.select(*layout["columns"]).withColumn("bucket", _bucket(layout["n_buckets"])))
    spark.createDataFrame(parts, "bucket int, pipeline_version string").coalesce(1).write.mode("overwrite").parquet(f"{path}.touched")
    state.repartition(*PARTITION).write.mode("overwrite").parquet(f"{path}.next")
    recover(spark, path)
    return sorted(parts)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a change whose new partitions are complete, forget one whose are not; whether one was finished."""
    fs, at = _files(spark, f"{path}.next")
    if not fs.exists(at("_SUCCESS")):
        fs.delete(at(), True)
        return False
    state = spark.read.schema(_stored(spark, path).schema).parquet(f"{path}.next")
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    filled = {(r["bucket"], r["pipeline_version"]) for r in state.select(*PARTITION).distinct().collect()}
    table, inside = _files(spark, path)
    for bucket, version in spark.read.parquet(f"{path}.touched").collect():
        if (bucket, version) not in filled:
            table.delete(inside(f"bucket={bucket}/pipeline_version={_escaped(spark, version)}"), True)
    fs.delete(at(), True)
    return True


def _escaped(spark: SparkSession, version: str | None) -> str:
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return names.escapePathName(version) if version else names.DEFAULT_PARTITION_NAME()


def replace_versions(spark: SparkSession, path: str, new: DataFrame) -> list[tuple[int, str]]:
    """All rows of the (document, version) pairs of ``new`` are replaced by its own; the rewritten partitions."""
    return _change(spark, path, new, KEYS, new)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> list[tuple[int, str]]:
    """``new`` rows replace those with the same ``keys`` (document and version among them)."""
    if missing := [c for c in KEYS if c not in keys]:
        raise ValueError(f"the keys lack {', '.join(missing)}")
    return _change(spark, path, new, keys, new)


def delete_versions(spark: SparkSession, path: str, gone: DataFrame) -> list[tuple[int, str]]:
    """The rows of some (document, version) pairs go; pairs that are not there do no harm."""
    return _change(spark, path, gone, KEYS, None)
