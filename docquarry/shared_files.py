"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in this process alone (tests, one machine), a temporary
    folder is used; on a cluster that is an error, as other machines would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="docquarry-"))
        base = _LOCAL_DIR[0]
    return f"{base.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = path or shared_dir(spark, name)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt anew if it is read in fewer parts than half of the cores, as a small file is.

    For work that costs far more than a shuffle of its few rows; a large table is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() * 2 <= cores else frame


def fresh_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores before it until no frame has such a column (whatever the case)."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
