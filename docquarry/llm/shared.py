"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.shared_files import fresh_name, shared_dir, spread, stored

__all__ = ["fresh_name", "release_memory", "shared_dir", "spread", "stored", "table", "text_of"]

_TRIM: list = []


def release_memory() -> None:
    """Give memory that a worker has freed back to the system, as its executor shares a limit with it."""
    pa.default_memory_pool().release_unused()
    if not _TRIM:
        _TRIM.append(getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0))  # glibc only
    _TRIM[0](0)


def text_of(text_col: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
