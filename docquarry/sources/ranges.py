"""Large files read in parts by separate tasks: ranges of bytes, sheets of workbooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.workbook import cells_of, sheets_of

BLOCK = 8 * 1024 * 1024
#: A file that can be read from any place; pass one where Python needs its own client for a store.
Opener = Callable[[str], BinaryIO]
CELLS = "source string, sheet string, row int, column int, value string"
_CELLS_A_FRAME = 20_000


def open_path(path: str) -> BinaryIO:
    """A file by the path that Spark gives, in the stores that pyarrow knows."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    store, inside = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return store.open_input_file(inside)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of few bytes that stand for much work, dealt by ``keys`` to a fixed number of tasks (adaptive execution would join them)."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def byte_blocks(spark: SparkSession, path: str, start: int = 0, length: int | None = None, *, block: int = BLOCK, opener: Opener = open_path) -> DataFrame:
    """path, length, at, content: the bytes of files, or ``length`` of them from ``start``, in blocks of at most ``block``.

    Files of up to ``block`` bytes are read by Spark, from whatever store.  Of larger ones each block is a row of its own, which a
    task reads by seeking there, so nothing outside of the range is read and a task holds one block.  An empty file, or a
    range behind a file's end, has no row.  ``at`` is the place of a block's first byte in its file.
    """
    if start < 0 or block < 1 or (length is not None and length < 0):
        raise ValueError("start and length must not be negative, and a block has at least one byte")
    found = spark.read.format("binaryFile").load(path)
    end = F.col("length") if length is None else F.least("length", F.lit(start + length))
    found = found.filter(end > start)
    small = found.filter(F.col("length") <= block)
    small = small.select("path", "length", F.lit(start).cast("long").alias("at"), F.substring(F.col("content"), F.lit(start + 1), (end - start).cast("int")).alias("content"))
    pieces = found.filter(F.col("length") > block).select("path", "length", end.alias("end"), F.explode(F.sequence(F.lit(start).cast("long"), end - 1, F.lit(block).cast("long"))).alias("at"))
    pieces = _dealt(pieces.select("path", "length", "at", F.least(F.lit(block).cast("long"), F.col("end") - F.col("at")).alias("size")), "path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opener(row["path"]) as file:
                    file.seek(row["at"])
                    content = file.read(row["size"])
                if len(content) != row["size"]:
                    raise EOFError(f"{row['path']} has changed: {len(content)} of {row['size']} bytes at {row['at']}")
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "length": row["length"], "at": row["at"], "content": content}], schema=_BLOCKS)

    return small.unionByName(pieces.mapInArrow(read, "path string, length long, at long, content binary"))


_BLOCKS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("content", pa.binary())])


def read_xlsx(spark: SparkSession, path: str, *, block: int = BLOCK, opener: Opener = open_path) -> DataFrame:
    """source, sheet, row, column, value of all cells of all workbooks.

    Workbooks of up to ``block`` bytes are read by Spark, a workbook in one task.  Of larger ones each sheet is a row of its own: a
    task lists them from the archive's directory, others read one sheet each by seeking to it, cell by cell.
    """
    found = spark.read.format("binaryFile").load(path)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                for name, entry in sheets_of(pa.BufferReader(content)):
                    yield from _frames(source, name, cells_of(pa.BufferReader(content), entry))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source in frame["path"]:
                with opener(source) as file:
                    yield pd.DataFrame([(source, *s) for s in sheets_of(file)], columns=["source", "sheet", "entry"])

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, sheet, entry in zip(frame["source"], frame["sheet"], frame["entry"]):
                with opener(source) as file:
                    yield from _frames(source, sheet, cells_of(file, entry))

    small = found.filter(F.col("length") <= block).select("path", "content").mapInPandas(whole, CELLS)
    large = _dealt(found.filter(F.col("length") > block).select("path"), "path").mapInPandas(listed, "source string, sheet string, entry string")
    return small.unionByName(_dealt(large, "source", "sheet").mapInPandas(one, CELLS))


def _frames(source: str, sheet: str, cells: Iterator[tuple[int, int, str]]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for cell in cells:
        held.append((source, sheet, *cell))
        if len(held) == _CELLS_A_FRAME:
            yield pd.DataFrame(held, columns=["source", "sheet", "row", "column", "value"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["source", "sheet", "row", "column", "value"])
