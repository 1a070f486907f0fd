"""Python functions of one text as column functions whose memory does not grow with Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Texts that a task turns into Python objects at a time: this many bytes (or one longer text) and rows at most.
PART_BYTES, PART_ROWS = 1_000_000, 1000


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of texts that follow one another."""
    cost = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + PART_BYTES // PART_ROWS
    part = (np.cumsum(cost) - cost) // PART_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(start, end - start)


def of_text(make: Callable[[str | None], object], returns: str):
    """A column function that calls ``make`` for each text; input and results are held part by part."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in parts(texts):
                yield pa.array([make(t) for t in part.to_pylist()], kind)

    return run
