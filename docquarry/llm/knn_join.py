"""Exact top-k search by inner product as a Voronoi kNN join.

A bounded number of vectors, chosen by a hash, become pivots; every vector joins the cell of its
nearest pivot.  A cell's summary holds its size, its radius and its ``k + 1`` members nearest to the pivot.
With ``r = |x - p|`` a score ``q.x`` lies within ``q.p -+ |q| r``.  So summaries alone give each query
a bound that its k-th best score reaches, and a cell whose ``q.p + |q| radius`` stays below it cannot
contribute.  The queries of neighbouring cells are joined into groups of about ``group_queries``, those of a
crowded cell are cut into such groups; a block of a cell is replicated to exactly those groups with a
query that may need it, and each (group, cell, block) is solved on its own with one matrix product.  The
best k of each are merged.  So a row is copied at most queries / ``group_queries`` times (and a few), and
less the more the bounds tell.

Vectors are floor(scale * x) in doubles, so products are exact integers below 2**53; vectors so long that
a product may reach that raise a ValueError.

Defined results: rows with null identifier, null vector or a null or non-finite component take no
part; neither do vectors of another length than the most common one.  A query's own rows (same
identifier) are not its candidates; repeated rows of others are candidates each; a repeated query
asks once, with the smallest of its vectors.  Fewer than k candidates give fewer ranks; ties go to the smaller identifier; an empty table
gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, stored

CELLS = "vec_id long, v binary, norm double, cell int, r double"
#: Bounds are doubles; this share of |q| |x| covers their rounding.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> tuple[DataFrame, int, int]:
    """(vec_id, v as array<double>) of the rows that take part, their number and length; without ``zero`` none that is all zero."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & (F.size("v") > 0))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, n_rows = (common[0]["d"], common[0]["count"]) if common else (0, 0)
    return rows.filter(F.size("v") == dim), n_rows, dim


def smallest_vectors(rows: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, v) of the queries; an identifier with several vectors asks with the smallest (compared component by component)."""
    return rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))


def number_of_pivots(n_rows: int) -> int:
    """64 for small tables, growing with the square root of the rows up to 1024."""
    return min(1024, max(64, math.isqrt(n_rows) // 4))


def query_groups(pivots: np.ndarray, counts: np.ndarray, group_queries: int) -> list[tuple[int, int]]:
    """(group, parts) of each cell: cells next to each other along the pivots' main direction share a group
    until it has ``group_queries`` queries; a cell with more makes a group of its own, dealt into parts."""
    spread = pivots - pivots.mean(0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
    out, group, held = [(0, 1)] * len(pivots), -1, group_queries
    for cell in np.argsort(along, kind="stable").tolist():
        n = int(counts[cell])
        if held + n > group_queries:
            group, held = group + 1, 0
        out[cell] = (group, max(1, -(-n // group_queries)))
        held += n
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), "<f8") for x in column]).reshape(len(column), -1)


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            d2 = (x**2).sum(1)[:, None] + square - 2 * (x @ pivots.T)
            cell = d2.argmin(1)
            r = np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
            data = pa.array([row.astype("<f8").tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data, pa.array(np.sqrt((x**2).sum(1))), pa.array(cell, pa.int32()), pa.array(r)], ["vec_id", "v", "norm", "cell", "r"])

    return run


def _needs(pivots: np.ndarray, radius: np.ndarray, near: list[tuple[int, int, float]], k: int):
    """Adds the cells a query needs."""
    cells = np.array([c for c, _, _ in near], np.int64)
    ids = np.array([i for _, i, _ in near], np.int64)
    r = np.array([x for _, _, x in near])
    norms = np.sqrt((pivots**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, norm = _matrix(batch.column(1)), batch.column(2).to_numpy()[:, None]
            own = batch.column(0).to_numpy()[:, None]
            score = q @ pivots.T
            slack = SLACK * norm * (norms + radius + 1)
            low = np.where(ids == own, -np.inf, score[:, cells] - norm * r - slack[:, cells])
            bound = np.full((len(q), 1), -np.inf)
            if len(ids) >= k:
                bound = np.partition(low, len(ids) - k, 1)[:, len(ids) - k : len(ids) - k + 1]
            high = score + norm * radius + slack
            needs = [np.flatnonzero(row).astype(np.int32) for row in (high >= bound) & (radius >= 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needs, pa.list_(pa.int32()))], [*batch.schema.names, "needs"])

    return run


def _solve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        q_ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        score = q @ x.T
        score[q_ids[:, None] == x_ids] = -np.inf
        if k < len(x):
            least = np.partition(score, len(x) - k, 1)[:, len(x) - k][:, None]
            i, j = np.nonzero((score >= least) & (score > -np.inf))
        else:
            i, j = np.nonzero(score > -np.inf)
        order = np.lexsort((x_ids[j], -score[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pa.table([pa.array(q_ids[i]), pa.array(x_ids[j]), pa.array(score[i, j].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def knn_join(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    n_pivots: int | None = None, block_rows: int = 8192, group_queries: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on the column ``vec_id``.

    The number of pivots follows the table's size unless it is given (``number_of_pivots``).
    """
    spark, work = vectors.sparkSession, shared_dir(vectors.sparkSession, "knn-join")
    result = "query_id long, rank int, vec_id long, score long"
    rows, n_rows, _ = usable(vectors, id_col, vector_col)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots or number_of_pivots(n_rows)).collect()  # so many rows
    if not chosen:
        return spark.createDataFrame([], result)
    pivots = np.unique(np.array([r["v"] for r in chosen]), axis=0)
    cells = stored(rows.mapInArrow(_assign(pivots), CELLS), "cells", f"{work}/cells")

    # Summaries: one row per cell, and k + 1 members of each.
    size, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -1.0)
    for s in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius"), F.max("norm").alias("norm")).collect():
        size[s["cell"]], radius[s["cell"]] = s["n"], s["radius"]
        if s["norm"] ** 2 >= 2**53:
            raise ValueError("vectors are too long for exact products in doubles; use a smaller scale")
    by_r = Window.partitionBy("cell").orderBy("r", "vec_id")
    near = cells.select("cell", "vec_id", "r").withColumn("place", F.row_number().over(by_r)).filter(F.col("place") <= k + 1).collect()
    members = [(s["cell"], s["vec_id"], s["r"]) for s in near]

    n_blocks = F.element_at(F.array(*[F.lit(int(-(-n // block_rows)) or 1) for n in size]), F.col("cell") + 1)
    data = cells.select("cell", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int").alias("block"), "vec_id", "v")
    asked = stored(smallest_vectors(rows, is_query).mapInArrow(_assign(pivots), CELLS), "asked", f"{work}/asked")
    counts = np.zeros(len(pivots), np.int64)
    for s in asked.groupBy("cell").count().collect():  # one row per pivot
        counts[s["cell"]] = s["count"]
    groups = query_groups(pivots, counts, group_queries)
    of_cell = lambda k: F.element_at(F.array(*[F.lit(g[k]) for g in groups]), F.col("cell") + 1)
    asked = asked.select("vec_id", "v", "norm", F.xxhash64(of_cell(0), F.pmod(F.xxhash64("vec_id"), of_cell(1))).alias("grp"))
    asked = stored(asked.mapInArrow(_needs(pivots, radius, members, k), "vec_id long, v binary, norm double, grp long, needs array<int>"), "queries", f"{work}/queries")
    routed = asked.select("grp", "vec_id", "v", F.explode("needs").alias("cell"))
    routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    wanted = routed.select("grp", "cell", "block").distinct().withColumnsRenamed({"grp": "to_grp", "cell": "to_cell", "block": "to_block"})
    sent = data.join(wanted, (F.col("cell") == F.col("to_cell")) & (F.col("block") == F.col("to_block")))
    sent = sent.select("to_grp", "to_cell", "to_block", "vec_id", "v")
    best = routed.groupBy("grp", "cell", "block").cogroup(sent.groupBy("to_grp", "to_cell", "to_block")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
