"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected onto ``n_projections`` random lines; the index holds, for each block of
rows, the rows and one sorted array of projections a line.  A query looks, on every line, at the window
around its own projection whose half width is ``WIDTH`` times the search radius; a row in the window
collides.  The radius grows (virtual rehashing): windows expand, counts of collisions go on from what
they were, and a row whose count reaches the threshold is verified by its exact cosine.  A block's
search ends when the k-th verified distance lies within the radius.

The threshold follows from binomial tails: a row within the radius reaches it with a chance of ``chance`` at
least, whatever the data look like.  As the true neighbours lie within the radius at which a search ends,
that is the recall to expect.  Nothing else limits the search: no number of candidates ends it, and
blocks with too few rows are verified whole.

Blocks of the index meet groups of queries as tiles: a row travels queries / ``group_queries`` times, and a
query rows / ``block_rows`` times.  The work is that of all tiles, so it grows with queries times rows.

Defined results: rows with null identifier, or a vector that is null, all zero, of another length than
the most common one or with a null or non-finite component take no part.  A query's own rows (same
identifier) are not its candidates; repeated rows of others are candidates each (dealt to blocks by place,
not by identifier); a repeated query asks once, with the smallest of its vectors.  Fewer than k candidates
give fewer ranks, ties go to the smaller identifier, an empty table gives no rows.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn_join import smallest_vectors, usable
from .shared import shared_dir, stored

#: Half width of a window at radius 1: at its radius a row collides on one line with a chance of 0.826.
WIDTH = 1.36
#: The radius grows by so much at most.
GROWTH = 1.3
#: The least radius: equal vectors collide, although their projections are rounded.
LEAST = 1e-6
#: Rows of a block whose distances tell where its search begins.
PROBED = 256
#: Window entries that are counted at once.
AT_ONCE = 4_000_000
BLOCK = "block int, ids binary, norms binary, vectors binary, sorted binary, order binary"
FOUND = "query_id long, vec_id long, score double"


def threshold(n_projections: int, chance: float) -> int:
    """The most collisions that a row at the radius has with at least that chance."""
    p, tail = erf(WIDTH / sqrt(2)), 0.0
    for t in range(n_projections, 0, -1):
        tail += comb(n_projections, t) * p**t * (1 - p) ** (n_projections - t)
        if tail >= chance:
            return t
    return 1


def lines(n_projections: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n_projections, dim))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors times a power of two each (so that squares stay finite; no digit changes), and their norms."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def _rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), float).reshape(n, -1)


def _build(projections: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x, norms = scaled(_rows(rows.column("v"), rows.num_rows))
        at = (x / norms[:, None]) @ projections.T
        order = np.argsort(at, axis=0, kind="stable").T
        parts = [rows.column("vec_id").to_numpy(), norms, x, np.take_along_axis(at.T, order, 1).astype(np.float32), order.astype(np.int32)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], ["block", "ids", "norms", "vectors", "sorted", "order"])

    return run


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    n_blocks: int
    projections: np.ndarray


def build_index(rows: DataFrame, n_rows: int, dim: int, n_projections: int = 64, block_rows: int = 8192, seed: int = 7, path: str | None = None) -> Index:
    """The index of (vec_id, v), written as one row a block; a small table makes 24 blocks of 512 rows or more."""
    n_blocks = max(-(-n_rows // block_rows), min(24, -(-n_rows // 512)), 1)
    projections = lines(n_projections, dim, seed)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    return Index(stored(dealt.groupBy("block").applyInArrow(_build(projections), BLOCK), "index", path), n_blocks, projections)


class BlockSearch:
    """A group of queries in one block of the index."""

    def __init__(self, block: dict[str, bytes], projections: np.ndarray, k: int, least: int) -> None:
        self.ids, self.norms = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["norms"])
        self.x, self.n, self.m = np.frombuffer(block["vectors"]).reshape(len(self.ids), -1), len(self.ids), len(projections)
        self.sorted, self.order = np.frombuffer(block["sorted"], np.float32).reshape(self.m, -1), np.frombuffer(block["order"], np.int32)
        self.projections, self.k, self.least = projections, k, least

    def search(self, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, row's identifier, cosine), k at most a query."""
        self.q, self.q_norms = scaled(q)
        self.q_ids, self.counts = q_ids, np.zeros((len(q), self.n), np.uint16)
        self.verified = q_ids[:, None] == self.ids  # a query's own rows count as settled
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        probe = np.arange(0, self.n, max(1, self.n // PROBED))
        reach = np.array([self._verify(i, probe[~self.verified[i, probe]]) for i in range(len(q))])
        at = (self.q / self.q_norms[:, None]) @ self.projections.T
        low = high = np.array([np.searchsorted(s, a) for s, a in zip(self.sorted, at.T.astype(np.float32))]).T
        radius, active = np.maximum(np.minimum(reach, 2) / 2, LEAST), np.arange(len(q))
        while len(active):
            half = WIDTH * radius[active, None]
            new_low = np.array([np.searchsorted(s, a) for s, a in zip(self.sorted, (at[active] - half).T.astype(np.float32))]).T
            new_high = np.array([np.searchsorted(s, a, "right") for s, a in zip(self.sorted, (at[active] + half).T.astype(np.float32))]).T
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            self._expand(active, new_low, low, high, new_high)
            for i in active.tolist():
                everything = radius[i] >= 2  # all unit vectors are that near; what has not collided is looked at too
                reach[i] = self._verify(i, np.flatnonzero(~self.verified[i] & (everything | (self.counts[i] >= self.least))))
            done = (reach[active] <= radius[active] * (1 + 1e-9)) | (radius[active] >= 2)
            low, high, active = new_low[~done], new_high[~done], active[~done]
            radius[active] = np.minimum(np.maximum(np.minimum(reach[active], GROWTH * radius[active]), LEAST), 2)
        place = np.repeat(np.arange(len(q)), [len(b[0]) for b in self.best])
        return place, np.concatenate([b[1] for b in self.best]), np.concatenate([b[0] for b in self.best])

    def _expand(self, active: np.ndarray, new_low: np.ndarray, low: np.ndarray, high: np.ndarray, new_high: np.ndarray) -> None:
        """Count the entries of the sorted arrays in [new_low, low) and [high, new_high)."""
        size = (low - new_low + new_high - high).sum(1)
        start = 0
        line = np.arange(self.m, dtype=np.int64) * self.n
        while start < len(active):
            stop = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), AT_ONCE)))
            part = slice(start, stop)
            first = np.concatenate([new_low[part] + line, high[part] + line], 1).ravel()
            length = np.concatenate([low[part] - new_low[part], new_high[part] - high[part]], 1).ravel()
            rows = self.order[_runs(first, length)]
            n = len(active[part])
            of = np.repeat(np.arange(n, dtype=np.int64) * self.n, size[part])
            self.counts[active[part]] += np.bincount(of + rows, minlength=n * self.n).reshape(n, self.n).astype(np.uint16)
            start = stop

    def _verify(self, i: int, rows: np.ndarray) -> float:
        """Exact cosines of query i with some rows; the distance of its k-th best so far."""
        if len(rows):
            self.verified[i, rows] = True
            score = (self.x[rows] * self.q[i]).sum(1) / (self.norms[rows] * self.q_norms[i])
            score, ids = np.concatenate([self.best[i][0], score]), np.concatenate([self.best[i][1], self.ids[rows]])
            if len(score) > 4 * self.k:
                likely = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                score, ids = score[likely], ids[likely]
            keep = np.lexsort((ids, -score))[: self.k]
            self.best[i] = score[keep], ids[keep]
        found = self.best[i][0]
        return sqrt(max(0.0, 2 - 2 * found[-1])) if len(found) == self.k else np.inf


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _tile(projections: np.ndarray, k: int, least: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and block.num_rows:
            search = BlockSearch({c: block.column(c)[0].as_buffer() for c in ("ids", "norms", "vectors", "sorted", "order")}, projections, k, least)
            ids = queries.column("vec_id").to_numpy()
            place, *found = search.search(ids, _rows(queries.column("v"), len(ids)))
            columns = [ids[place], *found]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def search(index: Index, queries: DataFrame, n_queries: int, k: int, chance: float = 0.97, group_queries: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id, v) over all blocks of the index."""
    n_groups = max(1, -(-n_queries // group_queries))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")).withColumn("at", numbers(index.n_blocks))
    sent = index.blocks.withColumn("to_grp", numbers(n_groups))
    tile = _tile(index.projections, k, threshold(len(index.projections), chance))
    found = asked.groupBy("grp", "at").cogroup(sent.groupBy("to_grp", "block")).applyInArrow(tile, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", chance: float = 0.97,
    n_projections: int = 64, block_rows: int = 8192, group_queries: int = 2048, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest found; ``is_query`` is a condition on ``vec_id``."""
    work = shared_dir(vectors.sparkSession, "collision-search")
    rows, n_rows, dim = usable(vectors, id_col, vector_col, zero=False)
    index = build_index(rows, n_rows, max(dim, 1), n_projections, block_rows, seed, f"{work}/index")
    queries = stored(smallest_vectors(rows, is_query), "queries", f"{work}/queries")
    return search(index, queries, queries.count(), k, chance, group_queries)
