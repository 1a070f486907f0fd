"""Packing documents into training sequences by first-fit decreasing.

Documents are dealt at random (a seeded hash) into groups of about ``group_bytes`` of text, so a
group's size does not follow the input's; texts are the only thing that is shuffled.  Within a group
texts become ids, each document is cut into whole sequences and one rest, and the rests go, longest first, into the first bin with
room, which a tournament tree over the bins' capacities finds in log time.  Cutting is free:
afterwards the emptiest bins of a group give their ids to the gaps of the fullest ones, which
leaves one bin per group with padding.

Defined results: null text counts as empty and has its end id only; repeated rows are packed
each; an empty table gives no pieces.  A very long text is one group's, and is cut into as many
sequences as it takes.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import MAX_CHUNKS, by_size, encoder, runs
from .shared import release_memory, text_of

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Capacities of bins; finds the first bin with room for a size."""

    def __init__(self, n_bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n_bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        at = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; items are placed longest first, ties in their given order."""
    tree = TournamentTree(max(1, len(sizes)), capacity)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = tree.place(sizes[i])
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Move ids out of the emptiest bins into the gaps of the fullest; items are (row, start, length)."""
    bins = sorted(bins, key=lambda b: -sum(x[2] for x in b))
    used = [sum(x[2] for x in b) for b in bins]
    to, giver = 0, len(bins) - 1
    while to < giver:
        if used[to] == capacity:
            to += 1
            continue
        if not bins[giver]:
            giver -= 1
            continue
        row, start, length = bins[giver].pop()
        take = min(length, capacity - used[to])
        bins[to].append((row, start + length - take, take))
        used[to] += take
        used[giver] -= take
        if length > take:
            bins[giver].append((row, start, length - take))
    return [b for b in bins if b]


def _encoded(tokenizer_path: str, end_id: int, max_chunks: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, and how many each text has."""
    code, parts, counts = encoder(tokenizer_path, max_chunks), [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for a, b in by_size(pc.binary_length(texts).to_pylist()):
        ids, n_ids = code.encode(texts.slice(a, b - a))
        parts.append(np.insert(ids, np.cumsum(n_ids), end_id).astype("<u4"))
        counts.append(n_ids + 1)
    return np.concatenate(parts), np.concatenate(counts)


def _pack(tokenizer_path: str, end_id: int, capacity: int, max_chunks: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        # The order of the rows must not depend on how the shuffle delivered them.
        table = table.take(pc.sort_indices(table, [("row_key", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]))
        ids, n = _encoded(tokenizer_path, end_id, max_chunks, table.column("text").combine_chunks())
        doc_at, n_full = np.cumsum(n) - n, n // capacity
        # Whole sequences come first, each in one of its own.
        row = np.repeat(np.arange(len(n)), n_full)
        start = capacity * (np.arange(len(row)) - np.repeat(np.cumsum(n_full) - n_full, n_full))
        rests = np.flatnonzero(n % capacity)
        by_bin: dict[int, list[tuple[int, int, int]]] = {}
        for i, size, at in zip(rests.tolist(), (n[rests] % capacity).tolist(), first_fit_decreasing((n[rests] % capacity).tolist(), capacity)):
            by_bin.setdefault(at, []).append((i, int(n_full[i]) * capacity, size))
        pieces = [(i, s, length, len(row) + k) for k, items in enumerate(fill_gaps(list(by_bin.values()), capacity)) for i, s, length in items]
        more = np.array(pieces, np.int64).reshape(-1, 4).T
        row, start, length, sequence = (np.concatenate(x) for x in zip((row, start, np.full(len(row), capacity), np.arange(len(row))), more))
        before = np.cumsum(length) - length
        offset = before - before[np.searchsorted(sequence, sequence)]
        data = ids[runs(doc_at[row] + start, length)].tobytes()
        if len(data) >= 1 << 31:
            raise ValueError(f"a group of documents has {len(data) // 4} ids, 2**29 at most: a text is too long, or group_bytes too large")
        ends = pa.py_buffer(np.append(before, len(data) // 4).astype(np.int32) * 4)
        columns = [
            table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(start), pa.array(length),
            pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(data)]), pa.array(n[row]), pa.array((group << 32) + sequence), pa.array(offset),
        ]
        release_memory()
        return pa.table(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, *, id_col: str = "doc_id",
    text_col: str = "text", group_bytes: int = 8_000_000, seed: int = 17, max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit), sequence and offset there.

    ``docs`` is a stored table (rows are dealt by their place in it, too).  ``max_chunks`` bounds the table of encoded chunks that each worker keeps.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_groups = max(1, -(-n_bytes // group_bytes))
    row_key = F.xxhash64("doc_id", "text", F.lit(seed))
    # The place keeps copies of a row apart; it is the same again when a lost task reads its part of a stored table again.
    group = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed), F.monotonically_increasing_id()), F.lit(n_groups)).cast("int")
    dealt = rows.select(group.alias("pack_group"), "doc_id", row_key.alias("row_key"), "text")
    return dealt.groupBy("pack_group").applyInArrow(_pack(tokenizer_path, end_id, capacity, max_chunks), PIECES)
