"""Token-ID files: canonical length-limited Huffman codes over global counts.

Writing takes two passes over ids that are computed once:

1. documents are range-partitioned by id and sorted; each task encodes its texts and stores
   them as plain blocks (whole documents, about ``block_ids`` ids, more only for a longer document);
2. symbol counts of all blocks are summed (partial counts per task, one row per symbol),
   package-merge gives code lengths of at most ``max_bits``, and each plain block is coded
   on its own.

A file holds rows of independent blocks: ids of its documents, their lengths, the bit stream
and, for each ``LANE`` ids, a checkpoint (bits since the one before).  Decoding looks up
``max_bits`` bits in a flat table and walks all lanes of a block at once.  ``codebook`` holds
(symbol, count, bits); the canonical codes follow from it.

Defined results: null text counts as empty; an empty text still has its end id; repeated or
null doc_ids are kept as rows of their own (nulls first); an empty table gives no blocks.  A very
long text makes a longer block.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import by_text, encoder, largest_id
from .shared import stored, text_of

LANE = 64
MAX_BITS = 20

PLAIN = "part int, block int, part_start long, doc_ids array<bigint>, doc_lens array<bigint>, ids binary"
CODED = "part int, block int, part_start long, doc_ids array<bigint>, doc_lens array<bigint>, bits binary, checkpoints binary"
CODEBOOK = "symbol int, count long, bits int"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    is_leaf, weights = [np.ones(n, bool)], leaves
    for _ in range(max_bits - 1):
        m = len(weights) // 2
        packed = weights[: 2 * m : 2] + weights[1 : 2 * m : 2]
        both = np.concatenate([leaves, packed])
        order = np.argsort(both, kind="stable")
        weights = both[order]
        is_leaf.append(order < n)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        n_leaves = int(flags[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in code order, code of each symbol of the alphabet)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for symbol in order.tolist():
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return order, codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream (big-endian 32-bit words) and the checkpoints of one block."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    at = ends - n_bits
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - n_bits).astype(np.uint64)
    n_words = (int(ends[-1]) + 31) // 32 + 1 if len(ids) else 0
    # Codes do not overlap, so adding their parts sets the bits; sums below 2**32 are exact in doubles.
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n_words)
    words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)[:n_words]
    marks = np.diff(at[::LANE], prepend=0).astype("<u2")
    return words.astype(">u4").tobytes(), marks.tobytes()


class BlockDecoder:
    """Table-driven decoding: one look-up of ``max(lengths)`` (at most 27) bits gives a symbol and its length."""

    def __init__(self, lengths: np.ndarray) -> None:
        order, _ = canonical_codes(lengths)
        self.width = int(lengths.max()) if len(order) else 1
        repeats = 1 << (self.width - lengths[order].astype(np.int64))
        #: symbol << 5 | bits
        self.entry = np.ones(1 << self.width, np.uint32)
        self.entry[: repeats.sum()] = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order], repeats)

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.int64), np.zeros(LANE * self.width // 32 + 3, np.int64)])
        # The high bit of a pair may set the sign; it is masked off with what lies before the window.
        pairs = (words[:-1] << 32) | words[1:]
        at = np.cumsum(np.frombuffer(checkpoints, "<u2").astype(np.int64))
        out = np.empty((LANE, len(at)), np.uint32)
        mask, shift = (1 << self.width) - 1, 64 - self.width
        for k in range(LANE):
            out[k] = here = self.entry.take((pairs.take(at >> 5) >> (shift - (at & 31))) & mask)
            at += here & 31
        return out.T.reshape(-1)[:n] >> np.uint32(5)


def _plain_blocks(tokenizer_path: str, end_id: int | None, block_ids: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        block, start = 0, 0
        doc_ids: list = []
        doc_lens: list[int] = []
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, doc_ids, doc_lens, held, n_held
            data = np.concatenate(held).astype(width).tobytes()
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([doc_lens], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["part", "block", "part_start", "doc_ids", "doc_lens", "ids"],
            )
            block, start = block + 1, start + n_held
            doc_ids, doc_lens, held, n_held = [], [], [], 0
            return out

        for batch in batches:
            for part_of in by_text(batch, 1):
                ids, n_ids = code.encode(part_of.column(1))
                ends = np.cumsum(n_ids)
                if end_id is not None:
                    ids = np.insert(ids, ends, end_id)
                    ends = ends + np.arange(1, len(ends) + 1)
                at = 0
                for key, end in zip(part_of.column(0).to_pylist(), ends.tolist()):
                    doc_ids.append(key)
                    doc_lens.append(end - at)
                    held.append(ids[at:end])
                    n_held += end - at
                    at = end
                    if n_held >= block_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column(0):
                got = np.bincount(np.frombuffer(data.as_buffer(), width))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["symbol", "count"])

    return run


def _coded_blocks(lengths: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, codes = canonical_codes(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bits, marks = encode_block(np.frombuffer(row.column(5)[0].as_buffer(), width), codes, lengths)
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([bits], pa.binary()), pa.array([marks], pa.binary())], [*batch.schema.names[:5], "bits", "checkpoints"])

    return run


def _decoded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = BlockDecoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["doc_lens"], np.int64)
                ids = decoder.decode(row["bits"], row["checkpoints"], int(lens.sum())).astype("<u4").tobytes()
                ends = np.cumsum(lens)
                data = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(lens), pa.int32()), pa.array(row["part_start"] + ends - lens, pa.int64()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(lens, pa.int64()), pa.array(data, pa.binary())],
                    ["part", "part_start", "doc_id", "n_tokens", "ids"],
                )

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, *, id_col: str = "doc_id",
    text_col: str = "text", max_bits: int = MAX_BITS, block_ids: int = 1 << 18,
) -> str:
    """Encode all texts and write ``path``/codebook and ``path``/blocks in ascending order of ``id_col``.

    The plain ids of the first pass go to the shared folder, in 16 bits each where all ids fit.
    """
    spark = docs.sparkSession
    width = "<u2" if max(end_id or 0, largest_id(tokenizer_path)) < 1 << 16 else "<u4"
    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Rows that share an identifier are parted by the beginning of their text, equal rows by their place in ``docs``, a stored table.
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    plain = stored(ordered.mapInArrow(_plain_blocks(tokenizer_path, end_id, block_ids, width), PLAIN), "token-ids")
    counts = plain.select("ids").mapInArrow(_count(width), "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count"))
    # One row per symbol of the vocabulary at most.
    rows = counts.orderBy("symbol").collect()
    total = np.zeros(rows[-1]["symbol"] + 1 if rows else 1, np.int64)
    for r in rows:
        total[r["symbol"]] = r["count"]
    lengths = code_lengths(total, max_bits)
    book = [(int(s), int(total[s]), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(book, CODEBOOK).coalesce(1).write.parquet(f"{path}/codebook")
    plain.mapInArrow(_coded_blocks(lengths, width), CODED).write.option("compression", "none").partitionBy("part").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    book = spark.read.schema(CODEBOOK).parquet(f"{path}/codebook").collect()  # one row per symbol
    lengths = np.zeros(max((r["symbol"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["symbol"]] = r["bits"]
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    per_part = blocks.groupBy("part").agg(F.sum(F.aggregate("doc_lens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    # One row per file: an order over them is small, whatever the number of documents.
    before = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = blocks.select(*CODED_COLUMNS).mapInArrow(_decoded(lengths), "part int, part_start long, doc_id long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


CODED_COLUMNS = ["part", "block", "part_start", "doc_ids", "doc_lens", "bits", "checkpoints"]
