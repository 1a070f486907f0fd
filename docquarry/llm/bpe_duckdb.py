"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

A batch's texts fall into chunks and these into matches of the pre-tokenizer's pattern; every
distinct match is a word.  A word that is a token is done.  The others start as one token per byte.
The recursive query turns each word's tokens into rows (word, position, left, right), joins them
with the merge table, takes the leftmost pair of the least rank of each word and contracts it,
until no word changes.

In a long word that is done in all places that cannot influence each other.  No token is longer than
``L`` bytes, so what may take a part of a pair, and what the contracted pair may grow into at once,
lies within ``L`` tokens of it.  A pair that is the leftmost least within ``2 L`` tokens on both sides is
therefore contracted whatever happens beyond.  So are, of equal least pairs in a row, every other one
(from the first of the row, if all up to it are least), unless a least pair around would at once be
part of an even lesser pair (``backward``: pairs that rank before one of their parts).  The steps grow
with ``L``, the time with the length of the word.

Decoding joins the ids of all texts, one after another, with the vocabulary and aggregates them in
order of position.

The merge table has every pair of tokens whose bytes joined are a token, with that token's rank.
DuckDB runs in memory on one thread of the task, with a limit of ``MEMORY``; it sees a bounded number
of bytes or ids at a time.

Defined results: null text counts as empty and has no ids; special tokens are ordinary text; repeated
rows get a row each; a very long text or word is encoded whole; an empty table gives no rows.  Other
columns are not read, whatever their names.  Decoding: null ids count as none; an id that is no token
raises an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import ChunkTable, by_text, in_order, runs
from .shared import release_memory, text_of

MEMORY = "300MB"
ENCODED = "doc_id long, ids array<int>, decoded binary"
#: Of words of SHORT bytes at most all states are kept until the end, which is small and faster than
#: keeping the latest only; those of more than LONG bytes contract many pairs a step.
SHORT, LONG = 48, 512
#: A query sees words of about so many bytes, or so many ids.
WORD_BYTES, IDS_AT_ONCE = 1 << 19, 1 << 20

ENCODE_SQL = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION
  SELECT word, ids[:p - 1] || [merged] || ids[p + 2:] AS ids FROM (
    SELECT word, any_value(ids) AS ids, min(m.merged::BIGINT * 4294967296 + pos) & 4294967295 AS p, min(m.merged) AS merged
    FROM (SELECT word, ids, unnest(range(1, len(ids))) AS pos, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r FROM state) AS pair
    JOIN merges AS m USING (l, r) GROUP BY word))
SELECT word, ids FROM state ORDER BY word
"""
ENCODE_SHORT_SQL = ENCODE_SQL.replace("USING KEY (word) ", "").replace("UNION\n", "UNION ALL\n").replace(
    "SELECT word, ids FROM state ORDER BY word", "SELECT word, arg_min(ids, len(ids)) AS ids FROM state GROUP BY word ORDER BY word"
)
ENCODE_LONG_SQL = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION
  SELECT word, list(CASE WHEN first THEN merged ELSE l END ORDER BY pos) FILTER (NOT second) AS ids FROM (
    SELECT *, coalesce(lag(first) OVER (PARTITION BY word ORDER BY pos), false) AS second FROM (
      SELECT *, least AND (leftmost OR (settled AND even AND bool_and(quiet) OVER around)) AS first FROM (
        SELECT *, bool_and(least) OVER run AS settled, (pos - min(pos) OVER run) % 2 = 0 AS even,
               NOT (least AND (b1.l IS NOT NULL OR b2.l IS NOT NULL OR b3.l IS NOT NULL)) AS quiet FROM (
          SELECT *, coalesce(merged = min(merged) OVER around, false) AS least, coalesce(cost = min(cost) OVER around, false) AS leftmost,
                 sum(starts) OVER (PARTITION BY word ORDER BY pos) AS run_id FROM (
            SELECT word, pos, pair.l AS l, before, behind, m.merged AS merged, m.merged::BIGINT * 4294967296 + pos AS cost,
                   (m.merged IS DISTINCT FROM lag(m.merged) OVER (PARTITION BY word ORDER BY pos))::INT AS starts
            FROM (SELECT word, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS l, unnest(ids[2:] || [-1]) AS r,
                         unnest([-1] || ids[:-2]) AS before, unnest(ids[3:] || [-1, -1][:len(ids)]) AS behind FROM state) AS pair
            LEFT JOIN merges AS m ON m.l = pair.l AND m.r = pair.r)
          WINDOW around AS (PARTITION BY word ORDER BY pos ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)) AS p
        LEFT JOIN backward AS b1 ON b1.l = before AND b1.r = merged LEFT JOIN backward AS b2 ON b2.l = merged AND b2.r = behind
        LEFT JOIN backward AS b3 ON b3.l = merged AND b3.r = merged
        WINDOW run AS (PARTITION BY word, run_id ORDER BY pos))
      WINDOW around AS (PARTITION BY word ORDER BY pos ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)))
  GROUP BY word HAVING bool_or(first))
SELECT word, ids FROM state ORDER BY word
"""
#: Each text is followed by END, which no byte is written as.
END, PART = "\u0100", 1024
DECODE_SQL = f"""
SELECT pos // {PART} AS part, string_agg(v.bytes, '' ORDER BY pos) AS bytes, count(*) AS n FROM ids JOIN vocab AS v USING (id) GROUP BY part ORDER BY part
"""

MAX_CHUNKS = 600_000

_ENCODERS: dict[tuple[str, str], "DuckEncoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class DuckEncoder(ChunkTable):
    def __init__(self, path: str, pattern: str, max_chunks: int = MAX_CHUNKS) -> None:
        import duckdb
        import regex

        super().__init__(max_chunks)
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        #: By byte, the length of the longest token that has it.
        self.longest = np.zeros(256, np.int64)
        for token in self.ranks:
            self.longest[list(token)] = np.maximum(self.longest[list(token)], len(token))
        pairs = [
            (x, y, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
            if (x := self.ranks.get(token[:k])) is not None and (y := self.ranks.get(token[k:])) is not None
        ]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        self._table("merges", [pa.array(c, pa.int32()) for c in zip(*pairs)], ["l", "r", "merged"])
        self.duck.execute("CREATE TABLE backward AS SELECT l, r FROM merges WHERE merged < greatest(l, r)")
        # DuckDB's ordered aggregate joins text: a byte is written as the character of its number.
        self._table("vocab", [pa.array([*self.ranks.values(), -1], pa.int32()), pa.array([*(t.decode("latin-1") for t in self.ranks), END])], ["id", "bytes"])

    def _table(self, name: str, columns: list[pa.Array], names: list[str]) -> None:
        self.duck.register("incoming", pa.table(columns, names))
        self.duck.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.duck.unregister("incoming")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and the number of each word's."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        n_bytes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.ones(len(words), np.int64)
        found = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
        for sql, low, high in ((ENCODE_SHORT_SQL, 0, SHORT), (ENCODE_SQL, SHORT, LONG), (ENCODE_LONG_SQL, LONG, np.inf)):
            hard = np.flatnonzero((whole < 0) & (n_bytes > low) & (n_bytes <= high))
            part = (np.cumsum(n_bytes[hard]) - n_bytes[hard]) // WORD_BYTES
            for these in np.split(hard, np.flatnonzero(np.diff(part)) + 1) if len(hard) else []:
                data = np.frombuffer(b"".join([words[i] for i in these.tolist()]), np.uint8)
                offsets = np.concatenate([[0], np.cumsum(n_bytes[these])])
                self._table("words", [pa.array(these, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.byte[data]))], ["word", "ids"])
                lists = self.duck.sql(sql.format(w=2 * self.longest[data].max())).to_arrow_table().column("ids").combine_chunks()
                counts[these] = np.diff(lists.offsets.to_numpy())
                found.append((these, lists.flatten().to_numpy()))
        return in_order(found, counts), counts

    def encode_chunks(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.find(k.decode()) for k in keys]
        known: dict[str, int] = {}
        place = np.array([known.setdefault(w, len(known)) for w in chain.from_iterable(parts)], np.int64)
        ids, n = self.encode_words([w.encode() for w in known])
        ids = ids[runs((np.cumsum(n) - n)[place], n[place])]
        upto = np.concatenate([[0], np.cumsum(n[place])])
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum([len(p) for p in parts])])])

    def decode(self, ids: np.ndarray, n_ids: np.ndarray) -> list[bytes]:
        """The bytes of each run of ``n_ids`` ids."""
        every = np.insert(ids, np.cumsum(n_ids), -1).astype(np.int32)
        text = []
        for at in range(0, len(every), IDS_AT_ONCE):
            some = every[at : at + IDS_AT_ONCE]
            self._table("ids", [pa.array(np.arange(len(some), dtype=np.int32)), pa.array(some)], ["pos", "id"])
            got = self.duck.sql(DECODE_SQL).to_arrow_table()
            if sum(got.column("n").to_pylist()) != len(some):
                raise ValueError("an id is not in the vocabulary")
            text += got.column("bytes").to_pylist()
        return [t.encode("latin-1") for t in "".join(text).split(END)[:-1]]

    def encode_and_decode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids in order, ids per text, and the bytes that each text's ids decode to."""
        ids, n_ids = self.encode(texts)
        return ids, n_ids, self.decode(ids, n_ids)


def _encoder(path: str, pattern: str) -> DuckEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = DuckEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part in by_text(batch, 1):
                ids, n_ids, decoded = encoder.encode_and_decode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _encoder(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            decoded = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])
            release_memory()

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded (the bytes that the ids of the row stand for) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_encode(ranks_path, pattern), ENCODED)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded of every row of a table of ids."""
    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(ranks_path, pattern), "doc_id long, decoded binary")
