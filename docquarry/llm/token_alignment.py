"""Cross-tokenizer alignment with a dangling-suffix transducer.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte fallback) the text,
before which it puts the space itself.  Both cut the same bytes.  The transducer's state is the side that
leads and its bytes that the other side has not matched; the side behind reads its next token.  A transition
depends on the state and that token alone and is kept; a residual is never longer than a token, so the
states are few.  Where the residual is empty, both sides end and a group closes.

The transducer meets each distinct chunk of text once: both tokenizers begin anew at certain places (where A's
pattern always begins a match, ``chunk_encoder``, and no piece of B holds the two neighbouring characters), so
groups never cross them.  A worker keeps up to ``max_chunks`` chunks with their groups, as flat arrays.

A pair's count is the number of documents in which its ids share a group: each document lists its distinct
pairs once with the number of links, counts are partial sums.  The counts come back to the documents by a broadcast
of the frequent pairs (``MOST_BROADCAST`` at most, by a count of the counts) and a join for all others,
of which none can be frequent: each has fewer than 2 * (rows of document and pair) / ``MOST_BROADCAST``.

Defined results: a text that is null or empty, or whose tokens of either side do not give back the space and the
text (U+2581 does not survive B), has no tokens: zeros, and an empty string for the groups.  Special tokens'
strings are plain text.  Repeated rows are documents of their own, whatever their identifiers (null, too).
Very long texts are worked on whole.  An empty table gives no rows.  Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_encoder import ChunkEncoder, by_size, by_text, bytes_of, chunk_starts, distinct, runs
from .shared import shared_dir, stored, text_of

MAX_CHUNKS = 300_000
#: B encodes about so many bytes of new chunks in one call.
CHARS_AT_ONCE = 200_000
#: A side of a group with more ids is counted before it is paired.
FEW = 8
#: Pairs that are broadcast: 24 bytes each.
MOST_BROADCAST = 500_000
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
#: B's sign for a space.
SPACE_SIGN = "▁"

Group = tuple[int, int, int, int]


class Transducer:
    """Groups of two token sequences that spell the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.spelled = (a_bytes, b_bytes)
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # (side that leads, its unmatched bytes); at the start A reads
        self.number = {self.states[0]: 0}
        self.moves: dict[tuple[int, int], int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after the side behind has read ``token``; -1 if its bytes differ from the leader's."""
        key = (state, token)
        if key not in self.moves:
            leader, residual = self.states[state]
            spelled = self.spelled[1 - leader][token]
            if residual.startswith(spelled):
                after = (leader, residual[len(spelled) :])
            elif spelled.startswith(residual):
                after = (1 - leader, spelled[len(residual) :])
            else:
                after = None
            if after and not after[1]:
                after = self.states[0]
            if after and after not in self.number:
                self.number[after] = len(self.states)
                self.states.append(after)
            self.moves[key] = -1 if after is None else self.number[after]
        return self.moves[key]

    def groups(self, a: list[int], b: list[int]) -> list[Group] | None:
        """(from, to) among ``a`` and (from, to) among ``b`` of each group; None if the bytes differ."""
        moves, states, found = self.moves, self.states, []
        state = i = j = a0 = b0 = 0
        while True:
            if states[state][0]:  # B leads, or neither
                if i == len(a):
                    break
                token = a[i]
                i += 1
            else:
                if j == len(b):
                    break
                token = b[j]
                j += 1
            after = moves.get((state, token))
            state = self.move(state, token) if after is None else after
            if not state:
                found.append((a0, i, b0, j))
                a0, b0 = i, j
            elif state < 0:
                return None
        return None if state or j < len(b) else found


class Pieces:
    """Tokenizer B: bytes of its pieces, ids of chunks, and the bytes between which it always cuts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.n_bytes = np.fromiter(map(len, self.spelled), np.int64, size)
        #: By last byte of a character and first byte of the next one.
        self.cuts = np.ones((256, 256), bool)
        self.cuts[:, 0x80:0xC0] = False  # inside of a character
        for i, piece in enumerate(pieces):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                signs = [c.encode() for c in piece.replace(SPACE_SIGN, " ")]
                for x, y in zip(signs, signs[1:]):
                    self.cuts[x[-1], y[0]] = False
        sample = "  a\n b  "
        if any("\n" in p for p in pieces) or b"".join(self.spelled[i] for i in self.model.encode(sample)) != b" " + sample.encode():
            raise ValueError("B must put a space before a text, keep all white space, fall back to bytes and have no piece with a line feed")

    def encode_chunks(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, the number of each, and whether it can be spelled.  Line feeds part the chunks: B cuts around them."""
        good = np.array([SPACE_SIGN.encode() not in k for k in keys])
        counts, found = np.zeros(len(keys), np.int64), [np.zeros(0, np.int64)]
        where = np.flatnonzero(good)
        lengths = np.fromiter((len(keys[i]) for i in where.tolist()), np.int64, len(where))
        for x, y in by_size(lengths.tolist(), CHARS_AT_ONCE):
            ids = np.array(self.model.encode("".join("\n" + keys[i].decode() for i in where[x:y].tolist())), np.int64)
            ends = np.cumsum(self.n_bytes[ids])
            stop = 1 + np.cumsum(lengths[x:y] + 1)  # the space that B puts before all, then a line feed and a chunk each
            last = np.searchsorted(ends, stop)
            if len(ends) <= last[-1] or not (ends[last] == stop).all():
                raise ValueError("a piece crosses two chunks")
            first = np.concatenate([[2], last[:-1] + 2])
            counts[where[x:y]] = last + 1 - first
            found.append(ids[runs(first, last + 1 - first)])
        return np.concatenate(found), counts, good


class Pool:
    """Runs of values, told by number."""

    def __init__(self, kind: type) -> None:
        self.values, self.at, self.count = np.zeros(0, kind), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, values: np.ndarray, count: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.values) + np.cumsum(count, dtype=np.int32) - count], dtype=np.int32)
        self.values, self.count = np.concatenate([self.values, values], dtype=self.values.dtype), np.concatenate([self.count, count], dtype=np.int32)

    def take(self, places: np.ndarray) -> np.ndarray:
        return self.values[runs(self.at[places], self.count[places])]


class AlignedChunks:
    """Chunks with their groups: (n_a, n_b, n_groups, n_links, differs), text of the groups, pairs and links of each pair."""

    def __init__(self, a_path: str, b_path: str, max_chunks: int = MAX_CHUNKS) -> None:
        self.a, self.b, self.max_chunks = ChunkEncoder(a_path, special=False), Pieces(b_path), max_chunks
        self.transducer, self.n_b = Transducer(self.a.spelled(), self.b.spelled), len(self.b.spelled)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.met, self.numbers = pa.array([], pa.binary()), np.zeros(0, bool), np.zeros((0, 5), np.int64)
        self.text, self.pairs, self.links = Pool(np.uint8), Pool(np.int64), Pool(np.int64)

    def starts(self, data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        found = chunk_starts(data, text_starts)
        both = self.b.cuts[data[found - 1], data[found]]
        both[np.searchsorted(found, text_starts)] = True
        return found[both]

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place of each chunk; new ones are aligned."""
        keys, index = distinct(data, starts)
        place = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        self.met[place[place >= 0]] = True
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = keys.take(pa.array(fresh))
            place = place.copy()
            place[fresh] = len(self.keys) + np.arange(len(fresh))
            self._add(new, *self._align(new.to_pylist()))
        return place[index]

    def _add(self, keys: pa.Array, numbers: np.ndarray, *pools: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.met = pa.concat_arrays([self.keys, keys]), np.concatenate([self.met, np.ones(len(keys), bool)])
        self.numbers = np.concatenate([self.numbers, numbers])
        for pool, (values, count) in zip((self.text, self.pairs, self.links), pools):
            pool.add(values, count)

    def forget(self) -> None:
        """Beyond ``max_chunks`` only those that were met since the last time stay, half of the room at most."""
        if len(self.keys) > self.max_chunks:
            stay = np.flatnonzero(self.met)[: self.max_chunks // 2]
            kept = self.keys.take(pa.array(stay)), self.numbers[stay], *((p.take(stay), p.count[stay]) for p in (self.text, self.pairs, self.links))
            self._clear()
            self._add(*kept)
            self.met[:] = False

    def _align(self, keys: list[bytes]):
        a_ids, a_count = self.a.encode_chunks(keys)
        b_ids, b_count, good = self.b.encode_chunks(keys)
        a_ids, b_ids = a_ids.tolist(), b_ids.tolist()
        numbers, texts, pairs, links, n_pairs = np.zeros((len(keys), 5), np.int64), [], [], [], []
        i = j = 0
        for row, (n, m, fine) in enumerate(zip(a_count.tolist(), b_count.tolist(), good.tolist())):
            a, b = a_ids[i : i + n], b_ids[j : j + m]
            i, j = i + n, j + m
            groups = self.transducer.groups(a, b) if fine else None
            joint: dict[int, int] = {}
            if groups is None:
                numbers[row, 4] = 1
                texts.append("")
            else:
                named, n_links = [], 0
                for a0, a1, b0, b1 in groups:
                    one = a1 - a0 == 1 == b1 - b0
                    named.append(f"{a[a0]}|{b[b0]};" if one else f"{str(a[a0:a1])[1:-1]}|{str(b[b0:b1])[1:-1]};")
                    n_links += (a1 - a0) * (b1 - b0)
                    if one:
                        pair = a[a0] * self.n_b + b[b0]
                        joint[pair] = joint.get(pair, 0) + 1
                    else:
                        in_b = Counter(b[b0:b1]).items() if b1 - b0 > FEW else [(y, 1) for y in b[b0:b1]]
                        for x, times in Counter(a[a0:a1]).items() if a1 - a0 > FEW else [(x, 1) for x in a[a0:a1]]:
                            for y, times_b in in_b:
                                pair = x * self.n_b + y
                                joint[pair] = joint.get(pair, 0) + times * times_b
                numbers[row, :4] = n, m, len(groups), n_links
                texts.append("".join(named).replace(" ", ""))
            pairs.extend(joint.keys())
            links.extend(joint.values())
            n_pairs.append(len(joint))
        n_text, n_pairs = np.fromiter(map(len, texts), np.int32, len(texts)), np.array(n_pairs, np.int32)
        return numbers, (np.frombuffer("".join(texts).encode(), np.uint8), n_text), (np.array(pairs, np.int64), n_pairs), (np.array(links, np.int64), n_pairs)

    def documents(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of DOCUMENT from the second on, a row for each text."""
        spaced = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise("", texts, " "), "")
        data, bounds = bytes_of(spaced.combine_chunks() if isinstance(spaced, pa.ChunkedArray) else spaced)
        starts = self.starts(data, bounds[:-1][np.diff(bounds) > 0])
        place = self.places(data, starts)
        upto = np.searchsorted(starts, bounds)
        sums = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[place], 0)])[upto], axis=0)
        fine = sums[:, 4] == 0
        sums[~fine] = 0

        joined = memoryview(self.text.take(place))
        ends = np.concatenate([[0], np.cumsum(self.text.count[place], dtype=np.int64)])[upto]
        hashes = [hashlib.sha256(joined[x : y - 1]).hexdigest() if y > x and f else "" for x, y, f in zip(ends[:-1].tolist(), ends[1:].tolist(), fine.tolist())]

        of = np.repeat(np.repeat(np.arange(len(texts)), np.diff(upto)), self.pairs.count[place])
        pairs, links = self.pairs.take(place), self.links.take(place)
        pairs, links, of = pairs[fine[of]], links[fine[of]], of[fine[of]]
        key = (of << 40) | pairs
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        links = np.add.reduceat(links[order], first) if len(key) else links
        offsets = np.searchsorted(key[first] >> 40, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (key[first] & ((1 << 40) - 1), links)]
        self.forget()
        return [*(pa.array(c) for c in sums.T[:4]), pa.array(hashes, pa.string()), *lists]


_ALIGNERS: dict[tuple[str, str, int], AlignedChunks] = {}


def aligner(a_path: str, b_path: str, max_chunks: int = MAX_CHUNKS) -> AlignedChunks:
    """The aligner of this worker process."""
    key = (a_path, b_path, max_chunks)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = AlignedChunks(*key)
        if len(_ALIGNERS[key].transducer.spelled[0]) * _ALIGNERS[key].n_b >= 1 << 40:
            raise ValueError("the two vocabularies have too many pairs")
    return _ALIGNERS[key]


def _documents(a_path: str, b_path: str, max_chunks: int):
    names = [field.split()[0] for field in DOCUMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_text(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *aligner(a_path, b_path, max_chunks).documents(part.column(1))], names)

    return run


def with_best(counts: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): whether no pair with the same A id is held by more documents."""
    counts = counts.withColumn("a_id", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy(F.col("a_id").alias("of_a")).agg(F.max("n").alias("most"))  # as many rows as A has ids, at most
    return counts.join(F.broadcast(highest), F.col("a_id") == F.col("of_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> int:
    """A power of two that at most ``most`` pairs reach (the least one); 0 if all pairs are no more."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()  # 64 rows at most
    held = 0
    for s in sizes:
        held += s["count"]
        if held > most:
            return 1 << s["bits"]
    return 0


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = MAX_CHUNKS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    work = shared_dir(docs.sparkSession, "token-alignment")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = rows.mapInArrow(_documents(a_path, b_path, max_chunks), DOCUMENT).withColumn("uid", F.monotonically_increasing_id())
    found = stored(found, "documents", f"{work}/documents")
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs", f"{work}/pairs")
    least = frequent(counts, most_broadcast)
    counts = with_best(counts, len(Pieces(b_path).spelled))
    each = found.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("uid", "x.pairs", "x.links")
    known = each.join(F.broadcast(counts.filter(F.col("n") >= least)), F.col("pairs") == F.col("pair"), "left" if least else "inner")
    total = lambda rows: rows.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    totals = total(known.filter(F.col("n").isNotNull()))
    if least:
        rest = known.filter(F.col("n").isNull()).select("uid", "pairs", "links")
        rest = rest.join(counts.filter(F.col("n") < least), F.col("pairs") == F.col("pair"))
        totals = totals.unionByName(total(rest)).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = found.drop("pairs", "links").join(totals, "uid", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256")
