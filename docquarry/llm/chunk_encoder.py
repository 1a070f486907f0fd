"""Byte-level BPE encoding with the tokenizers library, each distinct chunk of text encoded once.

The pre-tokenizer's pattern always begins a new match at certain places, whatever stands around
them: before a space or line feed that follows no white space, between letters, digits and
punctuation (apostrophes aside, which may begin a contraction), and behind a single line feed
between other characters.  A batch's texts fall there into chunks whose ids do not depend on each
other.  The cuts are found with array operations over the batch's bytes, Arrow tells the batch's
distinct chunks, and only those go through Python.

Strings of added tokens (``<|endoftext|>``) become the token's id, as the library does unless told otherwise
(``special=False``: they are plain text); a text falls there into texts of their own.

A worker keeps the ids of about ``max_chunks`` chunks, as a few flat arrays.  When there are more,
those that no batch has met since the last time go.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import release_memory

MAX_CHUNKS = 600_000
#: Texts of about so many bytes are worked on together.
BYTES_AT_ONCE = 4_000_000

_ENCODERS: dict[tuple[str, int, bool], "ChunkEncoder"] = {}

OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, FEED, HIGH, MAYBE_SPACE, MAYBE_START = range(10)


def _byte_classes() -> np.ndarray:
    """ASCII by kind; bytes above: HIGH, or what white space beyond ASCII may end or start with."""
    kinds = np.full(256, OTHER, np.uint8)
    for i in range(0x21, 0x7F):
        kinds[i] = DIGIT if chr(i).isdigit() else LETTER if chr(i).isalpha() else MARK
    kinds[[0x27, 0x20, 0x0A]] = APOSTROPHE, SPACE, FEED
    kinds[0x80:] = HIGH
    spaces = [chr(i).encode() for i in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    kinds[[s[-1] for s in spaces]] = MAYBE_SPACE
    kinds[[s[0] for s in spaces]] = MAYBE_START
    return kinds


_KINDS = _byte_classes()
#: The bytes before the last one of white space beyond ASCII.
_BEFORE_LAST = np.isin(np.arange(256), [0xC2, 0x9A, 0xA0, 0x80, 0x81])
_SOLID = np.isin(np.arange(10), [LETTER, DIGIT, MARK, APOSTROPHE, HIGH])


def _pairs() -> np.ndarray:
    """By 16 * class + next class: 1 for a cut between them, 2 for one if no white space comes before."""
    out = np.zeros(256, np.uint8)
    for a in range(10):
        if _SOLID[a]:
            out[[16 * a + SPACE, 16 * a + FEED]] = 1
            out[16 * FEED + a] = 2
    plain = (LETTER, DIGIT, MARK)
    for a in plain:
        for b in plain:
            if a != b:
                out[16 * a + b] = 1
    return out


_PAIRS = _pairs()


def classes(data: np.ndarray) -> np.ndarray:
    kinds = _KINDS[data]
    unsure = np.flatnonzero(kinds == MAYBE_SPACE)
    if len(unsure):
        kinds[unsure[~_BEFORE_LAST[data[unsure - 1]]]] = HIGH
    return kinds


def chunk_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts that follow one another."""
    kinds = classes(data)
    cut = np.zeros(len(data) + 1, np.uint8)
    if len(data) > 1:
        cut[1:-1] = _PAIRS[(kinds[:-1] << 4) | kinds[1:]]
        feeds = np.flatnonzero(cut == 2)
        cut[feeds] = (feeds < 2) | _SOLID[kinds[feeds - 2]]
    cut[text_starts] = 1
    cut[-1] = 0
    return np.flatnonzero(cut)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each text begins and the last one ends."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct chunks, and for each chunk its place among them."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return array.dictionary, array.indices.to_numpy()


def runs(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1 .. at + n - 1 of each pair, one after another (all below 2**31)."""
    ends = np.cumsum(n, dtype=np.int32)
    out = np.repeat((at - (ends - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def encoder(path: str, max_chunks: int = MAX_CHUNKS, special: bool = True) -> "ChunkEncoder":
    """The encoder of this worker process for the tokenizer file at ``path``."""
    key = (path, max_chunks, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, max_chunks, special)
    return _ENCODERS[key]


def added_tokens(path: str) -> list[bytes]:
    """Strings of the tokens added to a tokenizer file; raises if the file does not tokenize as this module assumes."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    before, model, added = parts["pre_tokenizer"] or {}, parts["model"], parts["added_tokens"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not parts["normalizer"]
    plain = plain and model["type"] == "BPE" and not any(model.get(c) for c in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    odd = [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])]
    if not plain or odd:
        raise ValueError(f"{path}: only byte-level BPE with the library's own pattern, without normalizer, and with added tokens that match as they stand")
    return [t["content"].encode() for t in added]


def occurrences(data: np.ndarray, bounds: np.ndarray, pattern: re.Pattern[bytes]) -> tuple[list[int], list[int]]:
    """Where matches of ``pattern`` begin and end, none of them across the end of a text."""
    raw, begins, ends, at = data.tobytes(), [], [], 0
    while hit := pattern.search(raw, at):
        stop = int(bounds[np.searchsorted(bounds, hit.start(), "right")])
        if hit := pattern.search(raw, hit.start(), stop):
            begins.append(hit.start())
            ends.append(hit.end())
        at = hit.end() if hit else stop
    return begins, ends


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


class ChunkTable:
    """Ids of chunks, by what ``encode_chunks`` of a subclass makes of them."""

    def __init__(self, max_chunks: int) -> None:
        self.max_chunks = max_chunks
        self.keys, self.met = pa.array([], pa.binary()), np.zeros(0, bool)
        self.pool, self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode_chunks(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys, in order, and the number of each key's."""
        raise NotImplementedError

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where chunks begin."""
        return chunk_starts(data, bounds[:-1][np.diff(bounds) > 0])

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place in the table of each chunk; new ones are learned."""
        keys, index = distinct(data, starts)
        place = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        self.met[place[place >= 0]] = True
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = keys.take(pa.array(fresh))
            ids, count = self.encode_chunks(new.to_pylist())
            place = place.copy()
            place[fresh] = len(self.keys) + np.arange(len(fresh))
            self._add(new, ids, count)
        return place[index]

    def _add(self, keys: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(count, dtype=np.int32) - count], dtype=np.int32)
        self.keys, self.pool = pa.concat_arrays([self.keys, keys]), np.concatenate([self.pool, ids], dtype=np.int32)
        self.count, self.met = np.concatenate([self.count, count], dtype=np.int32), np.concatenate([self.met, np.ones(len(keys), bool)])

    def _forget(self) -> None:
        """Beyond ``max_chunks`` only those that were met since the last time stay, half of the room at most."""
        if len(self.keys) > self.max_chunks:
            stay = np.flatnonzero(self.met)[: self.max_chunks // 2]
            keys, ids, count = self.keys.take(pa.array(stay)), self.pool[runs(self.at[stay], self.count[stay])], self.count[stay]
            self.keys, self.met = pa.array([], pa.binary()), np.zeros(0, bool)
            self.pool, self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
            self._add(keys, ids, count)
            self.met[:] = False

    def encode(self, column: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text."""
        data, bounds = bytes_of(pa.array(column, pa.string()) if isinstance(column, list) else column)
        starts = self.starts(data, bounds)
        place = self.places(data, starts)
        n_ids = self.count[place]
        ids = self.pool[runs(self.at[place], n_ids)]
        upto = np.concatenate([[0], np.cumsum(n_ids)])
        per_text = np.diff(upto[np.searchsorted(starts, bounds)])
        self._forget()
        return ids, per_text


class ChunkEncoder(ChunkTable):
    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, special: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(max_chunks)
        added = added_tokens(path)
        self.special = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if special and added else None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Each character of a token's name stands for one byte; added tokens stand for themselves.
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if token.encode() in added else len(token)

        # A single match of the pattern needs no pattern: line feeds part such words, their bytes named as in tokens.
        self.parted = Tokenizer.from_file(path)
        self.parted.encode_special_tokens = not special
        self.parted.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.named = np.zeros(256, np.uint32)
        self.named[[i for i in range(256) if i not in shown]] = 0x100 + np.arange(256 - len(shown))
        self.named[shown] = shown

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        texts = bounds[:-1][np.diff(bounds) > 0]
        begins, ends = occurrences(data, bounds, self.special) if self.special else ([], [])
        if not begins:
            return chunk_starts(data, texts)
        begins, ends = np.array(begins), np.array(ends)
        found = chunk_starts(data, np.unique(np.concatenate([texts, begins, ends[ends < len(data)]])))
        inside = found > begins[np.maximum(np.searchsorted(begins, found, "right") - 1, 0)]
        inside &= found < ends[np.maximum(np.searchsorted(begins, found, "right") - 1, 0)]
        return found[~inside]

    def spelled(self) -> list[bytes]:
        """The bytes of each id, by id."""
        byte = {chr(c): b for b, c in enumerate(self.named.tolist())}
        out = [b""] * len(self.n_bytes)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out

    def encode_chunks(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Single words, then chunks that may follow one another (each kind as one text), then all others."""
        data = np.frombuffer(b"".join(keys), np.uint8)
        n = np.fromiter(map(len, keys), np.int64, len(keys))
        last = np.cumsum(n) - 1
        first = last - n + 1
        kinds = classes(data)
        spaced = kinds[first] == SPACE
        head = np.where(spaced, np.minimum(first + 1, last), first)
        words = _alike(data, kinds, first, head)
        joined = _SOLID[kinds[head]] & _SOLID[kinds[last]] & ~words
        counts = np.zeros(len(keys), np.int64)
        found = []
        where = np.flatnonzero(words)
        if len(where):
            text = np.full(n[where].sum() + len(where), 0x0A, np.uint32)
            text[np.repeat(np.arange(len(where)), n[where]) + np.arange(n[where].sum())] = self.named[data[runs(first[where], n[where])]]
            found.append((where, self._split(self.parted, text.tobytes().decode("utf-32-le"), n[where], np.zeros(len(where), np.int64), counts, where)))
        where = np.flatnonzero(joined)
        if len(where):
            feeds = (~spaced[where]).astype(np.int64)
            text = b"".join([b"\n" + keys[i] if f else keys[i] for i, f in zip(where.tolist(), feeds.tolist())]).decode()
            found.append((where, self._split(self.tokenizer, text, n[where] + feeds, feeds, counts, where)))
        where = np.flatnonzero(~(joined | words))
        if len(where):
            got = self.tokenizer.encode_batch_fast([keys[i].decode() for i in where.tolist()], add_special_tokens=False)
            counts[where] = [len(e.ids) for e in got]
            found.append((where, np.fromiter(chain.from_iterable(e.ids for e in got), np.int32)))
        return in_order(found, counts), counts

    def _split(self, tokenizer, text: str, n_bytes: np.ndarray, skip: np.ndarray, counts: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Ids of one text without the first ``skip`` of each run of ``n_bytes``; sets the runs' counts."""
        flat = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        bytes_to, stop = np.cumsum(self.n_bytes[flat]), np.cumsum(n_bytes)
        ends = np.searchsorted(bytes_to, stop)
        assert (bytes_to[ends] == stop).all(), "a token crosses two chunks"
        begin = np.concatenate([[0], ends[:-1] + 1]) + skip
        counts[where] = ends + 1 - begin
        return flat[runs(begin, counts[where])]


def _alike(data: np.ndarray, kinds: np.ndarray, first: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether a chunk, but for one space before it, has only letters (ASCII, Latin-1), only digits or only punctuation."""
    kinds = kinds.copy()
    lead = np.flatnonzero(data[:-1] == 0xC3)
    letter = (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)  # not the signs of multiplication and division
    kinds[lead[letter]] = kinds[lead[letter] + 1] = LETTER
    kinds[first] = kinds[head]
    least, most = np.minimum.reduceat(kinds, first), np.maximum.reduceat(kinds, first)
    return (least == most) & (least >= LETTER) & (least <= MARK)


def in_order(found: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> np.ndarray:
    """Runs of ``counts`` ids, given in parts (which runs, their ids), one after another."""
    out = np.empty(counts.sum(), np.int32)
    at = np.cumsum(counts) - counts
    for index, ids in found:
        out[runs(at[index], counts[index])] = ids
    return out


def by_size(lengths: list[int], most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``most`` bytes (or characters)."""
    start = n = 0
    for i, length in enumerate(lengths):
        n += length
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def by_text(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold about BYTES_AT_ONCE bytes of the text in ``column``."""
    for a, b in by_size(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        yield batch.slice(a, b - a)
    release_memory()
