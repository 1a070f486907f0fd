"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  They are found with array operations over the
bytes of a batch; each distinct word of a batch is hashed once, and shingles are mixed from the hashes
of their words.  With fewer than ``n_words`` words the whole sequence is the one shingle; without words
there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .chunk_encoder import bytes_of, distinct

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the first word of each text and beyond the last."""
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    at = bounds[:-1][np.diff(bounds) > 0]
    begins[at] = letter[at]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    # White space goes; a word then ends where the next one begins.
    words, index = distinct(_LOWER[data[letter]], np.cumsum(letter)[starts] - 1)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    return hashes[index], firsts


def _rolled(h: np.ndarray, starts: np.ndarray | None, width: int) -> np.ndarray:
    """The shingles of ``width`` words from each of ``starts`` (from every word where it is None)."""
    n = len(h) - width + 1 if starts is None else len(starts)
    out = np.full(max(n, 0), width, np.uint64)
    for i in range(width):
        part = h[i : i + n] if starts is None else h[starts + i]
        out = _mix(out + part * np.uint64(_ODD[i % 4] + 2 * (i // 4)))
    return out


def shingle_sets(texts: pa.Array, n_words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    h, firsts = _word_hashes(*bytes_of(texts))
    rolled = _rolled(h, None, n_words)
    counts = np.diff(firsts)
    out = [np.unique(rolled[a : a + n - n_words + 1]) if n >= n_words else np.zeros(0, np.uint64) for a, n in zip(firsts.tolist(), counts.tolist())]
    for width in range(1, n_words):
        short = np.flatnonzero(counts == width)
        for i, value in zip(short.tolist(), _rolled(h, firsts[short], width)):
            out[i] = np.array([value], np.uint64)
    return out


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    return shingle_sets(pa.array([text or ""]), n_words)[0]
