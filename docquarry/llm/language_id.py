"""Language identification by cross-parsing.

A language's model is the suffix automaton of a bounded sample of text labelled with it.  A text
is parsed against it greedily: each phrase is the longest match from where the last one ended.
The number of phrases, times the logarithm of the sample's length, per symbol of the text
estimates the cross entropy; the language with the fewest normalised phrases wins.

Symbols are lower-case letters (all of the samples; one symbol for letters that no sample has) and one
separator for each run of anything else.  If ``n_symbols`` is given, only the ``n_symbols - 2`` most
frequent letters are told apart.  Transitions are kept sparse, so many scripts cost little.  Whole texts are parsed, in segments
of ``SEGMENT`` symbols side by side: a phrase ends at a segment's end, in every language alike.

Training reads only text and language of labelled rows with a letter.  Bounds, both parameters:
``train_rows`` rows a language (chosen by a hash of the identifier, those of ``prefer_lengths``
characters before shorter and longer ones) and ``train_chars`` symbols a language, reached with whole
rows; only of a longer row no more than that is taken.  So every labelled language is learned.

Rows with one identifier and one text are learned once, rows without identifier like others (by a hash of
their text), however many they are: the bounds hold for any identifiers.

Defined results: ``und`` with score 0 where the text is null, has no letter or no language could be
learned; ties go to the language whose name sorts first; repeated rows get a row each; an empty table
gives no rows; very long texts are parsed whole.  Other columns are not read; ``keep_identified`` keeps
them, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .chunk_encoder import by_size
from .shared import fresh_name, release_memory

SEGMENT = 512
#: Texts of about so many characters are parsed side by side.
CHARS_AT_ONCE = 1_000_000
PREFER_LENGTHS = (100, 20_000)
#: A letter to Java; what its Unicode version does not know yet is left for Python to decide.
_LETTER = r"\p{L}\p{Cn}"
RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixAutomaton:
    """Transitions of each state, next state by symbol; state 1 is the root."""

    def __init__(self, symbols: list[int], n_symbols: int) -> None:
        follow: list[dict[int, int]] = [{}, {}]
        link, longest, last = [0, 0], [0, 0], 1
        for c in symbols:
            follow.append({})
            link.append(1)
            longest.append(longest[last] + 1)
            new, p = len(follow) - 1, last
            while p and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p:
                q = follow[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    longest.append(longest[p] + 1)
                    copy = len(follow) - 1
                    while p and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.follow, self.n_symbols = follow, n_symbols

    @property
    def table(self) -> np.ndarray:
        """States as rows: next state by symbol, 0 for none."""
        table = np.zeros((len(self.follow), self.n_symbols), np.int32)
        for state, to in enumerate(self.follow):
            for c, n in to.items():
                table[state, c] = n
        return table


def combed(automata: list[list[dict[int, int]]], n_symbols: int) -> tuple[np.ndarray, list[int]]:
    """Transitions of all automata in one array of (next state, owner), and the states of the roots.

    A state is the place where its transitions begin, no two share one; that on symbol c is held c
    places on, and is the state's own only if it is the owner.  State 0 is none.
    """
    states = [(k, i) for k, follow in enumerate(automata) for i in range(1, len(follow))]
    states.sort(key=lambda x: -len(automata[x[0]][x[1]]))
    room = 2 * sum(len(automata[k][i]) for k, i in states) + len(states) + n_symbols
    used, taken, draw = bytearray(room + n_symbols), bytearray(room + n_symbols), random.Random(0).random
    place = [[0] * len(follow) for follow in automata]
    for k, i in states:
        to = automata[k][i]
        for _ in range(200):
            at = 1 + int(draw() * (room - 1))
            if not taken[at] and not any(used[at + c] for c in to):
                break
        else:  # a crowded array grows
            at = room
            used += bytes(n_symbols)
            taken += bytes(n_symbols)
            room += n_symbols
        taken[at], place[k][i] = 1, at
        for c in to:
            used[at + c] = 1
    out = np.zeros((len(used), 2), np.int32)
    for follow, own in zip(automata, place, strict=True):
        for i in range(1, len(follow)):
            for c, n in follow[i].items():
                out[own[i] + c] = own[n], own[i]
    return out, [own[1] for own in place]


class CrossParser:
    """The automata of all languages in one array."""

    def __init__(self, samples: dict[str, list[str]], train_chars: int, n_symbols: int | None = None) -> None:
        self.langs = sorted(samples)
        counts = np.zeros(0x110000, np.int64)
        for texts in samples.values():
            for t in texts:
                counts += np.bincount(code_points(t), minlength=0x110000)
        counts[~_letters()] = 0
        known = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)][: None if n_symbols is None else n_symbols - 2]
        n_symbols = len(known) + 2
        #: Symbol 0: separator; 1: a letter that is not among the known ones.
        self.symbol = _letters().astype(np.min_scalar_type(n_symbols))
        self.symbol[known] = np.arange(2, n_symbols)
        automata, bits = [], []
        for lang in self.langs:
            sample: list[int] = []
            for t in samples[lang]:
                if len(sample) >= train_chars:
                    break
                sample += self._symbols([t])[0].tolist() + [0]
            automata.append(SuffixAutomaton(sample, n_symbols).follow)
            bits.append(np.log2(len(sample) + 2))
        steps, roots = combed(automata, n_symbols)
        self.steps = steps.view(np.int64).reshape(-1)  # both numbers are fetched at once
        self.roots = np.array(roots, np.int32).reshape(-1, 1)
        first = steps[self.roots + np.arange(n_symbols)]
        #: By language and symbol: whether the sample has it, and the state after a phrase ended before it.
        self.seen = (first[..., 1] == self.roots).reshape(-1)
        self.restart = np.where(self.seen, first[..., 0].reshape(-1), np.repeat(self.roots, n_symbols))
        self.row = (np.arange(len(self.langs), dtype=np.int32) * n_symbols).reshape(-1, 1)
        self.bits = np.array(bits)

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with runs of separators made one; symbols and letters per text."""
        points = [code_points(t) for t in texts]
        owner = np.repeat(np.arange(len(points)), [len(p) for p in points])
        s = self.symbol[np.concatenate(points)] if points else np.zeros(0, self.symbol.dtype)
        again = np.zeros(len(s), bool)
        again[1:] = (s[1:] == 0) & (s[:-1] == 0) & (owner[1:] == owner[:-1])
        s, owner = s[~again], owner[~again]
        return s, np.bincount(owner, minlength=len(texts)), np.bincount(owner, s > 0, len(texts))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by language and text; the number of letters of each text."""
        symbols, n, letters = self._symbols(texts)
        ends = np.cumsum(n)
        n_segments = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n_segments)
        start = (ends - n)[owner] + SEGMENT * (np.arange(len(owner)) - (np.cumsum(n_segments) - n_segments)[owner])
        length = np.minimum(SEGMENT, ends[owner] - start)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
        state = np.repeat(self.roots, len(owner), 1)
        phrases = np.ones(state.shape, np.int32)
        for t, m in enumerate(active.tolist()):
            s = symbols[start[:m] + t].astype(np.int32)
            now, at = state[:, :m], self.row + s
            step = self.steps.take(now + s).view(np.int32).reshape(len(now), m, 2)
            miss = step[..., 1] != now
            phrases[:, :m] += miss
            phrases[:, :m] += ~self.seen.take(at)
            state[:, :m] = np.where(miss, self.restart.take(at), step[..., 0])
        total = np.stack([np.bincount(owner, p, len(texts)) for p in phrases]) if len(self.langs) else np.zeros((0, len(texts)))
        return total * self.bits.reshape(-1, 1) / np.maximum(n, 1), letters

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        filled = [t or "" for t in texts]
        if not self.langs:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
        bits, letters = self.entropies(filled)
        best = bits.argmin(0)
        weights = np.exp2(bits.min(0) - bits)
        known = letters > 0
        return pd.DataFrame({"lang": np.where(known, np.array(self.langs, object)[best], "und"), "score": np.where(known, 1 / weights.sum(0), 0.0)})


def training_rows(
    docs: DataFrame, usable: Column, train_rows: int, train_chars: int, prefer_lengths: tuple[int, int], id_col: str, text_col: str, lang_col: str,
) -> dict[str, list[str]]:
    """Texts by language of at most ``train_rows`` labelled rows each, preferred lengths first, then in the order of a hash.

    Runs of other characters than letters, which are one symbol, become one space before a text is cut.
    """
    key, lang, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    fit = docs.filter(usable & lang.isNotNull() & text.rlike(f"[{_LETTER}]"))
    cut = F.substring(F.regexp_replace(text, f"[^{_LETTER}]+", " "), 1, train_chars)
    names = {"lang": lang, "odd": ~F.length(text).between(*prefer_lengths), "hash": F.xxhash64(F.col(f"`{id_col}`")), "key": key, "text_hash": F.xxhash64(text)}
    slim = fit.select(*[c.alias(name) for name, c in names.items()]).distinct()  # copies of a row count once
    order = Window.partitionBy("lang").orderBy("odd", "hash", "key", "text_hash")
    chosen = slim.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= train_rows).drop("rank")
    rows = fit.select(*[c.alias(name) for name, c in names.items()], cut.alias("text"))
    same = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in names])
    picked = rows.alias("r").join(F.broadcast(chosen).alias("c"), same, "left_semi")  # train_rows a language
    rows = picked.groupBy(*names).agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["odd"], r["hash"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fit(
    docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    train_rows: int = 100, train_chars: int = 20_000, prefer_lengths: tuple[int, int] = PREFER_LENGTHS, n_symbols: int | None = None,
) -> CrossParser:
    samples = training_rows(docs, usable, train_rows, train_chars, prefer_lengths, id_col, text_col, lang_col)
    return CrossParser(samples, train_chars, n_symbols)


def predictor(spark, model: CrossParser):
    """A column function text -> (lang, score).  The model's size is bounded by the training bounds."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            every = texts.tolist()
            parts = [held.value.predict(every[a:b]) for a, b in by_size([len(t or '') for t in every], CHARS_AT_ONCE)]
            release_memory()
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never trained on: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    model = fit(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    predict = predictor(docs.sparkSession, model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(f"`{text_col}`").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """``docs`` without the rows that come out as ``und``; a null language is filled with the prediction."""
    model = fit(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    predict = predictor(docs.sparkSession, model)
    p = fresh_name("p", docs)
    rows = docs.withColumn(p, predict(F.col(f"`{text_col}`").cast("string"))).filter(F.col(p)["lang"] != "und")
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.col(p)["lang"]).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
