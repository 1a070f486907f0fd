"""Vector arithmetic on array columns."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up in doubles from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector of length zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def hash_embedder(dim: int = 64) -> Embedder:
    """Deterministic stand-in for a model: signed feature hashing of words, unit length."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % dim] += 1 if h >> 63 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).astype(np.float32).tolist()

    return embed


class HttpError(Exception):
    """An answer with a status other than success; embedders that call a service raise it."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def retried(call: Callable[[list[str]], list[list[float]]], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """The call, again after server errors (5xx), time-outs and broken connections, at most ``retries`` times.

    It waits a quarter of a second more each time, one second at most; other errors end it at once.
    """
    def run(texts: list[str]) -> list[list[float]]:
        for attempt in range(1, retries + 2):
            try:
                return call(texts)
            except (HttpError, TimeoutError, ConnectionError) as e:
                if attempt > retries or isinstance(e, HttpError) and e.status < 500:
                    raise
                sleep(min(0.25 * attempt, 1.0))
        raise AssertionError

    return run


def embed(text: Column, embedder: Embedder | None = None, batch: int = 32, retries: int = 2) -> Column:
    """Vectors of texts by a pluggable embedder, ``batch`` texts a call, in Arrow batches; calls are retried."""
    model = retried(embedder, retries) if embedder else hash_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            every, out = texts.tolist(), []
            for k in range(0, len(every), batch):
                got = model(every[k : k + batch])
                if len(got) != len(every[k : k + batch]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                out += got
            yield pd.Series(out, dtype=object)

    return run(text)
