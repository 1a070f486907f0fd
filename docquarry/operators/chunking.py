"""Splitting pages into linked parent and child chunks."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.ids import uuid5
from docquarry.functions.parts import of_text

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
PARENT, CHILD = (2000, 200), (500, 100)
#: Namespace of chunk identifiers; a parameter of every function that makes some.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "docquarry.chunks")
_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, with overlap.

    A separator stays at the start of the piece behind it.  Pieces are trimmed, blank ones left out.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator = separators[at]
    if separator:
        parts = text.split(separator)
        parts = [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    window: deque[str] = deque()
    length = 0

    def emit() -> None:
        piece = "".join(window).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            emit()
            window, length = deque(), 0
            out += split_text(part, size, overlap, separators[at + 1 :])
            continue
        if length + len(part) > size:
            emit()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.popleft())
        window.append(part)
        length += len(part)
    emit()
    return out


def splitter(size: int, overlap: int):
    """A column function text -> array of pieces."""
    return of_text(lambda t: split_text(t or "", size, overlap), "array<string>")


@F.udtf(returnType="position int, piece string")
class SplitChunks:
    """A row for each piece of a text, for SQL: ``FROM docs, LATERAL split_chunks(text, 500, 100)``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text or "", size, overlap))


def register_functions(spark: SparkSession) -> None:
    """Make ``split_chunks`` known to the session's SQL."""
    spark.udtf.register("split_chunks", SplitChunks)


def split_headings(markdown: str) -> list[tuple[str, dict[str, str]]]:
    """(text, heading chain) of the sections under each heading; headings stay in the text.

    Headings inside code fences are text.  Sections without any words are left out.
    """
    out: list[tuple[str, dict[str, str]]] = []
    chain: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""

    def close() -> None:
        text = "\n".join(lines).strip()
        if text:
            out.append((text, {f"Header-{level}": title for level, title in chain}))
        lines.clear()

    for line in markdown.split("\n"):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = "" if fence == mark else fence or mark
        heading = None if fence else _HEADING.match(line)
        if heading:
            close()
            level = len(heading[1])
            chain = [c for c in chain if c[0] < level] + [(level, heading[2])]
        lines.append(line)
    close()
    return out


def heading_sections(pages: DataFrame, *, key: str = "document_id", version: str = "v1", text: str = "text", namespace: uuid.UUID = NAMESPACE) -> DataFrame:
    """Sections as pages of their own: doc_id, page (from 1), text, headers; other columns stay."""
    sections = lambda x: [{"text": t, "headers": list(h.items())} for t, h in split_headings(x or "")]
    split = of_text(sections, "array<struct<text:string,headers:map<string,string>>>")
    kept = [c for c in pages.columns if c not in (text, "page", "doc_id", "headers")]
    parts = pages.select(*kept, F.posexplode(split(F.col(text))).alias("pos", "part"))
    doc_id = uuid5(namespace, F.concat_ws("_", F.col(key), F.lit(version), F.col("pos")))
    return parts.select(*kept, doc_id.alias("doc_id"), (F.col("pos") + 1).alias("page"), F.col("part.text").alias(text), F.col("part.headers").alias("headers"))


def parents_of(pages: DataFrame, *, size: int = PARENT[0], overlap: int = PARENT[1], namespace: uuid.UUID = NAMESPACE) -> DataFrame:
    """source, page, doc_id, text.  Tabular pages and pages that have a doc_id are not cut."""
    columns = set(pages.columns)
    whole = F.lit(False)
    if "is_tabular" in columns:
        whole = whole | F.coalesce("is_tabular", F.lit(False))
    if "doc_id" in columns:
        whole = whole | F.col("doc_id").isNotNull()
    pieces = F.when(whole, F.array("text")).otherwise(splitter(size, overlap)(F.col("text")))
    extra = [c for c in pages.columns if c not in ("text", "doc_id", "source", "page")]
    known = F.col("doc_id") if "doc_id" in columns else F.lit(None).cast("string")
    parts = pages.select("source", "page", *extra, known.alias("known"), F.posexplode(pieces).alias("piece", "text"))
    made = uuid5(namespace, F.concat_ws("_", "source", "page", *(["row_range"] if "row_range" in columns else []), "piece"))
    return parts.filter(F.trim("text") != "").select("source", "page", *extra, F.coalesce("known", made).alias("doc_id"), "text")


def children_of(parents: DataFrame, *, size: int = CHILD[0], overlap: int = CHILD[1], namespace: uuid.UUID = NAMESPACE) -> DataFrame:
    """Children keep their parent's doc_id and get a chunk_id made of it and their number."""
    parts = parents.select(*[c for c in parents.columns if c != "text"], F.posexplode(splitter(size, overlap)(F.col("text"))).alias("chunk_order", "text"))
    return parts.withColumn("chunk_id", uuid5(namespace, F.concat_ws("_", "doc_id", "chunk_order")))


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    return children.join(parents, "doc_id", "left_anti")


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children joined to their parents' text; a child without a parent is an error."""
    if not orphans(children, parents).isEmpty():
        raise ValueError("a child chunk has no parent")
    return children.join(parents.select("doc_id", F.col("text").alias("parent_text")), "doc_id")


def batches(chunks: DataFrame, order: Column, size: int, key: str) -> DataFrame:
    """Number chunks within ``key`` and put ``size`` in a batch."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return chunks.withColumn("chunk_order", n - 1).withColumn("batch", F.floor((n - 1) / size))
