"""Files as documents: dispatch by extension, Markdown, DOCX, PDF hooks, validation, settings files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import mask, sanitize_markdown, strip

MAX_BYTES = 50 * 1024 * 1024
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: (bytes of one page, page number) -> text.  Nothing is built in for pictures of text.
Ocr = Callable[[bytes, int], str]
#: bytes of a file -> pages as dicts with the columns of PAGES.
PdfReader = Callable[[bytes], list[dict]]
PAGES = "source string, page int, markdown string, raw string, images array<struct<w:double,h:double>>, drawings int, blocks array<struct<x0:double,y0:double,x1:double,y1:double>>"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def is_valid(name: Column, content: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """The size is in bounds and the content begins as its extension demands."""
    head, ext = F.substring(content, 1, 4), extension(name)
    starts = F.when(ext == "pdf", head == F.lit(b"%PDF")).when(ext.isin("docx", "xlsx"), head == F.lit(b"PK\x03\x04")).when(ext.isin("html", "htm", "md", "csv"), ~F.hex(head).startswith("25504446") & ~F.hex(head).startswith("504B0304"))
    return (size > 0) & (size <= most) & F.coalesce(starts, F.lit(False))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source, text of Markdown files, sanitized; empty ones are left out."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), sanitize_markdown(F.regexp_replace("value", "^﻿", "")).alias("text"))
    return pages.filter("text <> ''")


def docx_markdown(content: bytes) -> str:
    """Paragraphs, headings and tables of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_WORD}body")
    out = []
    words = lambda el: "".join(t.text or "" for t in el.iter(f"{_WORD}t"))
    for el in body:
        if el.tag == f"{_WORD}tbl":
            rows = [[words(c) for c in r.iter(f"{_WORD}tc")] for r in el.iter(f"{_WORD}tr")]
            if rows:
                bar = lambda cells: "| " + " | ".join(cells) + " |"
                out.append("\n".join([bar(rows[0]), bar(["---"] * len(rows[0])), *map(bar, rows[1:])]))
        elif el.tag == f"{_WORD}p" and words(el).strip():
            style = next((s.get(f"{_WORD}val") or "" for s in el.iter(f"{_WORD}pStyle")), "")
            level = int(style[-1]) if style.lower().startswith("heading") and style[-1].isdigit() else 0
            out.append("#" * level + " " * bool(level) + words(el).strip())
    return "\n\n".join(out)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """source, text of Word files; files that are none give null."""
    @F.pandas_udf("string")
    def convert(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: docx_markdown(c) if bytes(c[:4]) == b"PK\x03\x04" else None)

    return files(spark, path, "*.docx").select(F.col("path").alias("source"), convert("content").alias("text"))


def pdf_pages(spark: SparkSession, path: str, reader: PdfReader) -> DataFrame:
    """Page records of PDF files by a pluggable reader, a file per row of a task; what it leaves out is null."""
    names = re.findall(r"(?:^|, )(\w+) ", PAGES)

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([{**dict.fromkeys(names), "source": source, **page} for page in reader(content)], columns=names)

    return files(spark, path, "*.pdf").select("path", "content").mapInPandas(pages, PAGES)


def is_complex(images: Column, drawings: Column, text: Column) -> Column:
    """A picture over 50 x 50, 15 drawings or more, or over 3 mathematical signs."""
    signs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[∑∏∫√∞≈≠≤≥±∂∇∈∉⊂⊆∪∩∀∃αβγδεθλμπσφω]"))
    return F.coalesce(F.exists(images, lambda i: (i["w"] > 50) & (i["h"] > 50)), F.lit(False)) | (F.coalesce(drawings, F.lit(0)) >= 15) | (signs > 3)


def content_box(blocks: Column, width: Column, height: Column, padding: float = 10.0) -> Column:
    """The hull of a page's blocks, padded and clipped to the page; the page where there is none."""
    side = lambda f, pick: f(F.transform(blocks, pick))
    hull = F.struct(
        F.greatest(F.lit(0.0), side(F.array_min, lambda b: b["x0"]) - padding).alias("x0"), F.greatest(F.lit(0.0), side(F.array_min, lambda b: b["y0"]) - padding).alias("y0"),
        F.least(width, side(F.array_max, lambda b: b["x1"]) + padding).alias("x1"), F.least(height, side(F.array_max, lambda b: b["y1"]) + padding).alias("y1"),
    )
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), width.alias("x1"), height.alias("y1"))
    return F.when(F.size(blocks) > 0, hull).otherwise(page)


def scaled(width: Column, height: Column, longest: int = 1500) -> Column:
    """Size of a picture whose longer edge is at most ``longest``."""
    factor = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct((width * factor).cast("int").alias("w"), (height * factor).cast("int").alias("h"))


def parsed_pages(pages: DataFrame, ocr: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """source, page, text: simple pages from their Markdown or raw text; complex ones from OCR first.

    ``ocr`` maps complex pages to (source, page, ocr); empty and missing results fall back.
    """
    flagged = pages.withColumn("complex", is_complex(F.col("images"), F.col("drawings"), F.col("raw")))
    if ocr is None:
        found = flagged.withColumn("ocr", F.lit(None).cast("string"))
    else:
        found = flagged.join(ocr(flagged.filter("complex")), ["source", "page"], "left")
    text = sanitize_markdown(F.coalesce(F.nullif("ocr", F.lit("")), F.nullif("markdown", F.lit("")), "raw"))
    return found.select("source", "page", text.alias("text")).filter("text <> ''")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value, sensitive of a settings file; secrets are masked.  (Spark skips names that begin with a dot.)"""
    lines = spark.read.text(path).filter(~strip(F.col("value")).rlike(r"^(#|$)") & F.col("value").contains("="))
    key, value = strip(F.substring_index("value", "=", 1)), strip(F.regexp_replace("value", r"^[^=]*=", ""))
    secret = key.rlike(r"(?i)(key|secret|password|token)")
    return lines.select(key.alias("key"), F.when(secret, mask(value)).otherwise(value).alias("value"), secret.alias("sensitive"))


def url_is_safe(url: Column, most: int = 2048) -> Column:
    """http(s), a host, no credentials, not too long, and no private or local address."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#@]+)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|.*\.local$)|^\[")
    return F.coalesce((F.length(url) <= most) & (host != "") & ~url.rlike(r"^https?://[^/]*@") & ~private, F.lit(False))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"md": read_markdown, "docx": read_docx}


def read(spark: SparkSession, path: str, pdf_reader: PdfReader | None = None) -> DataFrame:
    """source, text (and what else the reader gives) by the path's extension."""
    from .html import html_text, read_html
    from .ranges import read_xlsx
    from .tabular import pages_of, read_csv, sheet_pages

    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("html", "htm"):
        return read_html(spark, path).select("source", html_text(F.col("html")).alias("text"))
    if ext == "csv":
        return pages_of(read_csv(spark, path), path)
    if ext == "xlsx":
        return sheet_pages(read_xlsx(spark, path))
    if ext == "pdf":
        if pdf_reader is None:
            raise ValueError("reading .pdf takes a reader")
        return parsed_pages(pdf_pages(spark, path, pdf_reader))
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}")
    return READERS[ext](spark, path)
