"""CSV and XLSX files as typed tables and as text pages."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from docquarry.functions.text import quote_identifier, strip
from docquarry.shared_files import stored

BLOCK_ROWS, WIDE, HEADER_ROWS, HEADER_SHARE, ROW_SHARE, NUMERIC_SHARE = 15, 15, 20, 0.5, 0.3, 0.8
NUMBER = r"^\d+(\.\d+)?$"


def safe_name(name: str, taken: set[str] | None = None) -> str:
    """Letters, digits and single underscores; a name that is taken gets a number."""
    plain = "".join(c for c in unicodedata.normalize("NFD", str(name)) if unicodedata.category(c) != "Mn")
    base = re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9]", "_", plain.strip())).strip("_") or "col"
    out, n = base, 1
    while taken is not None and out.lower() in taken:
        out, n = f"{base}_{n}", n + 1
    if taken is not None:
        taken.add(out.lower())
    return out


def table_name(document_id: str, sheet: str, prefix: str = "etbl", longest: int = 63) -> str:
    return f"{prefix}_{document_id[:8]}_{safe_name(sheet)[: longest - 12].strip('_')}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, under safe names, with ``_row_idx`` by file and place in it.

    Files are read as Spark splits them, in many tasks, whatever stands in quotes: see ``csv_records``.  Rows of one line are
    parsed where they are read; only records of several lines are put together by a shuffle.
    """
    records = csv_records(spark, path)
    first = records.filter("record = 0").orderBy("file").first()
    if first is None:
        return spark.createDataFrame([], "_row_idx long")
    options = {"escape": '"', "quote": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = _header(first["text"])
    taken: set[str] = {"_row_idx", "_file", "_at", "row_idx", "batch"}
    safe = [safe_name(n, taken) for n in names]
    sizes = records.groupBy("file").agg((F.count("*") - 1).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", before.alias("before"))  # one row per file
    schema = ", ".join(f"c{i} string" for i in range(len(safe)))
    parsed = records.filter("record > 0").join(F.broadcast(offsets), "file").select((F.col("before") + F.col("record") - 1).alias("_row_idx"), F.from_csv("text", schema, options).alias("row"))
    return parsed.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(safe)], "_row_idx")


def _header(line: str) -> list[str]:
    """The names of the columns; one without a name is called by its place."""
    return [name or f"_c{i}" for i, name in enumerate(next(csv.reader([line])))]


#: A field in quotes that ends (a quote in it is doubled), at the beginning of a line or behind a comma.
_QUOTED = r'(?s)(^|,)"(?:[^"]|"")*"(?=,|$)'
_OPEN = r'(?s)(^|,)"'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0 in each file, the header included), text of the records of CSV files, read in parallel.

    Spark cuts files into splits and those into lines, some of which begin inside of quotes.  What a line does is a
    function of two values: whether quotes are open behind it if they are closed before it, and if they are open.
    The functions of a split's lines are put together, those of a file's splits (a row each) in a second step; then
    every line knows how it begins.  Empty lines outside of quotes are no records.  A quote inside a field
    that does not begin with one is a character like others.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), F.col("value").alias("whole"),
    )
    ends_open = lambda text: F.regexp_replace(text, _QUOTED, "$1").rlike(_OPEN)
    quoted = F.col("line").contains('"')
    lines = lines.withColumn("closed", F.when(quoted, ends_open(F.col("line"))).otherwise(F.lit(False))).withColumn("open", F.when(quoted, ends_open(F.concat(F.lit('"'), "line"))).otherwise(F.lit(True)))
    lines = stored(lines, "csv-lines")

    inside = Window.partitionBy("file", "split").orderBy("at")
    lines = _starts(lines, inside)
    filled = F.col("line") != ""
    counts = lambda began: F.count_if(filled & ~F.col(began)).alias(f"n_{began}")
    last = lambda c: F.max_by(F.when(F.col(c), F.col("open")).otherwise(F.col("closed")), "at")
    splits = lines.groupBy("file", "split").agg(counts("if_closed"), counts("if_open"), last("if_closed").alias("closed"), last("if_open").alias("open"))
    by_file = Window.partitionBy("file").orderBy("split")
    splits = _starts(splits, by_file).withColumn("n", F.when(F.col("if_closed"), F.col("n_if_open")).otherwise(F.col("n_if_closed")))
    ahead = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", F.col("if_closed").alias("begins_open"), ahead.alias("ahead"))  # a row for each split

    lines = lines.join(F.broadcast(splits), ["file", "split"])
    began_open = F.when(F.col("begins_open"), F.col("if_open")).otherwise(F.col("if_closed"))
    lines = lines.withColumn("began_open", began_open).withColumn("ended_open", F.when(began_open, F.col("open")).otherwise(F.col("closed")))
    starts = ~F.col("began_open") & filled
    number = F.col("ahead") + F.sum(starts.cast("long")).over(inside) - 1
    lines = lines.filter(starts | F.col("began_open")).select("file", number.alias("record"), "split", "at", "line", "whole", "began_open", "ended_open")
    alone = lines.filter(~F.col("began_open") & ~F.col("ended_open")).select("file", "record", F.col("line").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "whole")))
    joined = lines.filter("began_open OR ended_open").groupBy("file", "record").agg(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["whole"]), "\n"), "^\ufeff|\r$", "").alias("text"))
    return alone.unionByName(joined)


def _starts(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """With if_closed, if_open: whether quotes are open before a row, if they were closed (open) before the first row of its window.

    A row that ends alike however it begins (``closed`` = ``open``) settles what comes behind it, but for rows that turn
    one into the other; all others change nothing.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turns", F.sum((F.col("closed") & ~F.col("open")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.when(F.col("closed") == F.col("open"), F.struct(F.col("closed").cast("int").alias("value"), "turns"))
    rows = rows.withColumns({"settled": F.last(same, True).over(before), "turned": F.coalesce(F.max("turns").over(before), F.lit(0))})
    now = lambda first: (F.coalesce(F.col("settled.value") + F.col("turned") - F.col("settled.turns"), F.col("turned") + first) % 2) == 1
    return rows.withColumns({"if_closed": now(0), "if_open": now(1)}).drop("turns", "settled", "turned")


def filled(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")) != "", F.lit(False))


def header_row(cells: DataFrame, n_columns: int) -> int:
    """The first of the leading rows with enough filled cells; ``cells`` has row and value."""
    counts = cells.filter(F.col("row") < HEADER_ROWS).groupBy("row").agg(F.count_if(filled(F.col("value"))).alias("n"))
    found = counts.filter(F.col("n") >= n_columns * HEADER_SHARE).agg(F.min("row")).first()[0]
    return found or 0


def good_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least 30 % (and one) of the cells filled."""
    n = sum((filled(F.col(quote_identifier(c))).cast("int") for c in columns), F.lit(0))
    return table.filter(n >= max(1, int(len(columns) * ROW_SHARE)))


def typed(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of which over 80 % are plain digits become long or double, in one pass for the shares."""
    if not columns:
        return table
    tests = []
    for c in columns:
        text = F.coalesce(F.col(quote_identifier(c)).cast("string"), F.lit(""))
        tests += [F.avg(text.rlike(NUMBER).cast("int")).alias(f"{c}.n"), F.max(text.rlike(r"\.").cast("int")).alias(f"{c}.f")]
    found = table.agg(*tests).first()
    casts = {c: F.col(quote_identifier(c)).try_cast("double" if found[f"{c}.f"] else "long") for c in columns if (found[f"{c}.n"] or 0) > NUMERIC_SHARE}
    return table.withColumns(casts) if casts else table


def with_search_text(table: DataFrame, columns: list[str]) -> DataFrame:
    """``search_text``: the filled, trimmed cells of a row joined by spaces."""
    cells = [F.when(filled(F.col(quote_identifier(c))), strip(F.col(quote_identifier(c)).cast("string"))) for c in columns]
    return table.withColumn("search_text", F.concat_ws(" ", *cells))


def ingest(table: DataFrame) -> DataFrame:
    """A table of text columns with ``_row_idx`` as the typed table that questions run on."""
    columns = [c for c in table.columns if c != "_row_idx"]
    return with_search_text(typed(good_rows(table, columns), columns), columns)


def row_text(columns: list[str]) -> Column:
    """A row as ``| a | b |``, or ``- name: value | …`` for wide tables."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(quote_identifier(c)).cast("string"), F.lit("|"), F.lit(r"\|")), r"\s*\n\s*", " "), F.lit(""))
    if len(columns) > WIDE:
        return F.concat(F.lit("- "), F.concat_ws(" | ", *[F.when(filled(F.col(quote_identifier(c))), F.concat(F.lit(f"{c}: "), cell(c))) for c in columns]))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def pages_of(table: DataFrame, source: str, *, block: int = BLOCK_ROWS, sheet: str | None = None, row: str = "_row_idx") -> DataFrame:
    """Blocks of rows as text pages with their row range; a block is one group of bounded size."""
    columns = [c for c in table.columns if c not in (row, "search_text")]
    lines = table.select(F.floor(F.col(row) / block).alias("b"), F.col(row).alias("r"), row_text(columns).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    head = "" if len(columns) > WIDE else "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    blocks = lines.groupBy("b").agg(F.concat(F.lit(head), text).alias("text"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return blocks.select(
        F.lit(source).alias("source"), (F.col("b") + 1).alias("page"), "text", F.lit(sheet).alias("sheet_name"), F.lit(True).alias("is_tabular"),
        F.concat_ws("-", F.col("lo") + 1, F.col("hi") + 1).alias("row_range"),
    )


def sheet_pages(cells: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Text pages of all sheets of all workbooks in one job: those that ``pages_of`` gives for each ``sheet_table``.

    ``cells`` has source, sheet, row, column and value.  Sheets differ in their columns, so a row is an array beside its
    sheet's names; a block of rows is one group, and only names of sheets go through Python.
    """
    by_row = cells.groupBy("source", "sheet", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m"), F.count_if(filled(F.col("value"))).alias("n"), F.max("column").alias("last"),
    )
    leading = F.collect_list(F.when(F.col("row") < HEADER_ROWS, F.struct("row", "n", "m")))
    sheets = by_row.groupBy("source", "sheet").agg((F.max("last") + 1).alias("width"), F.array_sort(leading, lambda a, b: a["row"] - b["row"]).alias("leading"))
    fit = F.get(F.filter("leading", lambda x: x["n"] >= F.col("width") * HEADER_SHARE), F.lit(0))
    head = F.coalesce(fit["row"], F.lit(0))
    titles = F.get(F.filter("leading", lambda x: x["row"] == F.col("head")), F.lit(0))["m"]
    places = F.sequence(F.lit(0), F.col("width") - 1)
    sheets = sheets.withColumn("head", head).select("source", "sheet", "head", "width", F.transform(places, lambda k: F.get(F.filter(F.map_entries(titles), lambda e: e["key"] == k), F.lit(0))["value"]).alias("titles"))
    sheets = sheets.mapInPandas(_named, "source string, sheet string, head int, width int, names array<string>")

    plain = lambda c: F.coalesce(F.regexp_replace(F.replace(c, F.lit("|"), F.lit(r"\|")), r"\s*\n\s*", " "), F.lit(""))
    rows = by_row.join(sheets, ["source", "sheet"]).filter("row > head").withColumn("cells", F.transform(places, lambda k: F.try_element_at("m", k)))
    wide = F.col("width") > WIDE
    named = F.zip_with("names", "cells", lambda n, c: F.when(filled(c), F.concat(n, F.lit(": "), plain(c))))
    line = F.when(wide, F.concat(F.lit("- "), F.array_join(named, " | "))).otherwise(F.concat(F.lit("| "), F.array_join(F.transform("cells", plain), " | "), F.lit(" |")))
    rows = rows.select("source", "sheet", "names", wide.alias("wide"), (F.col("row") - F.col("head") - 1).cast("long").alias("r"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    bar = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |\n"))
    top = F.when(F.col("wide"), F.lit("")).otherwise(F.concat(bar(F.col("names")), bar(F.transform("names", lambda n: F.lit("---")))))
    blocks = rows.groupBy("source", "sheet", F.floor(F.col("r") / block).alias("b")).agg(F.concat(F.first(top), text).alias("text"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return blocks.select(
        "source", (F.col("b") + 1).alias("page"), "text", F.col("sheet").alias("sheet_name"), F.lit(True).alias("is_tabular"), F.concat_ws("-", F.col("lo") + 1, F.col("hi") + 1).alias("row_range"),
    )


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``titles``, a sheet a row, as safe names that differ."""
    def names(titles) -> list[str]:
        taken: set[str] = set()
        return [safe_name(t or f"col_{k}", taken) for k, t in enumerate(titles)]

    for frame in frames:
        yield frame.assign(names=frame["titles"].map(names)).drop(columns="titles")


def sheet_table(cells: DataFrame, sheet: str) -> DataFrame:
    """A sheet's rows under its header row, as text columns with ``_row_idx``."""
    mine = cells.filter(F.col("sheet") == sheet)
    width = mine.agg(F.max("column")).first()[0]
    if width is None:
        return cells.sparkSession.createDataFrame([], "_row_idx long")
    head = header_row(mine, width + 1)
    titles = {r["column"]: r["value"] for r in mine.filter(F.col("row") == head).collect()}  # one row of the sheet
    taken: set[str] = set()
    names = [safe_name(titles.get(k) or f"col_{k}", taken) for k in range(width + 1)]
    by_row = mine.filter(F.col("row") > head).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m"))
    return by_row.select((F.col("row") - head - 1).cast("long").alias("_row_idx"), *[F.element_at("m", k).alias(n) for k, n in enumerate(names)])
