"""Column profiles of a table: what its columns mean, from names and values."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.shared_files import stored

from .vocabulary import ALIASES, NAMED

NUMERIC = ("INTEGER", "REAL")
_SQL_TYPES = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "timestamp": "TIMESTAMP", "date": "TIMESTAMP", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    original_name: str
    dtype: str
    semantic_type: str = "generic_text"
    confidence: float = 0.35
    aliases: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    non_empty_ratio: float = 0.0
    unique_ratio: float = 0.0

    @property
    def numeric(self) -> bool:
        return self.dtype in NUMERIC


def normalize(value: str | None) -> str:
    """The driver-side twin of ``functions.text.normalize_text`` for single words of a question."""
    marks_off = "".join(c for c in unicodedata.normalize("NFD", value or "") if unicodedata.category(c) != "Mn")
    return re.sub(r"[^a-z0-9]+", " ", marks_off.lower()).strip()


def compact(value: str | None) -> str:
    return normalize(value).replace(" ", "")


def sql_type(spark_type: str) -> str:
    return _SQL_TYPES.get(spark_type, "TEXT")


def _filled(c: Column) -> Column:
    text = T.strip(c.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def unpivoted(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) rows of all columns, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _filled(F.col(T.quote_identifier(c))).alias("value")) for c in columns])
    return table.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def value_statistics(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, non_empty, distinct normalised values: exact, in two grouped passes of one plan."""
    cells = unpivoted(table, columns).withColumn("norm", F.when(F.col("value").isNotNull(), T.normalize_text(F.col("value"))))
    by_value = cells.groupBy("column", "norm").agg(F.count("*").alias("n"), F.count("value").alias("filled"))
    return by_value.groupBy("column").agg(F.sum("n").alias("n"), F.sum("filled").alias("non_empty"), F.count("norm").alias("distinct_values"))


def sample_values(table: DataFrame, column: str, order: str, limit: int = 12) -> DataFrame:
    """value, first_row: the first distinct (normalised) values in order, cut to 120 characters."""
    value = _filled(F.col(T.quote_identifier(column)))
    rows = table.select(F.col(order).alias("first_row"), value.alias("value")).filter("value IS NOT NULL")
    first = rows.groupBy(T.normalize_text(F.col("value")).alias("norm")).agg(F.min(F.struct("first_row", "value")).alias("x"))
    return first.select(F.substring("x.value", 1, 120).alias("value"), "x.first_row").orderBy("first_row").limit(limit)


#: What a sample value may look like.
LOOKS = {"date": T.looks_like_date, "year": T.looks_like_year, "age": T.looks_like_age, "code": T.looks_like_course_code, "gender": T.looks_like_gender, "person": T.looks_like_person}


def samples_and_statistics(table: DataFrame, columns: list[str], order: str, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(statistics as in ``value_statistics``; column, place, value and what it looks like of the first values of
    each column).  One pass over the table for all columns: its distinct values are stored, both come from them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _filled(F.col(T.quote_identifier(c))).alias("value")) for c in columns])
    cells = table.select(F.col(order).alias("at"), F.explode(pairs).alias("p")).select("at", "p.column", "p.value")
    cells = cells.withColumn("norm", F.when(F.col("value").isNotNull(), T.normalize_text(F.col("value"))))
    values = stored(cells.groupBy("column", "norm").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.min(F.struct("at", "value")).alias("first")), "values")
    statistics = values.groupBy("column").agg(F.sum("n").alias("n"), F.sum("filled").alias("non_empty"), F.count("norm").alias("distinct_values"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("first.at", "norm"))  # each task hands on ``limit`` rows a column
    samples = values.filter("norm IS NOT NULL").withColumn("place", place).filter(F.col("place") <= limit)
    samples = samples.select("column", "place", F.substring("first.value", 1, 120).alias("value"))
    return statistics, samples.select("*", *[F.coalesce(test(F.col("value")), F.lit(False)).alias(name) for name, test in LOOKS.items()])


def profile_table(table: DataFrame, order: str = "_row_idx", hidden: tuple[str, ...] = ("_row_idx", "search_text"), names: dict[str, str] | None = None) -> list[ColumnProfile]:
    """Profiles of all columns but the hidden ones; the driver gets a few rows per column."""
    columns = [c for c in table.columns if c not in hidden]
    if not columns:
        return []
    statistics, sampled = samples_and_statistics(table, columns, order)
    stats = {r["column"]: r for r in statistics.collect()}
    samples: dict[str, list] = {}
    for r in sampled.orderBy("column", "place").collect():
        samples.setdefault(r["column"], []).append(r)
    out = []
    for c in columns:
        kind, s, rows = sql_type(dict(table.dtypes)[c]), stats.get(c), samples.get(c, [])
        original = (names or {}).get(c, c)
        ratio = s["non_empty"] / s["n"] if s and s["n"] else 0.0
        unique = s["distinct_values"] / s["non_empty"] if s and s["non_empty"] else 0.0
        share = {name: sum(r[name] for r in rows) / len(rows) if rows else 0.0 for name in LOOKS}
        semantic, confidence = _by_name(f"{original} {c}") or _by_values(share, kind, unique)
        out.append(ColumnProfile(c, original, kind, semantic, confidence, ALIASES[semantic], [r["value"] for r in rows], round(ratio, 3), round(unique, 3)))
    return out


def _by_name(name: str) -> tuple[str, float] | None:
    norm, short = normalize(name), compact(name)
    if "ngay" in short and "sinh" in short:
        return "date_of_birth", 0.95
    for semantic, confidence, parts, whole in NAMED:
        if any(p in short for p in parts) or any(w in (norm, short) or norm == f"{w} {w}" for w in whole):
            return semantic, confidence
    return None


def _by_values(share: dict[str, float], kind: str, unique: float) -> tuple[str, float]:
    tests = (
        ("date_of_birth", 0.75, share["date"] >= 0.6), ("birth_year", 0.7, share["year"] >= 0.8), ("age", 0.65, kind in NUMERIC and share["age"] >= 0.8),
        ("course_code", 0.7, share["code"] >= 0.5), ("gender", 0.75, share["gender"] >= 0.7), ("person_name", 0.65, unique > 0.7 and share["person"] >= 0.6),
    )
    default = ("generic_number" if kind in NUMERIC else "generic_text", 0.35)
    return next(((s, c) for s, c, fits in tests if fits), default)
