"""Deterministic identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name, computed by SQL functions alone."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.lpad(F.hex((F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)), 2, "0"))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def range_bounds(header: Column, size: Column) -> Column:
    """``bytes=a-b``, ``a-`` or ``-n`` as struct(start, end, valid), clamped to the size."""
    spec = r"^bytes=(\d*)-(\d*)$"
    first, last = F.regexp_extract(header, spec, 1), F.regexp_extract(header, spec, 2)
    start = F.when(first != "", first.try_cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), size - last.try_cast("long")))
    end = F.when((first == "") | (last == ""), size - 1).otherwise(F.least(last.try_cast("long"), size - 1))
    valid = header.rlike(spec) & ((first != "") | (last != "")) & (start < size) & (start <= end)
    return F.struct(start.alias("start"), end.alias("end"), F.coalesce(valid, F.lit(False)).alias("valid"))
