"""Filter interaction audit: what each filter removes at each place of every order of the filters.

One pass over the documents gives each a mask, one bit a filter that it fails.  Equal texts are told by
their SHA-256: a document fails the copy filter if its text has a smaller identifier anywhere in the table.
The masks of each part of the corpus are counted in cells (2**filters at most a part, partial sums before
the shuffle), and from there on the documents are not needed.  All orders of the filters are visited by swaps of
two neighbours (plain changes): only the two swapped steps are counted anew, from the cells, and each
filter's removals add up along the walk, which gives its Shapley sum.

Defined results: a null text is empty, a null part the empty string.  A row without identifier is no copy and
has no marks; rows that repeat the smallest identifier of a text are no copies either.  Repeated rows count each;
a document has a mark if any of its label rows has it.  A text without words has no repeated words.  Very
long texts are worked on whole.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, stored, text_of

#: n! orders of n rows are returned for each part.
MOST_FILTERS = 8
SPACES = r"[\x20\x09-\x0D]+"
STEP = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*STEP, "shapley"])


def text_failures(text: Column, least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 3, marks: str = r"[#$%&*|]") -> dict[str, Column]:
    """The failure conditions A to D of a text: too short, too repetitive, too many capitals, odd marks."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n_words < least_words,
        "B": 100 * n_distinct.cast("long") < distinct_percent * n_words.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capitals_percent * F.length(text).cast("long"),
        "D": text.rlike(marks),
    }


def fail_cells(docs: DataFrame, fails: dict[str, Column], labels: DataFrame, *, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): bit k of a mask is the k-th of ``fails``, the last bit the copy filter."""
    if copies in fails:
        raise ValueError(f"{copies} names two filters")
    bit = lambda k, failed: F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
    mask = F.lit(0)
    for k, failed in enumerate(fails.values()):
        mask = mask.bitwiseOR(bit(k, failed))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"), mask.alias("mask"),
    )
    work = shared_dir(docs.sparkSession, "filter-audit")
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks", f"{work}/masks")

    named = rows.filter(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first_id")).select(F.col("digest").alias("of"), "first_id")
    has = lambda column: F.coalesce(F.max(F.col(column) == 1), F.lit(False))
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    named = named.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first_id")), "left")
    named = named.join(marks, F.col("doc_id") == F.col("marked"), "left")
    named = named.select("part", F.col("mask").bitwiseOR(bit(len(fails), F.col("of").isNull())).alias("mask"), "n", "good", "toxic")
    nameless = rows.filter(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    with_mark = lambda column: F.sum(F.when(F.col(column), F.col("n")).otherwise(F.lit(0))).alias(column)
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), with_mark("good"), with_mark("toxic"))


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places i (i and i + 1 change places) that lead through all orders of n things, each once."""
    order, place, step = list(range(n)), list(range(n)), [-1] * n
    while True:
        for thing in reversed(range(n)):
            i = place[thing]
            j = i + step[thing]
            if 0 <= j < n and order[j] < thing:
                break
        else:
            return
        order[i], order[j] = order[j], thing
        place[thing], place[order[i]] = j, i
        for larger in range(thing + 1, n):
            step[larger] = -step[larger]
        yield min(i, j)


class Walk:
    """The steps of one order of the filters over the cells of one part; ``swap`` goes to the next order."""

    def __init__(self, n_filters: int, mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> None:
        self.mask, self.n, self.good, self.toxic = mask, n, good, toxic
        self.order = list(range(n_filters))
        self.before = [(1 << s) - 1 for s in range(n_filters)]
        self.steps = [self._count(s) for s in range(n_filters)]

    def _count(self, s: int) -> tuple[int, ...]:
        bit, before = 1 << self.order[s], self.before[s]
        fails, gone = (self.mask & bit) > 0, (self.mask & before) > 0
        here = fails & ~gone
        total = lambda of, which: int(of[which].sum())
        return total(self.n, ~fails & ~gone), total(self.n, here), total(self.n, fails & gone), total(self.n, self.mask == bit), total(self.good, here), total(self.toxic, here)

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self.before[i + 1] = self.before[i] | 1 << self.order[i]
        self.steps[i], self.steps[i + 1] = self._count(i), self._count(i + 1)


def _all_orders(names: list[str]):
    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        walk = Walk(len(names), *(cells.column(c).to_numpy() for c in ("mask", "n", "good", "toxic")))
        orders, steps, filters, shapley = [], [], [], np.zeros(len(names), np.int64)

        def visit() -> None:
            orders.append("".join(names[f] for f in walk.order))
            steps.extend(walk.steps)
            filters.extend(walk.order)
            for f, step in zip(walk.order, walk.steps):
                shapley[f] += step[1]

        visit()
        for i in neighbour_swaps(len(names)):
            walk.swap(i)
            visit()
        columns = np.array(steps, np.int64).T
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(steps), pa.string()), "filter_order": pa.array(np.repeat(orders, len(names)).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))), **dict(zip(STEP, map(pa.array, columns))), "shapley": pa.array(shapley[filters]),
        })

    return run


def audit(docs: DataFrame, fails: dict[str, Column], labels: DataFrame, *, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order and step; ``fails`` are the failure conditions in columns of ``docs``, by name.

    ``kept`` counts the part's documents after the step, ``removed`` those that go here, ``redundant`` those that fail this filter and
    went before, ``unique_fails`` those that fail no other; ``shapley`` is the filter's ``removed`` summed over all orders.
    """
    names = [*fails, copies]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have {math.factorial(len(names))} orders; {MOST_FILTERS} filters at most")
    found = fail_cells(docs, fails, labels, copies=copies, id_col=id_col, text_col=text_col, part_col=part_col)
    return found.groupBy("part").applyInArrow(_all_orders(names), RESULT)
