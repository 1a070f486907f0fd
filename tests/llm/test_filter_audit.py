import itertools
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import filter_audit
from docquarry.llm.shared import text_of

from .cases import CLASHING, documents, texts


def brute_force(rows, labels):
    """Every order is run on its own."""
    docs = []
    for key, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": bool(set(text) & set("#$%&*|")), "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows),
        }
        mark = lambda c: key is not None and any(k == key and m[c] == 1 for k, *m in labels)  # noqa: E731, B023
        docs.append((lang or "", {f for f, x in failed.items() if x}, mark(0), mark(1)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [d for d in here if f in d[1]]
                here = [d for d in here if f not in d[1]]
                out[part, "".join(order), step] = (len(here), len(lost), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in lost), sum(d[3] for d in lost))
                gone += lost
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(0, 1, 0), (3, 1, 1), (4, 0, 1), (5, None, None), (6, 1, 0), (10, 1, 0), (10, 0, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("rows", [None, [(5, "A#", "x"), (5, "A#", "x"), (5, "A#", None), (7, "A#", "x"), (None, "A#", "x")]])
def test_equals_every_order_run_on_its_own(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in CLASHING})
    docs = documents(spark, rows=rows).withColumns({"mask": F.lit(3), "good": F.lit(1), "of": F.lit(2), "first_id": F.lit(0), "marked": F.lit(0)})
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, filter_audit.text_failures(text_of()), labels).collect()}
    assert got == brute_force(texts() if rows is None else rows, LABELS)


def test_neither_documents_nor_labels(spark):
    docs, labels = documents(spark, rows=[]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, filter_audit.text_failures(text_of()), labels).count() == 0
    got = filter_audit.audit(documents(spark), {"X": F.col("doc_id") > 5}, labels, copies="Y")
    assert {r["filter_order"] for r in got.collect()} == {"XY", "YX"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_each_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.neighbour_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_too_many_filters(spark):
    with pytest.raises(ValueError, match="40320|362880"):
        filter_audit.audit(documents(spark), {c: F.lit(True) for c in "ABCDEFGH"}, documents(spark), copies="I")
