"""Functions of texts hold a part of a batch at a time."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from docquarry import catalog
from docquarry.functions import parts
from docquarry.operators import chunking
from docquarry.sources import html


def in_parts(frame) -> int:
    """How many steps of a plan run a Python function part by part; all others that run some are counted against it."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n") - plan.count(f"], {PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF}\n") - plan.count(f"], {PythonEvalType.SQL_SCALAR_PANDAS_UDF}\n")


def test_parts_are_the_batch():
    for texts in ([], [None], ["", None, "ab"] * 2000, ["x" * 3_000_000, "a", None, "y" * 999_999, "bc"]):
        slices = list(parts.parts(pa.array(texts, pa.string())))
        assert [t for s in slices for t in s.to_pylist()] == texts
        assert all(len(s) == 1 or len(s) <= parts.PART_ROWS and sum(len(t or "") for t in s.to_pylist()[:-1]) <= parts.PART_BYTES for s in slices)


def test_splitter_holds_a_part(spark):
    texts = pa.array(["one two three four. " * 500] * 2000)  # 20 MB
    tracemalloc.start()
    n = sum(len(out) for out in chunking.splitter(2000, 200).func(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 8_000_000


def test_chunks_in_parts(spark):
    pages = spark.createDataFrame([("a", 1, "one two. " * 400), ("b", 2, None)], "source string, page int, text string")
    parents = chunking.parents_of(pages)
    assert in_parts(parents) == 1 and parents.count() == 2


def test_headings_in_parts(spark):
    pages = spark.createDataFrame([("a", "<h1>One</h1><p>text</p><h2>Two</h2><p>more</p>"), ("b", None)], "document_id string, html string")
    sections = chunking.heading_sections(pages.select("document_id", html.html_to_markdown(F.col("html")).alias("text")))
    assert in_parts(sections) == 2
    assert [(r["page"], r["headers"]) for r in sections.orderBy("page").collect()] == [(1, {"Header-1": "One"}), (2, {"Header-1": "One", "Header-2": "Two"})]


def test_children_in_parts(spark):
    pages = spark.createDataFrame([("a", 1, "one two. " * 400)], "source string, page int, text string")
    children = chunking.children_of(chunking.parents_of(pages))
    assert in_parts(children) == 2 and children.agg(F.max(F.length("text"))).first()[0] <= chunking.CHILD[0]


def test_main_content_in_parts(spark):
    run = html.read_blocks().func
    pages = pa.array(["<article>" + "<p>Some words, and some more of them.</p>" * 500 + "</article>"] * 500)  # 10 MB
    outs = [len(out) for out in run(iter([pages]))]
    assert sum(outs) == 500 and max(outs) * len(pages[0].as_py()) <= 2 * parts.PART_BYTES


def test_invariants_split_once(spark, monkeypatch):
    """What the invariants are counted over has been split and written: no Python step is left in its plans."""
    left = []

    def orphans(children, parents, count=chunking.orphans):
        left.extend("ArrowEvalPython" in frame._jdf.queryExecution().executedPlan().toString() for frame in (children, parents))
        return count(children, parents)

    monkeypatch.setattr(chunking, "orphans", orphans)
    assert catalog.chunk_invariants(spark, "/root/testdata/sf0.001").first().asDict() == {"too_long": 0, "orphans": 0, "parents_fit": True}
    assert left == [False, False]
