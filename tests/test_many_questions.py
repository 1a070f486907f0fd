"""Many questions at once equal each question on its own."""

import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunking, index, retrieval

WORDS = "the quick brown fox jumps over lazy dog wizards brew toxic potion evil queen jack seven while makes".split()


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    common = lambda: " ".join(rng.choice(WORDS, rng.integers(0, 30), p=np.arange(len(WORDS), 0, -1) / sum(range(len(WORDS) + 1))))
    return [(i, common() + (f" rare{i % 17}" if i % 5 == 0 else "")) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "the quick fox"), (n + 3, "the quick fox")]


@pytest.mark.parametrize("probed", [1, 4])
def test_index_equals_scores_one_by_one(spark, tmp_path, monkeypatch, probed):
    monkeypatch.setattr(index, "PROBED", probed)
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string")
    path = index.build_index(docs, f"{tmp_path}/index", block_docs=20, n_buckets=4)
    rng = np.random.default_rng(2)
    asked = [[str(w) for w in rng.choice([*WORDS, "rare3", "rare5", "nowhere"], rng.integers(1, 6))] for _ in range(12)] + [["the", "the", "fox"], ["nowhere"], []]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, terms array<string>")
    got = {}
    for r in index.bm25_many(spark, path, questions, 5).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["id"], round(r["score"], 10), r["rank"]))
    for q, terms in enumerate(asked):
        scores = retrieval.bm25_scores(docs, terms).filter("score > 0").orderBy(F.desc("score"), "id").limit(5).collect() if terms else []
        assert got.get(q, []) == [(r["id"], round(r["score"], 10), i + 1) for i, r in enumerate(scores)], terms


def test_questions_read_their_terms_only(spark, tmp_path):
    docs = spark.createDataFrame(corpus(100), "doc_id long, text string")
    path = index.build_index(docs, f"{tmp_path}/index", n_buckets=8)
    questions = spark.createDataFrame([(1, ["rare3"])], "question_id long, terms array<string>")
    plan = index.bm25_many(spark, path, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*bucket", plan) and "doc_id" not in plan


def test_index_of_nothing(spark, tmp_path):
    path = index.build_index(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/index")
    questions = spark.createDataFrame([(1, ["a"])], "question_id long, terms array<string>")
    assert index.bm25_many(spark, path, questions, 3).count() == 0


def test_posting_lists_of_a_block():
    rng = np.random.default_rng(5)
    docs = {i: [str(w) for w in rng.choice(["the", "fox", "é", "z9"], rng.integers(0, 9))] for i in range(50, 80)} | {80: [], 81: ["fox"]}
    batch = pa.RecordBatch.from_pydict({"id": pa.array([0, *docs]), "words": pa.array([["before"], *docs.values()], pa.list_(pa.string()))})
    got = index._block_postings(batch.slice(1), 7).to_pylist()
    want = {t: {i: (d.count(t), len(d)) for i, d in docs.items() if t in d} for t in {t for d in docs.values() for t in d}}
    assert {r["term"]: dict(zip(r["id"], zip(r["tf"], r["dl"]))) for r in got} == want and len(got) == len(want) and {r["block"] for r in got} == {7}
    for r in got:
        both = want[r["term"]].values()
        assert (r["n"], r["most_tf"], r["least_dl"]) == (len(both), max(tf for tf, _ in both), min(dl / tf for tf, dl in both))
    assert index._block_postings(batch.slice(31, 1), 0).num_rows == index._block_postings(batch.slice(0, 0), 0).num_rows == 0


def test_index_is_made_where_documents_are_read(spark, tmp_path):
    """Building shuffles no postings and writes nothing beside the index; the bound of a block holds for each document."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "docquarry")
    before = set(shared.glob("*"))
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string").repartition(6)
    path = index.build_index(docs, f"{tmp_path}/index", block_docs=16, n_buckets=2)
    assert set(shared.glob("*")) == before
    about, postings = spark.read.parquet(f"{path}/statistics").first(), spark.read.parquet(f"{path}/postings")
    impact = lambda tf, dl: tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl / about["mean"]))
    rows = postings.withColumn("most", index._most(about["mean"])).collect()
    assert all(len(r["id"]) <= 16 and max(map(impact, r["tf"], r["dl"])) <= r["most"] * (1 + 1e-12) for r in rows)
    assert about["n"] == 304 and len({r["block"] for r in rows}) >= 304 / 16


@pytest.mark.parametrize("block_bytes", [8_000_000, 400])
def test_dense_questions_equal_one_by_one(spark, block_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(1000 - i, rows[7][1]) for i in range(5)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0]), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    questions = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 300, 20)] + [(5000, [1.0]), (5001, [0.0] * 8), (5002, None)], "question_id long, vector array<double>")
    got = {}
    for r in retrieval.dense_many(vectors, questions, 7, block_bytes=block_bytes).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["id"], round(r["score"], 9), r["rank"]))
    good = [(i, np.array(v)) for i, v in rows[:305]]
    for i in range(0, 300, 20):
        scores = sorted((-round(float(v @ rows[i][1] / np.linalg.norm(v) / np.linalg.norm(rows[i][1])), 9), k) for k, v in good)[:7]
        assert got[i] == [(k, -s, n + 1) for n, (s, k) in enumerate(scores)]
    assert got[5000] == [(2002, 1.0, 1)] and set(got) == {*range(0, 300, 20), 5000}
    assert retrieval.dense_many(vectors, questions.limit(0), 3).count() == 0


def test_memory_of_dense_questions_does_not_grow_with_them():
    rng = np.random.default_rng(4)
    questions, rows = rng.normal(size=(2000, 8)), rng.normal(size=(10_000, 8))
    questions /= np.linalg.norm(questions, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(rows.tolist())], ["id", "v"])
    run = retrieval._best_of_task(SimpleNamespace(value=(np.arange(2000), questions)), 3)
    tracemalloc.start()
    (found,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000  # the products alone are 160 MB
    scores = np.round(questions @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, 12)
    assert found.column("id").to_pylist() == np.argsort(-scores, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_pieces_in_sql(spark):
    chunking.register_functions(spark)
    texts = ["one two three. four five six. " * 20, "", None, "short", "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").createOrReplaceTempView("docs_to_split")
    got = spark.sql("SELECT doc_id, position, piece FROM docs_to_split, LATERAL split_chunks(text, 100, 20) ORDER BY doc_id, position").collect()
    want = [(i, p, piece) for i, t in enumerate(texts) for p, piece in enumerate(chunking.split_text(t or "", 100, 20))]
    assert [tuple(r) for r in got] == want and any(p > 0 for _, p, _ in want)
