from pyspark.sql import functions as F

from docquarry.operators import chunking, evaluate, metadata, mutate, retrieval


def ranked(spark, keys):
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key string, rank int")


def test_tokenize(spark):
    from docquarry.functions.text import tokenize

    assert spark.range(1).select(tokenize(F.lit("A bc! d2 1e foo-bar"))).first()[0] == ["bc", "d2", "1e", "foo", "bar"]


def test_overlap_answers_where_bm25_has_no_positive_score(spark):
    docs = spark.createDataFrame([("a", "logic and philosophy"), ("b", "cooking recipes today")], "doc_id string, text string")
    assert [r["id"] for r in retrieval.lexical_topk(docs, "logic philosophy", 2).collect()] == ["a"]


def test_fusion_keeps_first_positions(spark):
    fused = retrieval.rrf([(ranked(spark, "aab"), 0.7), (ranked(spark, "bcc"), 0.3)])
    scores = {r["key"]: r["rrf"] for r in fused.collect()}
    assert scores == {"a": round(0.7 / 61, 8), "b": round(0.7 / 63 + 0.3 / 61, 8), "c": round(0.3 / 62, 8)}
    assert [r["key"] for r in retrieval.top_fused(fused, 3).orderBy("rank").collect()] == ["b", "a", "c"]


def test_rerank_and_its_failure(spark):
    rows = [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "a", "w")]
    candidates = spark.createDataFrame(rows, "rank int, parent string, text string")
    order = lambda f: [r["parent"] for r in retrieval.rerank(candidates, "q", f, 3).orderBy("rank").collect()]
    assert order(lambda q, t, n: [1, 2, 0, 3]) == ["b", "c", "a"]
    assert order(lambda q, t, n: [2, 2, 99, "x"]) == ["c", "a", "b"]
    assert order(lambda q, t, n: 1 / 0) == ["a", "b", "c"]


def test_scope(spark):
    chunks = spark.createDataFrame([("d1", "child", "v1", 1, 1), ("d2", "child", "v1", 2, 1), ("d1", "parent", "v1", 1, 1)], "document_id string, kind string, pipeline_version string, owner_id int, notebook_id int")
    assert retrieval.in_scope(chunks, version="v1", owner_id=1).count() == 1
    assert retrieval.in_scope(chunks, owner_id=1, community=True).count() == 2
    assert retrieval.in_scope(chunks, document_ids=[]).count() == 0
    assert retrieval.in_scope(chunks, document_ids=["d2"]).count() == 1


def test_filters_come_before_products(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1)], "vec_id int, embedding array<float>, label int").filter("label = 1")
    plan = retrieval.dense_topk(vectors, [1.0, 0.0], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aggregate(") < plan.index("Filter") and "GlobalLimit" in plan


def test_citations(spark):
    answers = spark.createDataFrame([("x", "see [C2, C5] and [c1, C5]"), ("y", "none")], "answer_id string, answer string")
    known = F.array(F.lit("C1"), F.lit("C2"))
    got = {r["answer_id"]: r["a"] for r in answers.select("answer_id", retrieval.normalize_markers(F.col("answer"), known).alias("a")).collect()}
    assert got == {"x": "see [C2] and [C1]", "y": "none"}
    cites = spark.createDataFrame([("C1", "s1"), ("C2", "s2"), ("C3", "s3")], "citation_id string, source string")
    assert sorted(r["citation_id"] for r in retrieval.used_citations(answers, cites).collect()) == ["C1", "C2"]
    assert [r["citation_id"] for r in retrieval.unknown_citations(answers, cites).collect()] == ["C5"]


def test_chunks_hold_their_bounds():
    text = "\n\n".join(" ".join(f"word{i}x{j}." for j in range(60)) for i in range(30)) + "y" * 1300
    pieces = chunking.split_text(text, 500, 100)
    assert max(map(len, pieces)) <= 500
    assert set(text.split()) >= {w for p in pieces[:-4] for w in p.split()[1:-1]}
    assert all(any(w.rstrip(".") in p for p in pieces) for w in text.split() if len(w) < 100)
    assert chunking.split_text("", 500, 100) == [] and chunking.split_text("a", 500, 100) == ["a"]


def test_headings(spark):
    sections = chunking.split_headings("intro\n# A\ntext\n```\n# no\n```\n## B\nb\n# C")
    assert [(t.split("\n")[0], h) for t, h in sections] == [("intro", {}), ("# A", {"Header-1": "A"}), ("## B", {"Header-1": "A", "Header-2": "B"}), ("# C", {"Header-1": "C"})]


def test_identifiers_match_python(spark):
    import uuid

    from docquarry.functions.ids import uuid5

    names = ["", "a", "đô😀", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(uuid5(uuid.NAMESPACE_DNS, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_history_budget(spark):
    rows = [(1, i, "user", "x" * 10) for i in range(6)] + [(1, 6, "bot", "  "), (2, 0, "user", "hi")]
    messages = spark.createDataFrame(rows, "conversation_id int, id int, role string, content string")
    got = metadata.history(messages, order=["id"], budget=25).orderBy("conversation_id", "position").collect()
    assert [(r["conversation_id"], r["id"], len(r["content"])) for r in got] == [(1, 3, 5), (1, 4, 10), (1, 5, 10), (2, 0, 2)]


def test_delete_version_and_swap(spark, tmp_path):
    rows = spark.createDataFrame([("d", "v1", 1), ("d", "v1", 2), ("d", "v2", 3)], "document_id string, pipeline_version string, n int")
    path = str(tmp_path / "t")
    mutate.swap_in(rows, path)
    mutate.swap_in(mutate.delete_version(spark.read.parquet(path), "d", "v1"), path)
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [3]
    assert mutate.delete_version(spark.read.parquet(path), "none", "v1").count() == 1


def test_upsert_and_dimension(spark):
    import pytest

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, mutate.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    bad = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<float>")
    with pytest.raises(Exception, match="vector of length"):
        mutate.check_vectors(bad, 1).collect()


def test_precision_recall(spark):
    ranked_rows = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item_id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, item_id string")
    assert tuple(evaluate.precision_recall(ranked_rows, relevant, 2).first()) == ("q", 1, 0.5, 0.5)
