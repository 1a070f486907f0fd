"""Writes, streams, retries and look-ups around a document's life."""

import uuid

import pytest
from pyspark.sql import functions as F

from docquarry.functions import vectors
from docquarry.operators import metadata, mutate, retrieval
from docquarry.plans import profile, table_qa
from docquarry.sources import files
from docquarry.streaming import jobs

from .test_sources import sheet


def test_a_broken_swap_is_finished(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    mutate.swap_in(spark.range(3), path)
    assert not mutate.recover(spark, path)
    spark.range(5).write.parquet(f"{path}.new")
    (tmp_path / "table").rename(tmp_path / "table.old")
    assert mutate.recover(spark, path) and spark.read.parquet(path).count() == 5
    (tmp_path / "table").rename(tmp_path / "table.old")
    assert mutate.recover(spark, path) and spark.read.parquet(path).count() == 5


def test_collection_is_checked(spark):
    points = spark.createDataFrame([("d", "v1", "child", [1.0, 2.0])], "document_id string, pipeline_version string, kind string, vector array<float>")
    assert mutate.ensure_collection(points, 2).count() == 1
    with pytest.raises(ValueError, match="kind"):
        mutate.ensure_collection(points.drop("kind"), 2)
    with pytest.raises(Exception, match="length"):
        mutate.ensure_collection(points, 3).collect()


def test_documents_are_deleted_replaced_and_copied(spark):
    docs = spark.createDataFrame([("a", "x.pdf", "h1", 1, "n1", None), ("b", "y.pdf", "h2", 1, "n1", "2024-01-01")], "document_id string, filename string, content_hash string, owner_id int, notebook_id string, deleted_at string")
    docs = docs.withColumn("deleted_at", F.col("deleted_at").cast("timestamp")).withColumn("delete_requested_at", F.col("deleted_at"))
    assert [r["document_id"] for r in mutate.delete_document(docs, "a").collect()] == ["b"]
    uploads = spark.createDataFrame([("b", "z.pdf", "h9", "j1"), ("zz", "q", "h", "j2")], "document_id string, filename string, content_hash string, job_id string")
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, chunk int")
    new, queue, left = mutate.replace_document(docs, spark.createDataFrame([], "job_id string, document_id string"), chunks, uploads)
    b = new.filter("document_id = 'b'").first()
    assert (b["filename"], b["content_hash"], b["deleted_at"]) == ("z.pdf", "h9", None)
    assert [(r["job_id"], r["status"]) for r in queue.collect()] == [("j1", "queued")] and [r["document_id"] for r in left.collect()] == ["a"]
    copies, started = mutate.copy_notebook(docs, uuid.NAMESPACE_URL, "n2", 7)
    one = copies.collect()
    assert len(one) == 1 and one[0]["owner_id"] == 7 and one[0]["document_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a"))
    assert [r["document_id"] for r in started.collect()] == [one[0]["document_id"]]


def test_required_values(spark):
    rows = spark.createDataFrame([("a\x00b", "s")], "text string, source string")
    assert mutate.required(rows, "source").first()["text"] == "ab"
    with pytest.raises(Exception, match="source is required"):
        mutate.required(rows.withColumn("source", F.lit(" ")), "source").collect()


def test_exports(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("e", 1, "x")], "document_id string, page int, text string")
    mutate.export_markdown(pages, f"{tmp_path}/md")
    assert "".join(p.read_text() for p in (tmp_path / "md" / "document_id=d").glob("*.txt")) == "one\n\ntwo\n"
    metrics = spark.createDataFrame([("q1", 0.5), ("q2", 1.0)], "question string, recall double")
    mutate.write_metrics(metrics, f"{tmp_path}/csv", "question")
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text().split() == ["question,recall", "q1,0.5", "q2,1.0", "__mean__,0.75"]


def test_embedding_calls_are_retried():
    calls, waits = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise vectors.HttpError(503) if len(calls) == 1 else TimeoutError
        return [[1.0]] * len(texts)

    assert vectors.retried(flaky, 2, waits.append)(["a"]) == [[1.0]] and waits == [0.25, 0.5]
    with pytest.raises(vectors.HttpError):
        vectors.retried(lambda t: (_ for _ in ()).throw(vectors.HttpError(400)), 5, waits.append)(["a"])
    with pytest.raises(ConnectionError):
        vectors.retried(lambda t: (_ for _ in ()).throw(ConnectionError()), 1, waits.append)(["a"])
    assert waits == [0.25, 0.5, 0.25]


def test_nothing_follows_a_final_event(spark):
    rows = [(1, 0, "status"), (1, 1, "final"), (1, 2, "token"), (1, 3, "final"), (2, 0, "token")]
    got = jobs.until_final(spark.createDataFrame(rows, "m int, position int, type string"), "m", "position").orderBy("m", "position").collect()
    assert [tuple(r) for r in got] == [rows[0], rows[1], rows[4]]


def test_csv_stream_and_cancellation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(f"a,b\n{k},x\n{k},y\n")
    stream = lambda: jobs.read_csv_stream(spark, f"{tmp_path}/in", "a int, b string")
    assert jobs.run_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/c1", lambda: False) == 3
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("source").count().count() == 3
    asked = []
    with pytest.raises(jobs.Cancelled):
        jobs.run_batches(stream(), f"{tmp_path}/out2", f"{tmp_path}/c2", lambda: asked.append(1) or len(asked) > 1)
    assert not (tmp_path / "out2").exists()


def test_sql_literals_stay():
    assert table_qa.fix_sql("select ten from {t} where ten like '%ten%' and note = 'it''s like ten'", ["Ten", "note"]) == "select `Ten` from {t} where `Ten` ILIKE '%ten%' and `note` = 'it''s like ten' LIMIT 200"
    assert "LIMIT" not in table_qa.fix_sql("select count(*) from {t}", ["a"]) and "LIMIT" in table_qa.fix_sql("select count from {t}", ["count"])


def test_named_columns():
    schema = [profile.ColumnProfile(n, n, t) for n, t in (("Tin chi", "INTEGER"), ("Hoc phi", "REAL"), ("Ten", "TEXT"), ("So tiet", "INTEGER"), ("Diem", "REAL"))]
    found = table_qa.named_columns(schema, "tổng học phí, số tiết, tín chỉ và điểm")
    assert [c.name for c in found] == ["Hoc phi", "So tiet", "Tin chi"]


def test_readers_by_extension(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(sheet([[("A1", "Name"), ("B1", "Note")], [("A2", "x"), ("B2", "1")]], '<mergeCells><mergeCell ref="B2:B1048576"/></mergeCells>'))
    assert files.read(spark, f"{tmp_path}/book.xlsx").filter("text LIKE '%|%'").count() > 0
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    page = {"page": 1, "raw": "plain text", "markdown": "", "images": [], "drawings": 0}
    assert [r["text"] for r in files.read(spark, f"{tmp_path}/x.pdf", lambda content: [page]).collect()] == ["plain text"]
    with pytest.raises(ValueError):
        files.read(spark, f"{tmp_path}/x.pdf")


def test_interface_look_ups(spark):
    books = spark.createDataFrame([(1, "Alpha", ["x", "Beta"], True), (2, "Gamma", [], False), (3, "Delta", None, True)], "owner_id int, title string, tags array<string>, shared boolean")
    assert [r["title"] for r in metadata.matching(books, "BETA", "title", "tags").collect()] == ["Alpha"] and metadata.matching(books, " ", "title").count() == 3
    mine, others = metadata.mine_and_shared(books, 2)
    assert [r["title"] for r in mine.collect()] == ["Gamma"] and others.count() == 2
    assert [r["owner_id"] for r in metadata.listed(books, "shared", "owner_id").collect()] == [1, 3, 2]
    row = spark.range(1).select(metadata.visible_choice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("v"), metadata.iso_time(F.lit("2024-01-02 03:04:05.5").cast("timestamp")).alias("t"), metadata.elapsed_ms(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:01.2345").cast("timestamp")).alias("ms")).first()
    assert tuple(row) == (["b"], "2024-01-02T03:04:05.500000", 1234)


def test_choice_of_retriever(spark):
    some, none = spark.range(1), spark.range(0)
    assert retrieval.choose_retriever(some, some, reranker=lambda q, t, n: []) == "rerank"
    assert retrieval.choose_retriever(some, some) == "hybrid" and retrieval.choose_retriever(some, None) == "dense" == retrieval.choose_retriever(some, some, hybrid=False)
    with pytest.raises(ValueError):
        retrieval.choose_retriever(none, some)
