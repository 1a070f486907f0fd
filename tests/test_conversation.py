import pytest
from pyspark.sql import functions as F

from docquarry.operators import conversation, metadata, mutate


def conversations(spark):
    return spark.createDataFrame([("c1", 1, 7, "2024-01-01"), ("c2", 2, 7, "2024-01-02")], "conversation_id string, owner_id int, notebook_id int, at string").withColumn("updated_at", F.to_timestamp("at")).drop("at")


def test_get_or_create(spark):
    every, one = conversation.get_or_create(conversations(spark), 1, "c1", 7)
    assert every.count() == 2 and one.first()["conversation_id"] == "c1"
    with pytest.raises(LookupError):
        conversation.get_or_create(conversations(spark), 1, "c2", 7)
    every, one = conversation.get_or_create(conversations(spark), 1, None, 7)
    assert every.count() == 3 and one.count() == 1


def test_save_message_and_item(spark):
    messages = spark.createDataFrame([(1, "c1", "user", "x")], "message_id int, conversation_id string, role string, content string")
    new = spark.createDataFrame([(2, "c1", "bot", "y", "2025-05-05")], "message_id int, conversation_id string, role string, content string, at string").withColumn("created_at", F.to_timestamp("at")).drop("at")
    messages, touched = conversation.save_message(messages, conversations(spark), new)
    assert messages.count() == 2 and str(touched.filter("conversation_id = 'c1'").first()["updated_at"]).startswith("2025-05-05")
    items = spark.createDataFrame([], "message_id int, notebook_id int, kind string")
    wanted = spark.createDataFrame([(2, 7, "pin"), (2, 8, "pin"), (9, 7, "pin")], items.schema)
    assert [tuple(r) for r in conversation.save_item(items, wanted, messages, touched, 1).collect()] == [(2, 7, "pin")]
    assert conversation.save_item(items, wanted, messages, touched, 2).count() == 0


def test_rewrite_and_streams():
    assert conversation.rewrite("q", "", lambda p: "x") == "q" and conversation.rewrite("q", "h", lambda p: 1 / 0) == "q"
    assert conversation.rewrite("q", "h", lambda p: ' "better" ') == "better"

    def broken(prompt):
        yield "a"
        raise OSError("cut")

    def dead(prompt):
        raise OSError("down")

    kinds = lambda ps: [(e["type"], e["payload"], e.get("error")) for e in conversation.stream_answer("p", ps)][1:]
    assert kinds([dead, lambda p: ["x", "y"]]) == [("token", "x", None), ("token", "y", None), ("final", "xy", None)]
    assert kinds([broken, lambda p: ["z"]])[-1] == ("final", "a", "cut") and kinds([dead])[-1][2] == "no provider answered"


def test_access_and_documents(spark):
    docs = spark.createDataFrame([("d1", "a.md", 1, False), ("d2", "b.md", 2, True), ("d3", "c.md", 2, False)], "document_id string, filename string, owner_id int, is_community boolean")
    pick = lambda key: [r["document_id"] for r in metadata.authorized_document(docs, key, 1).collect()]
    assert pick("a.md") == ["d1"] and pick("d2") == ["d2"] and pick("d3") == [] and pick("b.md") == []
    assert conversation.missing(["d1", "zz"], docs) == ["zz"]
    renamed = mutate.rename_file(docs.withColumn("object_key", F.lit("k")), "d1", "new.txt").filter("document_id = 'd1'").first()
    assert (renamed["filename"], renamed["object_key"]) == ("new.md", "d1/new.md")


def test_cascade_and_numbers(spark):
    notebooks = spark.createDataFrame([(1, 10), (2, 11)], "user_id int, notebook_id int")
    docs = spark.createDataFrame([(10, "x"), (11, "y")], "notebook_id int, document_id string")
    left = mutate.cascade({"n": notebooks, "d": docs}, spark.createDataFrame([(1,)], "user_id int"), [("n", "user_id", "notebook_id"), ("d", "notebook_id", "document_id")])
    assert left["n"].count() == 1 and [r["document_id"] for r in left["d"].collect()] == ["y"]
    rows = metadata.numbered(spark.range(100, 0, -1).toDF("k").repartition(5), ["k"], 30).orderBy("k").collect()
    assert [r["row_idx"] for r in rows] == list(range(100)) and rows[-1]["batch"] == 3


def test_library_tree_is_rows(spark):
    """No row or group holds a user's documents; users and notebooks without any are listed too."""
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id int, name string")
    notebooks = spark.createDataFrame([(1, 7, "N"), (1, 8, None), (2, 9, "E"), (5, 1, "none")], "user_id int, notebook_id int, title string")
    documents = spark.createDataFrame([(1, 7, 20, "y"), (1, 7, 10, "x"), (1, None, 30, "z"), (2, 4, 40, "u"), (5, 1, 50, "v")], "user_id int, notebook_id int, document_id int, filename string")
    tree = metadata.library_tree(users, notebooks, documents).orderBy("position").collect()
    assert [r["position"] for r in tree] == list(range(12))
    assert [(r["user_id"], r["notebook_id"], r["title"] or r["filename"] or r["name"]) for r in tree] == [
        (1, None, "a"), (1, -1, "Unfiled"), (1, -1, "z"), (1, 7, "N"), (1, 7, "x"), (1, 7, "y"), (1, 8, "Unfiled"),
        (2, None, "b"), (2, 4, "Unfiled"), (2, 4, "u"), (2, 9, "E"), (3, None, "c"),
    ]
    nodes = metadata.tree_nodes(users, notebooks, documents)
    counts = metadata.tree_counts(nodes)
    assert sorted(map(tuple, counts.collect())) == [(1, 3, 3), (2, 2, 1), (3, 0, 0)]


def test_library_tree_counts_collects_nothing(spark):
    from docquarry import catalog

    plan = catalog.queries()["library_tree_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_count" in plan
