"""Queries of the library's operators over the test tables, with equivalent SQL.

The tables stand in for what the operators are made for: ``documents`` for chunks, ``embeddings`` for
their vectors (``vec_id`` = ``doc_id``, ``label`` as parent or filter key), ``conversations`` for chat
messages, ``orders`` for jobs, ``customer`` and ``part`` for spreadsheets, ``events`` for job progress.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import ids
from docquarry.functions import text as T
from docquarry.operators import chunking, evaluate, index, metadata, mutate, retrieval, versioned
from docquarry.plans import profile, table_qa
from docquarry.shared_files import shared_dir, spread, stored
from docquarry.sources import files, html, ranges, tabular
from docquarry.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TERMS = ["the", "oution", "stzu"]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of long texts in a small file is dealt to all cores."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(frame) if name in ("documents", "pages") else frame


def _one_row(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """Aggregates of one row each side by side."""
    columns = [F.lit(v).cast(f.schema[c].dataType).alias(c) for f in frames for c, v in f.first().asDict().items()]
    return spark.range(1).select(*columns)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _t(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


# ── retrieval ───────────────────────────────────────────────────────────────

_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"
_BM25 = f"""
w AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents),
l AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS avgdl FROM w),
p AS (SELECT id, len(ws) AS dl, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM w) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, l),
f AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
bm AS (SELECT id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM p JOIN f USING (term), l WHERE term IN ('the', 'oution', 'stzu') GROUP BY id),
sparse AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 10)"""
_DENSE = """
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
sc AS (SELECT vec_id AS id, label, round(list_cosine_similarity(list_transform(embedding, lambda z: z::DOUBLE), list_transform(q, lambda z: z::DOUBLE)), 6) AS score FROM embeddings, q),
dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 5)"""


@query(f"SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_words, max(len(ws))::BIGINT AS longest, round(avg(len(ws)), 6) AS mean FROM (SELECT {_WORDS} AS ws FROM documents)")
def tokenize_stats(spark, sf_dir):
    n = _t(spark, sf_dir, "documents").select(F.size(T.tokenize(F.col("text"))).cast("long").alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


@query(f"WITH {_BM25} SELECT id, score, rank::INTEGER AS rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return retrieval.lexical_topk(_t(spark, sf_dir, "documents"), TERMS, 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_BM25}, t AS (SELECT item_id AS question_id, unnest({_WORDS}) AS term FROM benchmark), a AS (SELECT question_id, term, count(*) AS times FROM t GROUP BY ALL),
s AS (SELECT question_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM a JOIN p USING (term) JOIN f USING (term), l GROUP BY ALL)
SELECT question_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def bm25_batch(spark, sf_dir):
    """Every benchmark item is a question to a stored index of the documents."""
    path = index.build_index(_t(spark, sf_dir, "documents"), shared_dir(spark, "index"))
    questions = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.tokenize(F.col("text")).alias("terms"))
    return index.bm25_many(spark, path, questions, 5).withColumn("score", F.round("score", 6))


@query("""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.id AS question_id, v.id, round(list_cosine_similarity(q.v, v.v), 12) AS score FROM v AS q, v WHERE q.id % 50 = 0)
SELECT question_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def dense_batch(spark, sf_dir):
    """Every vector whose identifier is divisible by 50 is a question to all vectors."""
    vectors = _t(spark, sf_dir, "embeddings")
    questions = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_many(vectors, questions, 5).withColumn("score", F.round("score", 6))


@query(f"""
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM (
  SELECT doc_id AS id, len(list_filter({_WORDS}, lambda w: w IN ('the', 'of', 'and')))::DOUBLE AS score FROM documents) WHERE score > 0 QUALIFY rank <= 10""")
def overlap_topk(spark, sf_dir):
    scores = retrieval.overlap_scores(_t(spark, sf_dir, "documents"), ["the", "of", "and"])
    return scores.orderBy(F.desc("score"), "id").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(f"WITH {_DENSE} SELECT id, score, rank::INTEGER AS rank FROM dense")
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(f"WITH {_DENSE} SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM sc WHERE label IN (1, 2, 3) QUALIFY rank <= 5")
def dense_filtered_topk(spark, sf_dir):
    scoped = _t(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 2, 3))
    return retrieval.dense_topk(scoped, _query_vector(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_DENSE}, top AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 20)
SELECT label AS parent_id, max(score) AS score, any_value(n) AS n_children FROM top JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) GROUP BY label""")
def child_parent_rollup(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    hits = retrieval.dense_topk(vectors, _query_vector(spark, sf_dir), 20).join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id")), "id")
    parents = vectors.groupBy(F.col("label").alias("parent_id")).agg(F.count("*").alias("n_children"))
    return retrieval.roll_up(hits, parents).withColumn("score", F.round("score", 6))


_FUSED = """
u AS (SELECT id, rank, 0.7 AS w, 0 AS src FROM dense UNION ALL SELECT id, rank, 0.3, 1 FROM sparse),
fused AS (SELECT id AS key, round(sum(w / (60 + rank)), 8) AS rrf, min(src * 1000 + rank) AS seen FROM u GROUP BY id),
top AS (SELECT key, rrf, row_number() OVER (ORDER BY rrf DESC, seen, key)::INTEGER AS rank FROM fused QUALIFY rank <= 3)"""


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT key, rrf, rank FROM top")
def rrf_fusion(spark, sf_dir):
    found = retrieval.hybrid_topk(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings"), TERMS, _query_vector(spark, sf_dir))
    return found.select("key", "rrf", "rank")


@query(f"""
WITH {_DENSE}, c AS (SELECT id, label AS parent, row_number() OVER (ORDER BY score DESC, id) AS position FROM sc QUALIFY position <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY position) > 1 AS later FROM c)
SELECT id, parent, position, row_number() OVER (ORDER BY later, position)::INTEGER AS rank FROM n QUALIFY rank <= 8""")
def rerank_diversity(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    top = retrieval.dense_topk(vectors, _query_vector(spark, sf_dir), 20).select("id", F.col("rank").cast("long").alias("position"))
    return retrieval.diversify(top.join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("parent")), "id"), 8)


@query()
def rerank_parents(spark, sf_dir):
    """Rerank with a fixed stand-in for the model: positions from last to first."""
    vectors, docs = _t(spark, sf_dir, "embeddings"), _t(spark, sf_dir, "documents")
    top = retrieval.dense_topk(vectors, _query_vector(spark, sf_dir), 8).join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("parent")), "id")
    with_text = top.join(docs.select(F.col("doc_id").alias("id"), "text"), "id", "left")
    return retrieval.rerank(with_text, "the", lambda q, texts, n: list(range(n))[::-1], 3)


@query(f"""
WITH {_BM25}
SELECT string_agg('[C' || rank || '] source=' || source || ' page=' || 1 || ' doc_id=' || doc_id || ' chunk_id=' || doc_id || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM sparse JOIN documents ON doc_id = id WHERE rank <= 3""")
def context_block(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    top = retrieval.lexical_topk(docs, TERMS, 3)
    found = docs.join(F.broadcast(top.select(F.col("id").alias("doc_id"), "rank")), "doc_id").withColumns({"page": F.lit(1), "chunk_id": F.col("doc_id")})
    return retrieval.context_block(found)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with citations: fused candidates with their documents' snippets."""
    docs = _t(spark, sf_dir, "documents")
    top = retrieval.hybrid_topk(docs, _t(spark, sf_dir, "embeddings"), TERMS, _query_vector(spark, sf_dir))
    found = top.join(docs, top["key"] == docs["doc_id"], "left")
    return found.select(F.concat(F.lit("C"), "rank").alias("citation_id"), "rank", "key", "rrf", "source", F.substring("text", 1, 280).alias("snippet"))


@query(f"""
WITH {_BM25}, {_DENSE}, {_FUSED}
SELECT 'C' || rank AS citation_id, rank, key, rrf, source, substring(text, 1, 280) AS snippet FROM top LEFT JOIN documents ON doc_id = key""")
def hybrid_citations(spark, sf_dir):
    return flagship(spark, sf_dir)


_ANSWER = "text || ' [C' || (turn % 4) || ', C' || (conv_id % 5) || '] and [c' || (turn % 3) || ']'"


@query(f"""
WITH a AS (SELECT conv_id, turn, upper({_ANSWER}) AS answer FROM conversations),
m AS (SELECT conv_id, turn, list_distinct(flatten(list_transform(regexp_extract_all(answer, '\\[\\s*C\\d+(?:\\s*,\\s*C\\d+)*\\s*\\]'), lambda x: regexp_extract_all(x, 'C\\d+')))) AS ids FROM a)
SELECT conv_id, turn, array_to_string(list_sort(ids), ',') AS ids FROM m""")
def citation_markers(spark, sf_dir):
    answer = F.concat("text", F.lit(" [C"), F.col("turn") % 4, F.lit(", C"), F.col("conv_id") % 5, F.lit("] and [c"), F.col("turn") % 3, F.lit("]"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(retrieval.cited_ids(answer)), ",").alias("ids"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 IN (1, 2) THEN 'see [C' || (turn % 4) || '] end' ELSE 'see [C2] end' END AS answer FROM conversations""")
def citation_normalisation(spark, sf_dir):
    answer = F.concat(F.lit("see [C"), F.col("turn") % 4, F.lit(", C2, C9] end"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.normalize_markers(answer, F.array(F.lit("C1"), F.lit("C2"))).alias("answer"))


# ── metadata ────────────────────────────────────────────────────────────────


@query("""
WITH l AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 4),
u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l WHERE text <> '')
SELECT conv_id, turn, role, substring(text, 1, (400 - used)::INTEGER) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC)::INTEGER AS position FROM u WHERE used < 400""")
def history_window(spark, sf_dir):
    rows = metadata.history(_t(spark, sf_dir, "conversations"), conversation="conv_id", order=["turn"], text="text", budget=400)
    return rows.select("conv_id", "turn", "role", "text", "position")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id")
def history_text(spark, sf_dir):
    last = metadata.latest_n(_t(spark, sf_dir, "conversations"), ["conv_id"], 2, F.desc("turn")).withColumn("position", F.col("turn"))
    return metadata.history_text(last, conversation="conv_id", text="text")


@query("""
SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""")
def latest_per_group(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = metadata.with_latest(_t(spark, sf_dir, "customer"), orders, ["c_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return found.select("c_custkey", "c_name", "o_orderkey")


@query("""
WITH c AS (SELECT conv_id, max(turn) AS latest FROM conversations GROUP BY conv_id ORDER BY latest DESC, conv_id DESC LIMIT 1)
SELECT conv_id, turn, role FROM conversations JOIN c USING (conv_id) ORDER BY turn DESC LIMIT 3""")
def latest_conversation_page(spark, sf_dir):
    messages = _t(spark, sf_dir, "conversations")
    heads = messages.groupBy("conv_id").agg(F.max("turn").alias("at"))
    return metadata.latest_conversation(heads, messages, 3, key="conv_id").select("conv_id", "turn", "role")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def ready_docs_semi(spark, sf_dir):
    return metadata.with_any(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").filter("quality = 1"), ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_ids_anti(spark, sf_dir):
    return metadata.without_any(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query("""
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' GROUP BY n_name""")
def scope_join_chain(spark, sf_dir):
    orders, customers, nations = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    chain = orders.filter("o_orderstatus = 'F'").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return chain.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey AS user_id, count(DISTINCT o_orderstatus) AS n_notebooks, count(*) AS n_documents FROM orders GROUP BY 1")
def library_tree_counts(spark, sf_dir):
    """Customers with a notebook for each status; that of status P is not listed, so its orders are unfiled."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.ascii("o_orderstatus").alias("notebook_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"), "o_orderstatus")
    notebooks = orders.filter("o_orderstatus <> 'P'").select("user_id", "notebook_id", F.col("o_orderstatus").alias("title")).distinct()
    return metadata.tree_counts(metadata.tree_nodes(orders.select("user_id").distinct(), notebooks, orders.drop("o_orderstatus")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch FROM orders")
def batch_numbering(spark, sf_dir):
    return metadata.numbered(_t(spark, sf_dir, "orders"), ["o_orderkey"], 32).select("o_orderkey", F.col("row_idx").cast("long").alias("row_idx"), F.col("batch").cast("long").alias("batch"))


@query("SELECT event_id, user_id, max(event_id % 101) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM events")
def progress_running_max(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("p", F.col("event_id") % 101)
    return metadata.running_maximum(events, "user_id", "p", "ts", "event_id").select("event_id", "user_id", "progress")


@query("""
SELECT event_id, CASE event_type_no WHEN 0 THEN (60 * r)::INTEGER WHEN 1 THEN 60 + floor(10 * r)::INTEGER ELSE 70 + floor(20 * r)::INTEGER END AS progress
FROM (SELECT event_id, event_id % 3 AS event_type_no, (event_id % 2) / 2.0 AS r FROM events)""")
def stage_progress(spark, sf_dir):
    stage = F.element_at(F.array(F.lit("parsing"), F.lit("chunking"), F.lit("embedding")), (F.col("event_id") % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", metadata.stage_progress(stage, (F.col("event_id") % 2) / 2.0, jobs.STAGES).alias("progress"))


@query(f"""
WITH {_DENSE}, c AS (SELECT sc.id, sc.label, sc.score FROM sc WHERE sc.id % 3 = 0 ORDER BY score DESC, id LIMIT 20)
SELECT label AS parent_id, label % 4 AS document_id, max(score) AS score FROM c WHERE label % 4 <> 2 GROUP BY label""")
def scoped_retrieval(spark, sf_dir):
    """From a vector to contexts in one call; every fourth document is deleted."""
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("parent_id"))
    chunks = vectors.withColumns({"kind": F.when(F.col("chunk_id") % 3 == 0, "child").otherwise("parent"), "pipeline_version": F.lit("v1")})
    parents = vectors.select("parent_id", (F.col("parent_id") % 4).alias("document_id")).distinct()
    gone = F.when(F.col("document_id") == 2, F.lit("2024-01-01")).cast("timestamp")
    documents = parents.select("document_id").distinct().withColumns({"deleted_at": gone, "delete_requested_at": gone})
    found = retrieval.retrieve(chunks, parents, documents, _query_vector(spark, sf_dir), 20, version="v1")
    return found.select("parent_id", "document_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_DENSE}, a AS (SELECT id AS key, rank FROM dense), b AS (SELECT vec_id AS key, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE vec_id < 12 OR vec_id IN (SELECT id FROM dense)),
u AS (SELECT key, 0 AS src, rank FROM a UNION ALL SELECT key, 1, rank FROM b),
f AS (SELECT key, min(src * 100000 + rank) AS place FROM u GROUP BY key)
SELECT key, row_number() OVER (ORDER BY place, key)::INTEGER AS rank FROM f""")
def candidate_union(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    dense = retrieval.dense_topk(vectors, _query_vector(spark, sf_dir), 5).select(F.col("id").alias("key"), "rank")
    second = vectors.select(F.col("vec_id").alias("key")).join(F.broadcast(dense.select("key", F.lit(True).alias("d"))), "key", "left").filter("key < 12 OR d")
    second = second.select("key", F.row_number().over(Window.orderBy("key")).alias("rank"))  # a few rows
    return retrieval.union_candidates([dense, second])


@query("""
SELECT doc_id, source FROM documents WHERE source IS NULL OR source <> 'src0'""")
def delete_document(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumnRenamed("source", "document_id")
    return mutate.delete_document(docs, "src0").select("doc_id", F.col("document_id").alias("source"))


@query("""
SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN 'new-' || doc_id ELSE source END AS filename, CASE WHEN doc_id % 10 = 0 THEN 'h' || doc_id ELSE 'old' END AS content_hash,
  (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS queued, (SELECT count(*) FROM labels WHERE doc_id % 10 <> 0) AS chunks FROM documents""")
def replace_document(spark, sf_dir):
    never = F.lit(None).cast("timestamp")
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.lit("old").alias("content_hash"), never.alias("deleted_at"), never.alias("delete_requested_at"))
    uploads = docs.filter("document_id % 10 = 0").select("document_id", F.concat(F.lit("new-"), "document_id").alias("filename"), F.concat(F.lit("h"), "document_id").alias("content_hash"), F.col("document_id").alias("job_id"))
    jobs_before = spark.createDataFrame([], "job_id long, document_id long, status string")
    chunks = _t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    replaced, queued, left = mutate.replace_document(docs, jobs_before, chunks, uploads)
    return replaced.select("document_id", "filename", "content_hash", F.lit(queued.count()).alias("queued"), F.lit(left.count()).alias("chunks"))


@query("""
SELECT o_custkey AS document_id, o_orderpriority AS sheet_name, count(*) AS n, max(o_orderstatus = 'F') AS again FROM orders
WHERE NOT (o_orderstatus <> 'F' AND (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F')) GROUP BY ALL""")
def reingest_sheets(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("sheet_name"), (F.col("o_orderstatus") == "F").alias("again"))
    out = mutate.reingest_sheets(rows.filter("NOT again"), rows.filter("again"))
    return out.groupBy("document_id", "sheet_name").agg(F.count("*").alias("n"), F.max("again").alias("again"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def tables_of_user(spark, sf_dir):
    """The user has no row in the catalogue, so those of the user's documents count."""
    catalogue = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"), F.lit(-1).alias("user_id"))
    documents = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("owner_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return metadata.tables_of(catalogue, documents, 3).select("o_orderkey")


@query("""
SELECT coalesce(p.d, c.d) AS document_id, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, coalesce(n, 0)::BIGINT AS "rows" FROM
  (SELECT o_custkey AS d, count(*) AS pages, sum(o_orderkey % 7) AS n FROM orders GROUP BY 1) AS p FULL JOIN (SELECT c_custkey AS d, count(*) AS chunks FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) AS c ON p.d = c.d""")
def job_totals(spark, sf_dir):
    pages = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 7).alias("n_rows"))
    return metadata.job_totals(pages, _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id")))


@query("SELECT sum(c_custkey % 2 + c_nationkey) = 0 AS idle FROM customer")
def queue_idle(spark, sf_dir):
    return metadata.queue_is_idle(_t(spark, sf_dir, "customer").select((F.col("c_custkey") % 2).alias("active"), F.col("c_nationkey").alias("reserved")))


@query("""
SELECT user_id AS job_id, event_type AS stage, count(*) AS n_events, sum(coalesce(floor((epoch_us(after) - epoch_us(ts)) / 1000), 0))::BIGINT AS total_ms FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) GROUP BY ALL""")
def stage_durations(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumnsRenamed({"user_id": "job_id", "event_type": "stage"})
    return metadata.stage_durations(events).select("job_id", "stage", "n_events", F.col("total_ms").cast("long").alias("total_ms"))


@query("""
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
  AND o_orderdate + INTERVAL 1000 DAY > TIMESTAMP '1999-06-01'""")
def valid_codes(spark, sf_dir):
    codes = _t(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    found = metadata.valid_codes(codes, 1000 * 1440, F.lit("1999-06-01").cast("timestamp"), user="o_custkey", created="o_orderdate", key="o_orderkey")
    return found.select("o_custkey", "o_orderkey", metadata.iso_time(F.col("o_orderdate")).alias("at"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%9%' OR c_mktsegment ILIKE '%build%'")
def interface_filter(spark, sf_dir):
    return metadata.matching(_t(spark, sf_dir, "customer"), " BUILD", "c_mktsegment").unionByName(metadata.matching(_t(spark, sf_dir, "customer").filter("NOT c_mktsegment ILIKE '%build%'"), "9", "c_name")).select("c_custkey", "c_name")


# ── table questions ─────────────────────────────────────────────────────────


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 200")
def group_count(spark, sf_dir):
    return table_qa.group_count(_t(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT sum(CASE WHEN g IN ('nam', 'male', 'm') THEN 1 ELSE 0 END)::BIGINT AS Nam, sum(CASE WHEN g IN ('nu', 'female', 'f') THEN 1 ELSE 0 END)::BIGINT AS \"Nữ\" FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'nam' ELSE 'nu' END AS g FROM customer)")
def gender_pivot(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").withColumn("Gioi_tinh", F.when(F.col("c_custkey") % 3 == 0, "Nam").otherwise("Nữ"))
    return table_qa.gender_count(table, profile.ColumnProfile("Gioi_tinh", "Gioi_tinh", "TEXT", "gender"))


_PART = [profile.ColumnProfile("p_partkey", "p_partkey", "INTEGER"), profile.ColumnProfile("p_name", "p_name", "TEXT"), profile.ColumnProfile("p_brand", "p_brand", "TEXT"), profile.ColumnProfile("p_size", "p_size", "INTEGER"), profile.ColumnProfile("p_retailprice", "p_retailprice", "REAL")]


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS s, round(avg(p_retailprice), 6) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size >= 10 AND lower(p_brand) LIKE '%brand%'")
def agg_filtered(spark, sf_dir):
    held = table_qa.filters_to_condition(_PART, [{"field": "p_size", "op": "gte", "value": "10"}, {"field": "p_brand", "op": "contains", "value": "Brand"}])
    rows = _t(spark, sf_dir, "part").filter(held)
    return rows.agg(F.count("*").alias("n"), F.sum("p_size").alias("s"), F.round(F.avg("p_retailprice"), 6).alias("a"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 1")
def extreme_row(spark, sf_dir):
    table = _t(spark, sf_dir, "part").withColumn("_row_idx", F.col("p_partkey"))
    return table_qa.extreme(table, _PART[4], "desc").select("p_partkey", "p_retailprice")


@query("SELECT round(sum(p_retailprice), 2) AS sum_p_retailprice, sum(p_size)::BIGINT AS sum_p_size FROM part WHERE p_size >= 10")
def aggregate_named(spark, sf_dir):
    held = table_qa.filters_to_condition(_PART, [{"field": "p_size", "op": "gte", "value": "10"}])
    found = table_qa.aggregate_named(_t(spark, sf_dir, "part"), _PART, "total of p retailprice and of p size", "sum", held)
    return found.withColumn("sum_p_retailprice", F.round("sum_p_retailprice", 2))


_SEARCH = "concat_ws(' ', p_name, p_brand, p_type)"


@query(f"SELECT p_partkey, {_SEARCH} AS search_text FROM part WHERE lower({_SEARCH}) LIKE '%brand%' AND lower({_SEARCH}) LIKE '%3%' ORDER BY p_partkey LIMIT 200")
def multi_keyword(spark, sf_dir):
    table = tabular.with_search_text(_t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]).withColumn("_row_idx", F.col("p_partkey"))
    return table_qa.search(table, ["brand", "3"]).select("p_partkey", "search_text")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE lower('%RING%') OR lower(p_name) LIKE '%w_dg%' ORDER BY p_partkey LIMIT 200")
def contains_lookup(spark, sf_dir):
    hit = T.contains_ignoring_case(F.col("p_name"), "RING") | T.contains_ignoring_case(F.col("p_name"), "w_dg")
    return _t(spark, sf_dir, "part").filter(hit).orderBy("p_partkey").limit(200).select("p_partkey", "p_name")


@query("""
WITH v AS (SELECT 'lang' AS c, trim(regexp_replace(lower(lang), '[^a-z0-9]+', ' ', 'g')) AS v FROM documents UNION ALL SELECT 'source', trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) FROM documents)
SELECT count(*) AS n FROM v WHERE v <> '' AND contains(' bao nhieu en ', ' ' || v || ' ') GROUP BY c, v ORDER BY len(string_split(v, ' ')) DESC, c, v LIMIT 1""")
def value_count(spark, sf_dir):
    """How many documents have the value that the question names."""
    schema = [profile.ColumnProfile("lang", "lang", "TEXT"), profile.ColumnProfile("source", "source", "TEXT")]
    return table_qa.value_count(_t(spark, sf_dir, "documents"), schema, "bao nhieu en")


@query("""
SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%customer#000000012%' ORDER BY c_custkey LIMIT 1""")
def fuzzy_lookup(spark, sf_dir):
    """The customer whose name is most like a misspelt one; the whole table is looked at."""
    table = _t(spark, sf_dir, "customer").withColumn("_row_idx", F.col("c_custkey"))
    return table_qa.most_similar(table, F.col("c_name"), "Custmer#000000012").select("c_custkey", "c_name")


@query("SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE text ILIKE '%the%' GROUP BY lang ORDER BY n DESC, lang LIMIT 200")
def model_sql(spark, sf_dir):
    """SQL as a model would write it: names in another case, LIKE, no limit."""
    sql = "SELECT LANG, count(*) AS n, max(N_Chars) AS longest FROM {t} WHERE text LIKE '%THE%' GROUP BY lang ORDER BY n DESC, lang;"
    return table_qa.run_sql(_t(spark, sf_dir, "documents"), sql)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND lower(l_returnflag) = 'r'")
def filter_ops(spark, sf_dir):
    schema = [profile.ColumnProfile("l_quantity", "l_quantity", "REAL"), profile.ColumnProfile("l_discount", "l_discount", "REAL"), profile.ColumnProfile("l_returnflag", "l_returnflag", "TEXT")]
    held = table_qa.filters_to_condition(schema, [{"field": "l_quantity", "op": "gt", "value": 45}, {"field": "l_discount", "op": "lte", "value": 0.02}, {"field": "l_returnflag", "op": "equals", "value": "%R%"}])
    return _t(spark, sf_dir, "lineitem").filter(held).select("l_orderkey", "l_linenumber")


@query("""
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS place FROM (
  SELECT "column", value, count(*) AS n FROM (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part) WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL)
QUALIFY place <= 200""")
def value_frequency(spark, sf_dir):
    counts = profile.unpivoted(_t(spark, sf_dir, "part"), ["p_brand", "p_type"]).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter("place <= 200")


@query("""
SELECT "column", count(*) AS n, count(value) AS non_empty, count(DISTINCT trim(regexp_replace(lower(strip_accents(value)), '[^a-z0-9]+', ' ', 'g'))) AS distinct_values FROM (
  SELECT 'c_name' AS "column", nullif(trim(c_name), '') AS value FROM customer UNION ALL SELECT 'c_mktsegment', nullif(trim(c_mktsegment), '') FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer) GROUP BY 1""")
def column_profile(spark, sf_dir):
    return profile.value_statistics(_t(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])


@query("""
SELECT substring(value, 1, 120) AS value, first_row FROM (
  SELECT arg_min(p_type, p_partkey) AS value, min(p_partkey) AS first_row FROM part GROUP BY trim(regexp_replace(lower(strip_accents(p_type)), '[^a-z0-9]+', ' ', 'g'))) ORDER BY first_row LIMIT 12""")
def sample_values(spark, sf_dir):
    return profile.sample_values(_t(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("SELECT count(*) AS n, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, round(avg(p_size), 6) AS mean FROM part")
def analysis_report(spark, sf_dir):
    table = _t(spark, sf_dir, "part").withColumn("_row_idx", F.col("p_partkey"))
    numbers = table_qa.analysis(table, _PART)["numbers"].select(F.get("p_size", F.lit(0)).alias("lo"), F.get("p_size", F.lit(1)).alias("hi"), F.round(F.get("p_size", F.lit(2)), 6).alias("mean"))
    return _one_row(spark, table_qa.count_rows(table), numbers)


@query("""
SELECT b + 1 AS page, (lo + 1) || '-' || (hi + 1) AS row_range, text FROM (
  SELECT c_custkey // 15 AS b, min(c_custkey) AS lo, max(c_custkey) AS hi,
    '| c_custkey | c_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY 1)""")
def row_range_pages(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row_idx"), "c_custkey", "c_name")
    return tabular.pages_of(table, "customer").select("page", "row_range", "text")


@query("""
SELECT lang AS sheet_name, doc_id // 15 + 1 AS page, min(doc_id) + 1 || '-' || max(doc_id) + 1 AS row_range,
  '| doc_id | origin | length |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || doc_id || ' | ' || replace(coalesce(source, ''), '|', '\\|') || ' | ' || coalesce(n_chars::VARCHAR, '') || ' |', chr(10) ORDER BY doc_id) AS text
FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, n_chars FROM documents) GROUP BY ALL""")
def sheet_pages(spark, sf_dir):
    """A workbook with a sheet for each language, whose rows are its documents: text pages of all sheets at once."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("sheet"), "source", "n_chars")
    cells = lambda row, *values: F.array(*[F.struct(row.cast("int").alias("row"), F.lit(i).alias("column"), v.cast("string").alias("value")) for i, v in enumerate(values)])
    rows = docs.select("sheet", cells(F.col("doc_id") + 1, F.col("doc_id"), F.col("source"), F.col("n_chars")).alias("cells"))
    heads = docs.select("sheet").distinct().select("sheet", cells(F.lit(0), F.lit("doc_id"), F.lit("origin"), F.lit("length")).alias("cells"))
    every = rows.unionByName(heads).select(F.lit("documents.xlsx").alias("source"), "sheet", F.inline("cells"))
    return tabular.sheet_pages(every).select("sheet_name", "page", "row_range", "text")


@query("""
SELECT sum(octet_length(encode(t)) + 1)::BIGINT AS n_bytes, count(*) AS n_lines, sum(length(regexp_replace(t, '[^0-9]', '', 'g')))::BIGINT AS n_digits, sum(length(regexp_replace(t, '[^a-z]', '', 'g')))::BIGINT AS n_small
FROM (SELECT coalesce(text, '') AS t FROM documents)""")
def byte_blocks(spark, sf_dir):
    """All texts, a line each, in files that are read back in blocks of 256 KB by separate tasks."""
    path = shared_dir(spark, "lines")
    _t(spark, sf_dir, "documents").select(F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("value")).write.text(path)
    plain = F.decode("content", "ISO-8859-1")
    count = lambda pattern: F.sum(F.regexp_count(plain, F.lit(pattern))).cast("long")
    blocks = ranges.byte_blocks(spark, path, block=256 * 1024)
    return blocks.agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"), count("\n").alias("n_lines"), count("[0-9]").alias("n_digits"), count("[a-z]").alias("n_small"))


@query("SELECT CASE WHEN avg(CASE WHEN regexp_matches(k, '^\\d+(\\.\\d+)?$') THEN 1 ELSE 0 END) > 0.8 THEN 'bigint' ELSE 'string' END AS key_type, 'string' AS name_type FROM (SELECT c_custkey::VARCHAR AS k FROM customer)")
def inferred_types(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))
    types = dict(tabular.typed(table, ["key", "name"]).dtypes)
    return spark.range(1).select(F.lit(types["key"]).alias("key_type"), F.lit(types["name"]).alias("name_type"))


# ── functions, sources, chunks ──────────────────────────────────────────────


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copies FROM documents")
def content_hashes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return docs.join(docs.groupBy("hash").agg(F.count("*").alias("copies")), "hash").select("doc_id", "hash", "copies")


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
  '(?m)^(\\s*)[•▪‣◦]\\s+', '\\1- ', 'g'), '(?m)^(\\s*)o\\s+', '\\1- ', 'g'), '``', ''), '(?mi)^\\s*(?:(?:Page|Trang)\\s+)?\\d+\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def sanitize_regex(spark, sf_dir):
    text = T.clean_page_numbers(T.clean_bullets(T.clean_control(F.coalesce("text", F.lit("")))))
    return _t(spark, sf_dir, "documents").select("doc_id", T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("text"))


@query()
def sanitize_markdown(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.sanitize_markdown(F.col("text")).alias("text"))


def _strip_sql() -> str:
    text = "coalesce(html, '')"
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, regexp_replace(regexp_replace({text}, '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages"


@query(_strip_sql())
def strip_tags_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html.raw_text(F.col("html")).alias("text"))


@query()
def main_content(spark, sf_dir):
    """The main content of all pages, else the next tier of the cascade."""
    pages = html.with_main_content(_t(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.col("main").isNotNull().alias("has_main"), html.html_text(F.col("html"), main=F.col("main")).alias("text"))


@query()
def html_to_markdown(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


@query()
def md_headings(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), html.html_to_markdown(F.col("html")).alias("text"))
    return chunking.heading_sections(pages)


def _parents(spark, sf_dir):
    pages = _t(spark, sf_dir, "documents").select(F.col("source"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.parents_of(pages)


@query()
def chunk_parents(spark, sf_dir):
    return _parents(spark, sf_dir)


@query()
def chunk_children(spark, sf_dir):
    return chunking.children_of(_parents(spark, sf_dir))


@query("SELECT 0::BIGINT AS too_long, 0::BIGINT AS orphans, true AS parents_fit")
def chunk_invariants(spark, sf_dir):
    """Parents and children are split once each and written: a core runs one Python worker at a time, not one for each."""
    parents = stored(_parents(spark, sf_dir), "parents")
    children = stored(chunking.children_of(parents).select("doc_id", F.length("text").alias("n_chars")), "children")
    long = children.agg(F.count_if(F.col("n_chars") > chunking.CHILD[0]).alias("too_long"))
    fit = parents.agg((F.max(F.length("text")) <= chunking.PARENT[0]).alias("parents_fit"))
    lost = chunking.orphans(children, parents).agg(F.count("*").alias("orphans"))
    return _one_row(spark, long, lost, fit)


@query("""
WITH s AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INTEGER & 63) | 128) || h[19:20] || '-' || h[21:32] AS uuid FROM s""")
def uuid5_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ids.uuid5(uuid.NAMESPACE_URL, F.concat(F.lit("doc:"), "doc_id")).alias("uuid"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 10 WHEN 1 THEN greatest(0, n - 50) ELSE 5 END::BIGINT AS "start", CASE doc_id % 3 WHEN 0 THEN least(99, n - 1) ELSE n - 1 END::BIGINT AS "end",
  CASE doc_id % 3 WHEN 0 THEN n > 10 WHEN 1 THEN n > 0 ELSE n > 5 END AS valid FROM (SELECT doc_id, n_chars AS n FROM documents)""")
def range_header(spark, sf_dir):
    header = F.element_at(F.array(F.lit("bytes=10-99"), F.lit("bytes=-50"), F.lit("bytes=5-")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", ids.range_bounds(header, F.col("n_chars")).alias("r")).select("doc_id", "r.start", "r.end", "r.valid")


_ADDRESSES = ("http://10.1.2.3/a", "http://user@h.com/", "https://localhost:8080", "http://172.20.1.1/x", "http://172.32.1.1/x", "http://[::1]/", "https://a.local", "ftp://x.com/", "http://8.8.8.8?q")


@query(f"""
SELECT page_id, coalesce(host <> '' AND length(u) <= 2048 AND NOT regexp_matches(u, '^https?://[^/]*@')
  AND NOT regexp_matches(host, '^(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|0\\.|172\\.(1[6-9]|2\\d|3[01])\\.|.*\\.local$)|^\\['), false) AS safe
FROM (SELECT page_id, u, lower(regexp_extract(u, '^https?://([^/:?#@]+)', 1)) AS host FROM (
  SELECT page_id, coalesce({list(_ADDRESSES)}[page_id % 20 + 1], url) AS u FROM pages))""")
def url_safety(spark, sf_dir):
    """Of each 20 pages some have an address of a kind that must not be fetched."""
    odd = F.get(F.array(*[F.lit(x) for x in _ADDRESSES]), (F.col("page_id") % 20).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", files.url_is_safe(F.coalesce(odd, "url")).alias("safe"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN make_date(2000 + (p_partkey % 20)::BIGINT, 1 + (p_partkey % 12)::BIGINT, 1 + (p_partkey % 28)::BIGINT)::TIMESTAMP END AS parsed FROM part")
def parse_dates(spark, sf_dir):
    y, m, d = 2000 + F.col("p_partkey") % 20, 1 + F.col("p_partkey") % 12, 1 + F.col("p_partkey") % 28
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat_ws("/", d, m, y)).when(F.col("p_partkey") % 4 == 2, F.concat_ws("-", y, m, d)).otherwise("no date")
    return _t(spark, sf_dir, "part").select("p_partkey", T.parse_date(text).cast("timestamp_ntz").alias("parsed"))


# ── writes, evaluation, streams ─────────────────────────────────────────────


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def soft_delete_rewrite(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.lit(None).cast("timestamp").alias("delete_requested_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("h").alias("content_hash"))
    job_rows = docs.select("document_id", F.lit("running").alias("status"))
    gone = _t(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    marked, _, _ = mutate.soft_delete(docs, job_rows, docs.select("document_id"), gone)
    return retrieval.live(marked).select(F.col("document_id").alias("doc_id"), "source")


@query("""
SELECT doc_id, CASE WHEN l.doc_id2 IS NULL THEN 'old' ELSE 'new' END AS state FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS doc_id2 FROM labels) AS l ON doc_id = doc_id2""")
def version_replace(spark, sf_dir):
    old = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("v1").alias("pipeline_version"), F.lit("old").alias("state"))
    new = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("v1").alias("pipeline_version"), F.lit("new").alias("state")).distinct()
    new = new.join(old.select("document_id"), "document_id", "left_semi")
    return mutate.replace_versions(old, new).select(F.col("document_id").alias("doc_id"), "state")


@query("""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, n_chars FROM documents), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT doc_id::VARCHAR AS document_id, 'v1' AS pipeline_version, CASE WHEN doc_id IN (FROM toxic) THEN 'new' ELSE lang END AS state, n_chars FROM t
UNION ALL SELECT doc_id::VARCHAR, 'v2', lang, n_chars FROM t WHERE doc_id NOT IN (FROM poor)""")
def versioned_replace(spark, sf_dir):
    """Two versions of all documents in a table by bucket and version; one version of the toxic ones is replaced, another of the poor ones deleted."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").withColumn("document_id", F.col("doc_id").cast("string"))
    first = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("v1").alias("pipeline_version"), F.coalesce("lang", F.lit("")).alias("state"), "n_chars")
    path = shared_dir(spark, "versions")
    versioned.create(first.unionByName(first.withColumn("pipeline_version", F.lit("v2"))), path, n_buckets=32)
    new = first.join(labels.filter("toxic = 1").select("document_id").distinct(), "document_id", "left_semi").withColumn("state", F.lit("new"))
    versioned.replace_versions(spark, path, new)
    versioned.delete_versions(spark, path, labels.filter("quality = 0").select("document_id", F.lit("v2").alias("pipeline_version")).distinct())
    return versioned.read(spark, path)


@query("SELECT count(*) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)) AS orders FROM customer WHERE c_nationkey >= 5")
def cascade_delete(spark, sf_dir):
    tables = {"customer": _t(spark, sf_dir, "customer"), "orders": _t(spark, sf_dir, "orders")}
    gone = _t(spark, sf_dir, "nation").filter("n_nationkey < 5").select("n_nationkey")
    left = mutate.cascade(tables, gone, [("customer", "c_nationkey", "c_custkey"), ("orders", "o_custkey", "o_orderkey")])
    return _one_row(spark, left["customer"].agg(F.count("*").alias("customers")), left["orders"].agg(F.count("*").alias("orders")))


@query("""
WITH m AS (SELECT source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT * FROM m UNION ALL SELECT '__mean__', round(avg(quality), 6), round(avg(toxic), 6) FROM m""")
def eval_mean_row(spark, sf_dir):
    joined = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return mutate.with_mean_row(joined.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")), "source")


@query("""
WITH r AS (SELECT source AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
g AS (SELECT source AS query_id, doc_id AS item_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT query_id, count(*) AS hits FROM r JOIN g USING (query_id, item_id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(hits, 0) / n, 6) AS recall FROM n LEFT JOIN h USING (query_id)""")
def precision_recall_at_k(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "item_id")))
    good = _t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"))
    return evaluate.precision_recall(ranked, docs.join(good, "item_id").select("query_id", "item_id"), 10)


@query("""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '\\S+\\s*') AS ts FROM conversations)
SELECT conv_id, turn, (len(ts) + 2)::BIGINT AS n_events FROM t""")
def token_stream(spark, sf_dir):
    return jobs.token_events(_t(spark, sf_dir, "conversations")).groupBy("conv_id", "turn").agg(F.count("*").alias("n_events"))


_STAGE = {"view": "parsing", "click": "chunking", "signup": "embedding", "purchase": "indexing"}


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 65 WHEN 'signup' THEN 80 WHEN 'purchase' THEN 94 ELSE 0 END AS reached FROM events),
g AS (SELECT *, sum(CASE WHEN gap >= 28800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS part FROM (
  SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM e)),
s AS (SELECT user_id AS job_id, max(reached)::INTEGER AS progress, count(*) AS n_events, max(ms) + 28800000 AS silent_at FROM g GROUP BY user_id, part)
SELECT * FROM s WHERE silent_at <= (SELECT max(ms) FROM e)""")
def stalled_jobs(spark, sf_dir):
    """A stream of events by user as a job's; a row for each time that one is silent for eight hours."""
    kinds = F.create_map(*[F.lit(x) for pair in _STAGE.items() for x in pair])
    work = shared_dir(spark, "stalled-jobs")
    landed = stored(_t(spark, sf_dir, "events"), "events", f"{work}/in")
    events = spark.readStream.schema(landed.schema).parquet(f"{work}/in").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("running").alias("status"), F.coalesce(kinds[F.col("event_type")], F.lit("none")).alias("stage"), F.lit(0.5).alias("ratio"), F.lit(False).alias("start"))
    write = lambda batch, n: batch.filter("kind = 'stalled'").write.mode("overwrite").parquet(f"{work}/out/batch={n}")
    with jobs.rocks_db(spark):
        jobs.watch_jobs(events, 8 * 3600).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.WATCHED).parquet(f"{work}/out").select("job_id", "progress", "n_events", F.unix_millis("at").alias("silent_at"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    counts = jobs.windowed_counts(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
