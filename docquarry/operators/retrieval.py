"""Retrieval over chunks: scopes, dense and lexical search, fusion, reranking, roll-up to parents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docquarry.functions.text import tokenize
from docquarry.functions.vectors import cosine
from docquarry.shared_files import spread, stored

Reranker = Callable[[str, list[str], int], list[int]]

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Scores of questions and vectors that a task holds at a time in ``dense_many``.
TILE = 500_000


def in_scope(
    chunks: DataFrame, *, version: str | None = None, kind: str | None = "child", owner_id: int | None = None,
    notebook_id: int | None = None, document_ids: list[str] | None = None, community: bool = False,
) -> DataFrame:
    """The chunks a question may see.  An empty list of documents sees nothing, None sees all."""
    if document_ids is not None and not document_ids:
        return chunks.limit(0)
    conditions = [
        version is not None and (F.col("pipeline_version") == version),
        kind is not None and (F.col("kind") == kind),
        owner_id is not None and not community and (F.col("owner_id") == owner_id),
        notebook_id is not None and (F.col("notebook_id") == notebook_id),
        bool(document_ids) and F.col("document_id").isin(document_ids),
    ]
    for condition in conditions:
        if condition is not False:
            chunks = chunks.filter(condition)
    return chunks


def live(documents: DataFrame) -> DataFrame:
    return documents.filter("deleted_at IS NULL AND delete_requested_at IS NULL")


def dense_topk(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score, rank of the ``k`` highest cosine similarities, ties by id.

    Filters on ``vectors`` run before any product; each task hands on its own best k only.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), literal).alias("score"))
    return _ranked(scored.orderBy(F.desc("score"), "id").limit(k), F.desc("score"), F.col("id"))


def dense_many(vectors: DataFrame, questions: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 8_000_000) -> DataFrame:
    """question_id, id, score, rank: the k highest cosine similarities of each (question_id, vector), ties by id.

    Questions go to all tasks in blocks of ``block_bytes``, a pass over the vectors each; a task hands on its best k
    of each question, so k rows a question and task are merged.  Products are made in tiles of ``TILE`` cells, so a
    task's memory does not grow with the questions or rows.  Scores are rounded to twelve places, so that equal
    vectors tie.  Vectors of another length than the question's, null, all zero or not finite are not found.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    found = None
    for block in _blocks(questions.select(F.col("question_id").cast("long"), F.col("vector").cast("array<double>")).orderBy("question_id"), block_bytes):
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_best_of_task(held, k), "question_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "question_id long, id long, score double")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(questions: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(identifiers, unit vectors) of questions that follow one another and have one length, ``block_bytes`` at most."""
    ids, vectors = [], []

    def block() -> tuple[np.ndarray, np.ndarray]:
        v = np.array(vectors)
        return np.array(ids, np.int64), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    for q in questions.toLocalIterator():
        if q["vector"] and any(q["vector"]):
            if ids and (len(q["vector"]) != len(vectors[0]) or 8 * len(vectors[0]) * (len(ids) + 1) > block_bytes):
                yield block()
                ids, vectors = [], []
            ids.append(q["question_id"])
            vectors.append(q["vector"])
    if ids:
        yield block()


def _best_of_task(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        scores, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        n_rows = max(1, min(1000, TILE // q.shape[1]))
        n_questions = TILE // n_rows
        for batch in batches if k > 0 else ():
            for start in range(0, batch.num_rows, n_rows):
                keys, x = _unit_rows(batch.slice(start, n_rows), q.shape[1])
                for at in range(0, len(q), n_questions):
                    some = slice(at, at + n_questions)
                    _keep_best(scores[some], ids[some], q[some] @ x.T, keys)
        found = np.isfinite(scores)
        columns = [np.repeat(q_ids, found.sum(1)), ids[found], scores[found]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["question_id", "id", "score"])

    return run


def _unit_rows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers, unit vectors) of the rows with a vector of that length that has a direction."""
    batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), length))
    x = np.array(batch.column(1).flatten().fill_null(np.nan), float).reshape(-1, length)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return batch.column(0).to_numpy()[good], x[good] / norm[good, None]


def _keep_best(scores: np.ndarray, ids: np.ndarray, got: np.ndarray, keys: np.ndarray) -> None:
    """Take those of ``got`` (question x row) that belong there into each question's best so far, in place."""
    k = scores.shape[1]
    least = scores[:, -1]
    if got.shape[1] > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(got, -k, 1)[:, -k])
    question, row = np.nonzero(got >= least[:, None] - 1e-11)  # rounding moves a score by less
    touched = np.unique(question)
    s = np.concatenate([np.round(got[question, row], 12), scores[touched].ravel()])
    i = np.concatenate([keys[row], ids[touched].ravel()])
    of = np.concatenate([question, np.repeat(touched, k)])
    order = np.lexsort((i, -s, of))
    best = order[np.searchsorted(of[order], touched)[:, None] + np.arange(k)]
    scores[touched], ids[touched] = s[best], i[best]


def _ranked(top: DataFrame, *order: Column) -> DataFrame:
    """Numbers the rows of a result that has k rows at most."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25_scores(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of the documents that hold a query term; a repeated term counts again.

    Okapi BM25; an inverse document frequency below zero is replaced by ``EPSILON`` times the mean over
    the vocabulary.  One pass over the text stores id, length and term counts of the documents with a
    query term and observes the statistics of all; the vocabulary is counted, in a second pass, only if
    some query term is in more than half of the documents.
    """
    wanted = list(dict.fromkeys(terms))
    words = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", tokenize(F.col("text")).alias("words"))
    count_of = lambda t: F.size(F.filter("words", lambda w: w == t))
    counted = words.select("id", F.size("words").alias("dl"), F.array(*[count_of(t) for t in wanted]).alias("tf"))
    seen = Observation()
    frequencies = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(wanted))]
    observed = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *frequencies)
    hits = stored(observed.filter(F.exists("tf", lambda x: x > 0)), "bm25-hits")
    n, avgdl = seen.get["n"], seen.get["avgdl"] or 1.0
    values = [math.log(n - df + 0.5) - math.log(df + 0.5) for df in (seen.get[f"df{i}"] for i in range(len(wanted)))]
    mean = _mean_idf(words, n) if any(v < 0 for v in values) else 0.0
    length = K1 * (1 - B + B * F.col("dl") / avgdl)
    score = F.lit(0.0)
    for i, (t, value) in enumerate(zip(wanted, values)):
        idf, tf = EPSILON * mean if value < 0 else value, F.get("tf", F.lit(i))
        score = score + F.lit(idf * terms.count(t)) * tf * (K1 + 1) / (tf + length)
    return hits.select("id", score.alias("score"))


def _mean_idf(words: DataFrame, n: int) -> float:
    """The mean over the vocabulary; only document frequencies are shuffled, added up per task first."""
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0


def overlap_scores(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: how many of the document's words are query terms."""
    hits = F.size(F.filter(tokenize(F.col("text")), lambda t: t.isin(terms)))
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", hits.cast("double").alias("score")).filter("score > 0")


def lexical_topk(docs: DataFrame, query: str | list[str], k: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, rank by BM25; where no score is above zero, by overlap."""
    terms = query if isinstance(query, list) else query_terms(docs, query)
    best = lambda scores: scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(k).collect()
    top = best(bm25_scores(docs, terms, id_col=id_col, text_col=text_col)) if terms else []
    top = top or best(overlap_scores(docs, terms or [""], id_col=id_col, text_col=text_col))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, score double, rank int"
    return docs.sparkSession.createDataFrame([(r["id"], r["score"], i + 1) for i, r in enumerate(top)], schema)  # k rows


def query_terms(docs: DataFrame, query: str) -> list[str]:
    return docs.sparkSession.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]


def first_positions(candidates: DataFrame, key: str = "key", rank: str = "rank") -> DataFrame:
    """A repeated key keeps its first position; later items do not move up."""
    return candidates.groupBy(key).agg(F.min(rank).alias(rank))


def rrf(lists: list[tuple[DataFrame, float]], key: str = "key", k: int = RRF_K) -> DataFrame:
    """key, rrf (to eight places), score (as added up), first_list, first_rank: weighted reciprocal rank fusion of (key, rank) lists."""
    parts = [first_positions(frame, key).select(key, "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("src")) for i, (frame, w) in enumerate(lists)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = F.min(F.struct("src", "rank"))
    fused = every.groupBy(key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), first.alias("first"))
    return fused.select(key, F.round("score", 8).alias("rrf"), "score", F.col("first.src").alias("first_list"), F.col("first.rank").alias("first_rank"))


def top_fused(fused: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k best, ties by where a key was first seen."""
    order = [F.desc("score"), F.col("first_list"), F.col("first_rank"), F.col(key)]
    return _ranked(fused.orderBy(*order).limit(k), *order)


def hybrid_topk(
    docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], *, dense_k: int = 5, sparse_k: int = 10,
    dense_weight: float = 0.7, sparse_weight: float = 0.3, k: int = 3,
) -> DataFrame:
    """key, rrf, rank of the fused dense and lexical candidates (``vec_id`` and ``doc_id`` are one key)."""
    dense = dense_topk(vectors, query, dense_k).select(F.col("id").alias("key"), "rank")
    sparse = lexical_topk(docs, terms, sparse_k).select(F.col("id").alias("key"), "rank")
    return top_fused(rrf([(dense, dense_weight), (sparse, sparse_weight)]), k)


def union_candidates(lists: list[DataFrame], key: str = "key", rank: str = "rank") -> DataFrame:
    """key, rank: the lists one after another, a key only where it comes first; ranks run through."""
    every = None
    for i, frame in enumerate(lists):
        part = first_positions(frame, key, rank).select(key, F.struct(F.lit(i).alias("src"), F.col(rank).alias("at")).alias("place"))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy(key).agg(F.min("place").alias("place"))
    return first.select(key, F.row_number().over(Window.orderBy("place", key)).alias(rank))  # a few candidates


def diversify(candidates: DataFrame, k: int, *, parent: str = "parent", position: str = "position") -> DataFrame:
    """The best child of each parent first, then the other children, ``k`` in all."""
    nth = F.row_number().over(Window.partitionBy(parent).orderBy(position))
    order = [F.col("later"), F.col(position)]
    return _ranked(candidates.withColumn("later", nth > 1).orderBy(*order).limit(k), *order).drop("later")


def rerank(candidates: DataFrame, query: str, reranker: Reranker | None, k: int, *, text: str = "text", parent: str = "parent") -> DataFrame:
    """parent, rank: parents in the reranker's order, then the rest in the candidates' order.

    ``candidates`` has a few rows with ``rank``.  The reranker returns positions; unknown and repeated
    ones are ignored.  If it fails or is None, the candidates' order stands.
    """
    rows = candidates.orderBy("rank").collect()  # at most the k of ``diversify``
    order: list[int] = []
    if reranker:
        try:
            order = [i for i in dict.fromkeys(reranker(query, [r[text] for r in rows], len(rows))) if isinstance(i, int) and 0 <= i < len(rows)]
        except Exception:  # any failure of a plug-in leaves the baseline
            order = []
    parents = list(dict.fromkeys([rows[i][parent] for i in order] + [r[parent] for r in rows]))[:k]
    schema = f"{parent} {candidates.schema[parent].dataType.simpleString()}, rank int"
    return candidates.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(parents)], schema)


def roll_up(hits: DataFrame, parents: DataFrame, documents: DataFrame | None = None, *, parent: str = "parent_id") -> DataFrame:
    """Each parent with the best score of its children; with ``documents``, live ones only.

    ``hits`` (parent, score) are a top-k result.  Order: scores from high to low, nulls last, parent.
    """
    best = hits.groupBy(parent).agg(F.max("score").alias("score"))
    found = parents.join(F.broadcast(best), parent)
    if documents is not None:
        found = found.join(live(documents), "document_id")
    return found.orderBy(F.desc_nulls_last("score"), parent)


def retrieve(
    chunks: DataFrame, parents: DataFrame, documents: DataFrame | None, query: list[float], k: int, *, id_col: str = "chunk_id",
    vector_col: str = "vector", parent: str = "parent_id", ordered: bool = True, **scope,
) -> DataFrame:
    """From a question's vector to contexts: the scope's ``k`` best chunks, rolled up to parents of live documents.

    ``scope`` is that of ``in_scope``.  Not ``ordered``, the parents come as a set without scores.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    scoped = in_scope(chunks, **scope)
    hits = dense_topk(scoped, query, k, id_col=id_col, vector_col=vector_col)
    with_parent = scoped.select(F.col(id_col).alias("id"), parent).join(F.broadcast(hits), "id")  # k rows
    found = roll_up(with_parent, parents, documents, parent=parent)
    return found if ordered else found.drop("score")


def choose_retriever(vectors: DataFrame | None, docs: DataFrame | None, *, reranker: Reranker | None = None, hybrid: bool = True) -> str:
    """``rerank`` where there is a reranker, else ``hybrid`` where it is wanted and there are texts, else ``dense``."""
    if vectors is None or vectors.isEmpty():
        raise ValueError("there are no vectors to search")
    if reranker is not None and docs is not None:
        return "rerank"
    return "hybrid" if hybrid and docs is not None else "dense"


def context_block(contexts: DataFrame, order: str = "rank") -> DataFrame:
    """One row: ``[Cn] source=… page=… doc_id=… chunk_id=…`` and the text, joined by rules."""
    head = F.concat(
        F.lit("[C"), F.col(order), F.lit("] source="), F.col("source"), F.lit(" page="), F.col("page"), F.lit(" doc_id="), F.col("doc_id"),
        F.lit(" chunk_id="), F.col("chunk_id"), F.lit("\n"), F.col("text"),
    )
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), head.alias("block"))))
    return contexts.agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n---\n\n").alias("context"))


def citations(contexts: DataFrame, order: str = "rank", snippet: int = 280) -> DataFrame:
    """citation_id C1…, first occurrence of (document_id, chunk_id, source, page) only."""
    keys = ["document_id", "chunk_id", "source", "page"]
    first = contexts.groupBy(*keys).agg(F.min(F.struct(order, "text")).alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("first." + order)))  # rows of one answer
    return numbered.select(F.concat(F.lit("C"), "n").alias("citation_id"), F.col("n").alias("rank"), *keys, F.substring("first.text", 1, snippet).alias("snippet"))


def cited_ids(answer: Column) -> Column:
    """Distinct citation ids in an answer in order of appearance, upper-case; ``[C2, C5]`` counts both."""
    marks = F.regexp_extract_all(answer, F.lit(r"(?i)\[\s*C\d+(?:\s*,\s*C\d+)*\s*\]"), F.lit(0))
    ids = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(F.upper(m), F.lit(r"C\d+"), F.lit(0))))
    return F.array_distinct(ids)


def normalize_markers(answer: Column, known: Column) -> Column:
    """Each ``[C2, C5]`` becomes its first id that is known; marks without one disappear."""
    mark = r"(?i)\[\s*C\d+(?:\s*,\s*C\d+)*\s*\]"
    marks = F.regexp_extract_all(answer, F.lit(mark), F.lit(0))
    texts = F.split(answer, mark, -1)

    def first_known(m: Column) -> Column:
        ids = F.filter(F.regexp_extract_all(F.upper(m), F.lit(r"C\d+"), F.lit(0)), lambda i: F.array_contains(known, i))
        return F.when(F.size(ids) > 0, F.concat(F.lit("["), F.get(ids, F.lit(0)), F.lit("]"))).otherwise(F.lit(""))

    return F.array_join(F.zip_with(texts, F.transform(marks, first_known), lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def used_citations(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """answer_id and the citations whose id appears in the answer (none where it has no mark)."""
    used = answers.select("answer_id", F.explode(cited_ids(F.col("answer"))).alias("citation_id"))
    return used.join(cites, "citation_id")


def unknown_citations(answers: DataFrame, cites: DataFrame) -> DataFrame:
    used = answers.select("answer_id", F.explode(cited_ids(F.col("answer"))).alias("citation_id"))
    return used.join(cites.select("citation_id").distinct(), "citation_id", "left_anti")
