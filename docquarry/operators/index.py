"""A stored inverted index, and BM25 for many questions in one go.

``build_index`` reads the texts once.  The index is a folder of

* ``postings``: a row for each term and block of documents (some that a task read one after another), in partitions by a
  hash of the term: the term's documents of that block with count and length, and what bounds the term's part of a score there;
* ``statistics``: one row: documents, mean length, the vocabulary's mean inverse document frequency, layout.

``bm25_many`` reads the partitions of its terms only and no text.  The most that each block can give a question
is the sum over its terms.  The blocks that promise most are scored first; their k-th score is a bound that
others must reach to be scored at all.  A task adds up the posting lists of one block and hands on k rows a
question.  Scores are those of ``retrieval.bm25_scores`` (but for the rounding of
logarithms); their parts are added in the order of the question's terms, so equal documents tie.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.functions.text import tokenize
from docquarry.operators.retrieval import EPSILON, K1, B
from docquarry.shared_files import shared_dir, spread, stored

#: Blocks of each question that are scored before the others are judged.
PROBED = 4
#: Weighted terms of questions that a task holds next to a block's posting lists.
SLICE_ROWS = 50_000


def _most(mean: float):
    """No less than a term adds to a score in a block, without its inverse document frequency."""
    return F.lit(K1 + 1) / (1 + K1 * (1 - B) / F.col("most_tf") + F.lit(K1 * B / mean) * F.col("least_dl"))


def _block_postings(docs: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """The posting list of each term of a block's documents (id, words)."""
    dl = docs["words"].value_lengths().to_numpy()
    coded = docs["words"].flatten().dictionary_encode()
    pairs = coded.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl)
    pairs.sort()
    at = np.flatnonzero(np.diff(pairs, prepend=-1))  # equal words of a document lie next to each other
    tf = np.diff(at, append=len(pairs)).astype(np.int32)
    term, doc = np.divmod(pairs[at], max(len(dl), 1))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = pa.array(np.append(first, len(term)), pa.int32())
    lists = {"id": docs["id"].take(pa.array(doc)), "tf": pa.array(tf), "dl": pa.array(dl[doc].astype(np.int32))}
    return pa.RecordBatch.from_pydict({
        "term": coded.dictionary.take(pa.array(term[first])), "block": pa.array(np.full(len(first), block)), **{c: pa.ListArray.from_arrays(ends, v) for c, v in lists.items()},
        "n": pa.array(np.diff(first, append=len(term))), "most_tf": pa.array(np.maximum.reduceat(tf, first)), "least_dl": pa.array(np.minimum.reduceat(dl[doc] / tf, first)),
    })


def _postings(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of documents (id, words): posting lists by block.  A block is at most ``block_docs`` documents of one of Spark's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for start in range(0, len(batch), block_docs):
                yield _block_postings(batch.slice(start, block_docs), next(blocks))

    return run


def _score_block(mean: float, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block's posting lists and the weighted terms of questions: each question's k best documents of the block."""

    def run(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        ids = lists["id"].combine_chunks()
        coded = ids.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))  # documents are numbered in the order of their identifiers
        at = place[coded.indices.to_numpy()]
        tf, dl = (lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("tf", "dl"))
        ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        span = {term: (end - n, end) for term, end, n in zip(lists["term"].to_pylist(), ends.tolist(), ids.value_lengths().to_pylist())}
        below = tf + K1 * (1 - B + B * dl / mean)
        terms = sorted(zip(wanted["question_id"].to_pylist(), wanted["pos"].to_pylist(), wanted["term"].to_pylist(), wanted["w"].to_pylist()))
        questions, found, scores = [], [], []
        for question, of_question in groupby(terms, key=lambda t: t[0]):
            total = np.zeros(len(order))
            for _, _, term, w in of_question:
                if term in span:
                    a, b = span[term]
                    total[at[a:b]] += w * tf[a:b] * (K1 + 1) / below[a:b]
            good = np.flatnonzero(total > 0)
            if len(good) > k:
                good = good[total[good] >= np.partition(total[good], -k)[-k]]
            good = good[np.argsort(-total[good], kind="stable")][:k]
            questions += [question] * len(good)
            found.append(good)
            scores.append(total[good])
        best = np.concatenate(found) if found else np.zeros(0, np.int64)
        id_column = coded.dictionary.take(order).take(pa.array(best))
        score_column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
        return pa.table([pa.array(questions, wanted.schema.field("question_id").type), id_column, score_column], ["question_id", "id", "score"])

    return run


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 1024, n_buckets: int = 32) -> str:
    """Write the index of ``docs`` (identifiers are unique) to ``path``."""
    spark, seen = docs.sparkSession, Observation()
    words = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", tokenize(F.col("text")).alias("words"))
    words = words.observe(seen, F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))
    id_type = words.schema["id"].dataType.simpleString()
    # Posting lists are made where the documents are read: neither texts nor postings are shuffled.
    postings = words.mapInArrow(_postings(block_docs), f"term string, block long, id array<{id_type}>, tf array<int>, dl array<int>, n long, most_tf int, least_dl double")
    placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int"))
    placed.sortWithinPartitions("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    n, mean = (0, 1.0) if docs.isEmpty() else (seen.get["n"], seen.get["mean"] or 1.0)  # of an empty table nothing is observed
    df = spark.read.schema(placed.schema).parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    mean_idf = df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
    row = [(n, float(mean), float(mean_idf), n_buckets, placed.schema.json())]
    spark.createDataFrame(row, "n long, mean double, mean_idf double, n_buckets int, postings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return path


def bm25_many(spark: SparkSession, path: str, questions: DataFrame, k: int, *, question_col: str = "question_id", terms_col: str = "terms") -> DataFrame:
    """question_id, id, score, rank: for each (question_id, terms) the k documents with the highest scores above zero, ties by id."""
    work = shared_dir(spark, "bm25-many")
    about = spark.read.parquet(f"{path}/statistics").first()
    postings = spark.read.schema(StructType.fromJson(json.loads(about["postings"]))).parquet(f"{path}/postings")
    term = questions.select(F.col(question_col).alias("question_id"), F.posexplode(terms_col).alias("pos", "term"))
    term = term.groupBy("question_id", "term").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))
    asked = stored(term.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(about["n_buckets"])).cast("int")), "asked", f"{work}/asked")
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # n_buckets at most
    postings = postings.filter(F.col("bucket").isin(buckets))

    asked_postings = postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    heads = stored(asked_postings.select("bucket", "term", "block", "n", _most(about["mean"]).alias("most")), "heads", f"{work}/heads")
    raw = F.log(F.lit(float(about["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.when(raw < 0, F.lit(EPSILON * about["mean_idf"])).otherwise(raw).alias("idf"))
    weights = stored(asked.join(idf, "term").withColumn("w", F.col("idf") * F.col("times")), "weights", f"{work}/weights")
    bounds = heads.join(weights, ["bucket", "term"]).groupBy("question_id", "block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("most")).alias("bound"))
    by_bound = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    bounds = stored(bounds.withColumn("place", F.row_number().over(by_bound)), "bounds", f"{work}/bounds")

    slices = -(-weights.count() // SLICE_ROWS) or 1
    part = F.pmod(F.xxhash64("question_id"), F.lit(slices)).cast("int")
    asked_postings = asked_postings.select("block", "term", "id", "tf", "dl")
    id_type, question_type = asked_postings.schema["id"].dataType.elementType, weights.schema["question_id"].dataType
    result = f"question_id {question_type.simpleString()}, id {id_type.simpleString()}, score double"

    def scored(blocks: DataFrame) -> DataFrame:
        """question_id, id, score of the k best documents of each of some (question_id, block)."""
        wanted = blocks.select("question_id", "block").join(weights, "question_id").select("block", part.alias("part"), "question_id", "term", "pos", "w")
        lists = asked_postings.join(wanted.select("block", "part").distinct(), "block")
        lists = lists.toDF(*lists.columns)  # columns of its own, as both sides come from the same questions
        return lists.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInArrow(_score_block(about["mean"], k), result)

    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = stored(top(scored(bounds.filter(F.col("place") <= PROBED))), "first", f"{work}/first")
    reached = first.filter(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
    # The bound is a sum in another order than the score: the last digits may differ.
    hopeful = bounds.filter(F.col("place") > PROBED).join(reached, "question_id", "left").filter(F.col("least").isNull() | (F.col("bound") * (1 + 1e-12) >= F.col("least")))
    return top(first.drop("rank").unionByName(scored(hopeful)))
