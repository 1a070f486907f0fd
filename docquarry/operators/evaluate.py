"""Retrieval quality per question, without a judge model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hits, precision, recall among the first ``k`` ranks; queries without relevant items have no row."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "item_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    both = n.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return both.select("query_id", "hits", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"))


def records(path_frame: DataFrame, contexts: DataFrame) -> DataFrame:
    """question, ground_truth and the retrieved contexts in order of rank."""
    found = contexts.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]).alias("contexts"))
    return path_frame.join(found, "question", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
