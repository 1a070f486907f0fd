"""Conversations and answers: scoped look-ups and appends, question rewriting, streamed answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.ids import uuid5

Model = Callable[[str], str]
Streamer = Callable[[str], Iterable[str]]


def owned(conversations: DataFrame, user_id: int, conversation_id: str, notebook_id: int | None = None) -> DataFrame:
    """The user's conversation, in that notebook if one is given; no rows where it is another's."""
    rows = conversations.filter((F.col("conversation_id") == conversation_id) & (F.col("owner_id") == user_id))
    return rows if notebook_id is None else rows.filter(F.col("notebook_id") == notebook_id)


def get_or_create(conversations: DataFrame, user_id: int, conversation_id: str | None, notebook_id: int | None, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> tuple[DataFrame, DataFrame]:
    """(all conversations, the one in question).  A foreign or unknown identifier is an error."""
    if conversation_id is not None:
        found = owned(conversations, user_id, conversation_id, notebook_id)
        if found.isEmpty():
            raise LookupError("no such conversation")
        return conversations, found
    spark = conversations.sparkSession
    n = conversations.filter(F.col("owner_id") == user_id).count()
    made = spark.createDataFrame([(user_id, notebook_id)], "owner_id int, notebook_id int").select(
        uuid5(namespace, F.lit(f"{user_id}/{notebook_id}/{n}")).alias("conversation_id"), "owner_id", "notebook_id", F.current_timestamp().alias("updated_at")
    )
    return conversations.unionByName(made, allowMissingColumns=True), made


def save_message(messages: DataFrame, conversations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones; their conversations' ``updated_at`` follows the latest."""
    latest = new.groupBy("conversation_id").agg(F.max("created_at").alias("_at"))
    touched = conversations.join(latest, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return messages.unionByName(new, allowMissingColumns=True), touched


def save_item(items: DataFrame, new: DataFrame, messages: DataFrame, conversations: DataFrame, user_id: int) -> DataFrame:
    """Items whose message lies in a conversation of the user and of the item's notebook are added."""
    scope = messages.join(conversations.filter(F.col("owner_id") == user_id), "conversation_id").select("message_id", "notebook_id")
    return items.unionByName(new.join(scope, ["message_id", "notebook_id"], "left_semi"), allowMissingColumns=True)


def rewrite(question: str, history: str, model: Model | None) -> str:
    """A question that stands alone; the original without history, without a model, or if it fails."""
    if not history or model is None:
        return question
    try:
        return model(f"{history}\n{question}").strip().strip("\"'").strip() or question
    except Exception:  # any failure of a plug-in leaves the question as it is
        return question


def stream_answer(prompt: str, providers: list[Streamer]) -> Iterator[dict]:
    """Events status, token…, final.  The next provider is tried only before the first token."""
    yield {"type": "status", "payload": "generating"}
    text = ""
    for provider in providers:
        try:
            for token in provider(prompt):
                text += token
                yield {"type": "token", "payload": token}
            break
        except Exception as error:  # reported as an event, as all of a stream's errors are
            if text:
                yield {"type": "final", "payload": text, "error": str(error)}
                return
    else:
        yield {"type": "final", "payload": "", "error": "no provider answered"}
        return
    yield {"type": "final", "payload": text}


def source_footer(contexts: DataFrame) -> DataFrame:
    """Distinct (source, page) of an answer's contexts, in order of rank."""
    return contexts.groupBy("source", "page").agg(F.min("rank").alias("rank")).orderBy("rank")


def ordered_parents(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents by identifier in the order of ``rank``; unknown identifiers are left out."""
    return parents.join(F.broadcast(ids), "doc_id").orderBy("rank")  # ids are a top-k result


def missing(document_ids: list[str], documents: DataFrame) -> list[str]:
    """The requested identifiers that are no document's."""
    wanted = documents.sparkSession.createDataFrame([(d,) for d in document_ids], "document_id string")
    return sorted(r["document_id"] for r in wanted.join(documents, "document_id", "left_anti").collect())
