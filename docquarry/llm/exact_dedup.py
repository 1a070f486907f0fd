"""Exact deduplication by a stateful stream.

A record (digest, identifier, content locator) per row runs through a streaming aggregation
keyed by the digest.  Its state is kept by RocksDB on disk, checkpointed in the shared folder,
and has no watermark, so nothing expires: per key it retains the digest, the largest identifier,
the locator of that row's content and the number of rows.  Partial aggregation in each task
leaves one record of a digest per task, however many copies there are.

A row whose digest is shared is a hit.  Hits fetch their text by locator and compare all bytes
with the retained row's; texts that differ under one digest are grouped anew by the whole text.
Large groups are cut into ``salt_rows`` rows before they meet the retained text.

The state outlives a call where ``state_dir`` names a folder for it: the next delivery meets it.

Defined results: null text equals empty text; the row with the largest identifier stays (null
identifiers last; of repeated rows with one identifier, the one with the largest locator);
an empty table gives an empty result; very long texts are hashed and compared whole.  Columns besides
identifier and text are not read, whatever their names.

Everything here is DataFrame and Structured Streaming API; no Python runs on executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_name, shared_dir, stored, text_of

#: State on disk; no space set aside ahead, changes logged instead of whole snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


LOST = "the text of a row that stays is not among the given rows; pass those of earlier deliveries"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator(frame: DataFrame) -> Column:
    meta = frame.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def located(frame: DataFrame) -> DataFrame:
    """``frame`` if it reads Parquet files, whose rows have a place; else a copy of it that does."""
    try:
        frame.select(_locator(frame).alias("place"))
    except AnalysisException:
        return stored(frame, "located")
    return frame


def _records(frame: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, locator (file, row in it), text, digest of a frame that reads files."""
    return frame.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        _locator(frame).alias("locator"),
        text_of(text_col).alias("text"),
    ).withColumn("digest", digest(F.col("text")))


def keyed_state(records: DataFrame) -> DataFrame:
    """The state by digest: keep (identifier and locator of the row that stays) and group_size."""
    return records.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))


def run_stream(stream: DataFrame, work: str) -> DataFrame:
    """Run the stream over all that is new; one row per digest that it has, as it stands at the end."""
    spark, batches = stream.sparkSession, []
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        state = keyed_state(stream)

        def emit(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/updates/batch={batch_id}")
            batches.append(f"{work}/updates/batch={batch_id}")

        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{work}/stream").foreachBatch(emit).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(_ddl(state)).parquet(*batches) if batches else spark.createDataFrame([], _ddl(state))
    # A digest appears once for each batch that touched it; the last one tells the state.  Written, it
    # comes to the join by a shuffle of its own, and Spark can split a large group on the other side.
    return stored(updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size")), "dedup-state")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int | None = None, salt_rows: int = 2048, state_dir: str | None = None, earlier: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, locator, keep_id, keep_locator, group_size, kept, digest.

    Rows that do not come from Parquet files are written to the shared folder first.  Records (no texts) are
    written to the shared folder and streamed from there, ``files_per_batch`` files in a micro-batch (all in
    one where it is None).

    With ``state_dir`` the state stays there and later calls continue it: each delivery is judged against
    all before it, whose rows, read from the same files as then, are ``earlier`` (their texts are compared on
    hits).  A row of an earlier delivery that a new one replaces is named by no result; ``keep_id`` tells.
    """
    spark = docs.sparkSession
    work = state_dir or shared_dir(spark, "exact-dedup")
    docs = located(docs)
    rows = _records(docs, id_col, text_col, digest)
    slim = ["doc_id", "locator", "digest"]
    spool, delivery = f"{work}/records", uuid.uuid4().hex
    rows.select(*slim, F.lit(delivery).alias("delivery")).write.mode("append").parquet(spool)
    schema = f"{_ddl(rows.select(*slim))}, delivery string"
    records = spark.read.schema(schema).parquet(spool).filter(F.col("delivery") == delivery).drop("delivery")
    reader = spark.readStream.schema(schema)
    source = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(spool).drop("delivery")
    hits = run_stream(source, work).filter("group_size > 1")
    found = stored(
        records.join(hits, "digest", "left").select(
            *slim,
            F.coalesce(F.col("keep.doc_id"), F.when(F.col("keep").isNull(), F.col("doc_id"))).alias("keep_id"),
            F.coalesce("keep.locator", "locator").alias("keep_locator"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        ),
        "dedup-found",
    )
    every = rows if earlier is None else rows.unionByName(_records(earlier, id_col, text_col, digest))
    differ = _differing(every, found, salt_rows)
    if not differ.isEmpty():
        found = _split(rows, every, found, differ)
    return found.withColumn("kept", F.col("locator") == F.col("keep_locator"))


def _differing(rows: DataFrame, found: DataFrame, salt_rows: int) -> DataFrame:
    """Digests under which a hit's bytes are not those of the row that stays (or these are not to be had)."""
    hits = found.filter("group_size > 1")
    wanted = hits.select("locator").union(hits.select("keep_locator")).distinct()
    texts = stored(rows.select("locator", "text").join(wanted, "locator"), "dedup-hits")
    members = hits.select("locator", F.col("digest").alias("key"), "keep_locator", "group_size")
    n_salts = F.ceil(F.col("group_size") / salt_rows).cast("int")
    salted = texts.join(members, "locator").withColumn("salt", F.pmod(F.xxhash64("locator"), n_salts).cast("int"))
    keepers = members.select("key", F.col("keep_locator").alias("locator"), "group_size").distinct()
    kept = texts.join(keepers, "locator").select("key", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"), F.col("text").alias("kept_text"))
    compared = salted.filter("locator <> keep_locator").join(kept, ["key", "salt"], "left").filter("NOT text <=> kept_text")
    unlike = compared.groupBy("key").agg(F.max(F.col("kept_text").isNull()).alias("lost"))
    return stored(unlike.select(F.col("key").alias("digest"), F.when(F.col("lost"), F.raise_error(F.lit(LOST))).cast("string").alias("lost")), "dedup-differ").drop("lost")


def _split(rows: DataFrame, every: DataFrame, found: DataFrame, differ: DataFrame) -> DataFrame:
    """Group the rows under colliding digests by their whole texts."""
    slim = ["doc_id", "locator", "digest"]
    groups = every.join(differ, "digest", "left_semi").groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
    again = rows.join(differ, "digest", "left_semi").join(groups, ["digest", "text"]).select(*slim, F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), "group_size")
    return found.join(differ, "digest", "left_anti").unionByName(again)


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that a copy with a larger identifier replaces; all columns stay, whatever their names."""
    docs = located(docs)
    place = fresh_name("place", docs)
    dropped = exact_dedup(docs, **options).filter("NOT kept").select(F.col("locator").alias(place))
    return docs.withColumn(place, _locator(docs)).join(dropped, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
