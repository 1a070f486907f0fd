"""Writes: upserts, versioned replacement, soft and cascading deletes, copies, schema migration.

Tables are folders of Parquet.  A rewrite never reads and overwrites one path in one job: the new
state goes to a sibling folder, which then takes the table's place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.ids import uuid5
from docquarry.operators.metadata import latest_per_group


def swap_in(table: DataFrame, path: str) -> None:
    """Write ``table`` beside ``path`` and move it there.

    After a crash between the two moves the last state is at ``path``.old and the new one at ``path``.new;
    ``recover`` puts the new one in place.
    """
    spark = table.sparkSession
    jvm = spark._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    table.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        _moved(fs, target, old)
    _moved(fs, new, target)
    fs.delete(old, True)


def _moved(fs, source, target) -> None:
    """Some file systems only say no."""
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a ``swap_in`` that ended between its moves; whether there was one."""
    jvm = spark._jvm
    target, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.new/_SUCCESS"))
    if fs.exists(target) or not (whole or fs.exists(old)):
        return False
    _moved(fs, new if whole else old, target)
    fs.delete(old, True)
    return True


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace those of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def check_vectors(vectors: DataFrame, dim: int | None = None, vector_col: str = "vector") -> DataFrame:
    """The rows, with an error at run time for a vector of another length than ``dim`` (or the first's)."""
    if dim is None:
        first = vectors.select(F.size(vector_col).alias("d")).head(1)
        dim = first[0]["d"] if first else 0
    wrong = F.concat(F.lit("vector of length "), F.size(vector_col), F.lit(f" in a collection of {dim}"))
    return vectors.withColumn(vector_col, F.when(F.size(vector_col) == dim, F.col(vector_col)).otherwise(F.raise_error(wrong).cast(vectors.schema[vector_col].dataType)))


def point_ids(chunks: DataFrame, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> DataFrame:
    """Deterministic identifiers of vectors from document, version and chunk."""
    return chunks.withColumn("point_id", uuid5(namespace, F.concat_ws(":", "document_id", "pipeline_version", "chunk_id")))


def delete_version(rows: DataFrame, document_id, version) -> DataFrame:
    return rows.filter(~((F.col("document_id") == document_id) & (F.col("pipeline_version") == version)))


def ensure_collection(points: DataFrame, dim: int, payload: tuple[str, ...] = ("document_id", "pipeline_version", "kind"), vector_col: str = "vector") -> DataFrame:
    """``points``, with an error if a payload column is missing and one at run time for a vector of another length."""
    if missing := [c for c in (*payload, vector_col) if c not in points.columns]:
        raise ValueError(f"the collection lacks {', '.join(missing)}")
    return check_vectors(points, dim, vector_col)


def delete_document(rows: DataFrame, document_id) -> DataFrame:
    """All rows but those of a document, whatever their version."""
    return rows.filter(~F.coalesce(F.col("document_id") == F.lit(document_id), F.lit(False)))


def replace_document(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New contents under the same identifiers: (documents, jobs, chunks).

    ``uploads`` has document_id, filename, content_hash and job_id; of several for one document the one with the
    largest job_id counts.  Identifier and object key stay, a mark of
    deletion goes; each gets a queued job; chunks of the old content go.
    """
    uploads = latest_per_group(uploads, ["document_id"], F.desc("job_id"))
    fresh = uploads.select("document_id", F.col("filename").alias("new_name"), F.col("content_hash").alias("new_hash"))
    joined = documents.join(fresh, "document_id", "left")
    hit = F.col("new_hash").isNotNull()
    replaced = joined.withColumns({
        "filename": F.when(hit, F.col("new_name")).otherwise(F.col("filename")), "content_hash": F.when(hit, F.col("new_hash")).otherwise(F.col("content_hash")),
        "deleted_at": F.when(~hit, F.col("deleted_at")), "delete_requested_at": F.when(~hit, F.col("delete_requested_at")),
    }).drop("new_name", "new_hash")
    known = uploads.join(documents, "document_id", "left_semi")
    queued = known.select("job_id", "document_id", F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress"))
    return replaced, jobs.unionByName(queued, allowMissingColumns=True), chunks.join(known.select("document_id"), "document_id", "left_anti")


def reingest_sheets(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue of tables with the rows of ``new``; earlier rows of the same document and sheet go."""
    return upsert(catalogue, new, ["document_id", "sheet_name"])


def copy_notebook(documents: DataFrame, namespace: uuid.UUID, notebook_id: str, owner_id: int) -> tuple[DataFrame, DataFrame]:
    """(copies of the live documents under new identifiers in the notebook, a queued job for each)."""
    copies = copy_rows(documents.filter("deleted_at IS NULL"), "document_id", namespace, notebook_id=notebook_id, owner_id=owner_id)
    job = uuid5(namespace, F.concat(F.lit("job:"), F.col("document_id")))
    return copies, copies.select(job.alias("job_id"), "document_id", F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress"))


def required(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows, with NUL characters taken out of texts and an error at run time for an empty required value."""
    clean = rows.withColumns({c: F.translate(c, "\x00", "") for c, t in rows.dtypes if t == "string"})
    for c in columns:
        empty = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        clean = clean.withColumn(c, F.when(~empty, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is required")).cast(rows.schema[c].dataType)))
    return clean


def replace_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the (document, version) pairs that ``new`` has are replaced by its own."""
    return upsert(old, new, ["document_id", "pipeline_version"])


def soft_delete(documents: DataFrame, jobs: DataFrame, chunks: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents marked deleted and without hash, their active jobs cancelled, chunks without theirs)."""
    gone = document_ids.select("document_id", F.lit(True).alias("_gone")).distinct()
    marked = documents.join(gone, "document_id", "left")
    now = F.current_timestamp()
    marked = marked.withColumns({
        "delete_requested_at": F.when(F.col("_gone"), F.coalesce("delete_requested_at", now)).otherwise(F.col("delete_requested_at")),
        "deleted_at": F.when(F.col("_gone"), now).otherwise(F.col("deleted_at")),
        "content_hash": F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("content_hash")),
    }).drop("_gone")
    cancelled = jobs.join(gone, "document_id", "left")
    cancelled = cancelled.withColumn("status", F.when(F.col("_gone") & F.col("status").isin("queued", "running"), F.lit("cancelled")).otherwise(F.col("status"))).drop("_gone")
    return marked, cancelled, chunks.join(gone, "document_id", "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, chain: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Delete along foreign keys: chain of (table, foreign key, own key) below the rows of ``gone``."""
    out = dict(tables)
    for name, foreign, own in chain:
        keys = gone.select(F.col(gone.columns[0]).alias(foreign)).distinct()
        hit = out[name].join(keys, foreign, "left_semi")
        out[name] = out[name].join(keys, foreign, "left_anti")
        gone = hit.select(own)
    return out


def copy_rows(rows: DataFrame, id_col: str, namespace: uuid.UUID, **values) -> DataFrame:
    """Copies with new deterministic identifiers and the given columns replaced."""
    return rows.withColumn(id_col, uuid5(namespace, F.col(id_col).cast("string"))).withColumns({k: F.lit(v) for k, v in values.items()})


def rename_file(documents: DataFrame, document_id: str, name: str) -> DataFrame:
    """A new base name; the extension stays and the object key follows."""
    extension = F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    fresh = F.concat(F.lit(name.rsplit(".", 1)[0]), extension)
    hit = F.col("document_id") == document_id
    return documents.withColumn("filename", F.when(hit, fresh).otherwise(F.col("filename"))).withColumn("object_key", F.when(hit, F.concat_ws("/", "document_id", fresh)).otherwise(F.col("object_key")))


def new_contents(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads whose content hash the notebook does not have yet; of equal ones of one call the one with the smallest name."""
    hashed = uploads.withColumn("content_hash", F.sha2("content", 256))
    fresh = hashed.join(documents.filter("deleted_at IS NULL"), ["notebook_id", "content_hash"], "left_anti")
    return latest_per_group(fresh, ["notebook_id", "content_hash"], F.col("filename")) if "filename" in uploads.columns else fresh.dropDuplicates(["notebook_id", "content_hash"])


def unique_insert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.unionByName(new.dropDuplicates([key]).join(table, key, "left_anti"))


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the union of their columns."""
    return old.unionByName(new, allowMissingColumns=True)


def with_mean_row(metrics: DataFrame, label: str, label_value: str = "__mean__") -> DataFrame:
    """The table and one more row with the mean of each numeric column, rounded to six places."""
    means = [F.round(F.avg(c), 6).alias(c) if t in ("double", "float", "int", "bigint") else F.lit(None).cast(t).alias(c) for c, t in metrics.dtypes if c != label]
    return metrics.unionByName(metrics.agg(*means).withColumn(label, F.lit(label_value)), allowMissingColumns=True)


def export_markdown(pages: DataFrame, path: str) -> None:
    """Markdown files in a folder for each document: its pages in order and joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = pages.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("value"))
    texts.write.mode("overwrite").partitionBy("document_id").text(path)


def write_metrics(metrics: DataFrame, path: str, label: str) -> None:
    """One CSV file with a header, the metrics' rows and the row of means last (a row for each question)."""
    rows = with_mean_row(metrics, label).withColumn("_last", F.col(label) == "__mean__")
    rows.coalesce(1).sortWithinPartitions("_last", label).drop("_last").write.mode("overwrite").option("header", True).csv(path)
