"""Queries over the metadata tables: access, latest per group, history windows, library tree, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.shared_files import fresh_name, stored

ACTIVE = ("queued", "running")


def visible(notebooks: DataFrame, user_id: int) -> DataFrame:
    return notebooks.filter((F.col("owner_id") == user_id) | F.col("is_community"))


def authorized_document(documents: DataFrame, key: str, user_id: int) -> DataFrame:
    """The user's document by identifier or filename, else a community one by identifier."""
    own = documents.filter((F.col("owner_id") == user_id) & ((F.col("document_id") == key) | (F.col("filename") == key)))
    community = documents.filter((F.col("document_id") == key) & F.col("is_community"))
    both = own.withColumn("_choice", F.lit(0)).unionByName(community.withColumn("_choice", F.lit(1)))
    return both.orderBy("_choice", "document_id").limit(1).drop("_choice")


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*ACTIVE))


def is_admin(email: Column, suffix: str) -> Column:
    return F.lower(email).endswith(suffix.lower())


def title_is_shareable(title: Column, default: str = "untitled notebook") -> Column:
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.lower(F.trim(title)) != default)


def latest_per_group(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order.

    A group's rows are cut down to one per task before the shuffle (window group limit).
    """
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def with_latest(left: DataFrame, right: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Every left row with the latest right row of its key, or nulls."""
    return left.join(latest_per_group(right, keys, *order), keys, "left")


def with_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def without_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def history(messages: DataFrame, *, conversation: str = "conversation_id", order: list[str] | None = None, text: str = "content", limit: int = 4, budget: int = 4000) -> DataFrame:
    """The last ``limit`` messages per conversation in chronological order within a budget of characters.

    Texts are trimmed and blank ones skipped; from the latest back, the message that exceeds the
    budget is cut and older ones go.
    """
    order = order or ["created_at", "id"]
    newest = Window.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    last = messages.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= limit)
    trimmed = last.withColumn(text, F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")).filter(F.col(text) != "")
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(conversation).orderBy("_back").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = trimmed.withColumn("_used", before).filter(F.col("_used") < budget)
    cut = kept.withColumn(text, F.substring(F.col(text), F.lit(1), F.lit(budget) - F.col("_used")))
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc("_back")))
    return cut.withColumn("position", place).drop("_back", "_used")


def history_text(messages: DataFrame, *, conversation: str = "conversation_id", text: str = "content", empty: str = "No earlier messages.") -> DataFrame:
    """``role: content`` lines per conversation in order of position."""
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat("role", F.lit(": "), F.col(text)).alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return messages.groupBy(conversation).agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty)).alias("history"))


def latest_conversation(conversations: DataFrame, messages: DataFrame, n: int, *, key: str = "conversation_id", at: str = "at", order: str = "turn") -> DataFrame:
    """The conversation with the greatest ``at`` (ties: greater key) and its last ``n`` messages, oldest first."""
    newest = conversations.orderBy(F.desc(at), F.desc(key)).limit(1).select(key)
    last = messages.join(F.broadcast(newest), key).orderBy(F.desc(order)).limit(n)  # one row is broadcast
    return last.orderBy(order)


def tree_nodes(users: DataFrame, notebooks: DataFrame, documents: DataFrame) -> DataFrame:
    """user → notebooks → documents, a row per node with its level (0, 1, 2) and the identifiers above it.

    Documents without a notebook, or in one that is not listed, hang under ``Unfiled``.  No row or group
    holds more than one node, so a user with most documents is spread over all tasks.
    """
    known = users.select("user_id")
    filed = documents.select("user_id", F.coalesce("notebook_id", F.lit(-1)).alias("notebook_id"), "document_id", "filename").join(known, "user_id", "left_semi")
    listed = notebooks.select("user_id", "notebook_id", F.coalesce("title", F.lit("Unfiled")).alias("title")).join(known, "user_id", "left_semi")
    used = filed.select("user_id", "notebook_id").distinct()
    other = used.join(listed, ["user_id", "notebook_id"], "left_anti").withColumn("title", F.lit("Unfiled"))
    levels = [users, listed.unionByName(other), filed]
    top, middle, leaves = (x.withColumn("level", F.lit(k)) for k, x in enumerate(levels))
    return top.unionByName(middle, allowMissingColumns=True).unionByName(leaves, allowMissingColumns=True)


def library_tree(users: DataFrame, notebooks: DataFrame, documents: DataFrame) -> DataFrame:
    """The nodes of the tree numbered from 0 as they are listed: a user, each notebook and behind it its documents."""
    order = ["user_id", "notebook_id", "level", "document_id", "filename"]
    return numbered(tree_nodes(users, notebooks, documents), order, 1).withColumnRenamed("row_idx", "position").drop("batch")


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Notebooks and documents of each user, added up per task first."""
    return nodes.groupBy("user_id").agg(F.count_if(F.col("level") == 1).alias("n_notebooks"), F.count_if(F.col("level") == 2).alias("n_documents"))


def running_maximum(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("progress", F.max(value).over(w))


def stage_progress(stage: Column, ratio: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    """start + int((end - start) * ratio) of the stage's span, ratio held in 0..1."""
    start = F.element_at(F.create_map(*[F.lit(x) for k, (a, _) in bounds.items() for x in (k, a)]), stage)
    end = F.element_at(F.create_map(*[F.lit(x) for k, (_, b) in bounds.items() for x in (k, b)]), stage)
    return start + ((end - start) * F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).cast("int")


def numbered(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows numbered from 0 over the whole table, and the batch of ``size`` each falls in.

    The rows are written once in range partitions with their partition's number, so that what is counted
    is what is numbered.  Partitions are numbered on their own and moved on by the counts of those
    before; no task sees all rows.
    """
    part, local, before = (fresh_name(n, rows) for n in ("part", "local", "before"))
    parts = stored(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(part).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, ahead.alias(before))  # one row per partition
    out = parts.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(offsets), part)
    return out.withColumn("row_idx", F.col(before) + F.col(local) - 1).drop(part, local, before).withColumn("batch", F.floor(F.col("row_idx") / size))


def latest_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def tables_of(tables: DataFrame, documents: DataFrame, user_id: int) -> DataFrame:
    """The user's rows of the table catalogue; without any, those of the user's documents."""
    own = tables.filter(F.col("user_id") == user_id)
    if not own.isEmpty():
        return own
    mine = documents.filter((F.col("owner_id") == user_id) & F.col("deleted_at").isNull()).select("document_id")
    return tables.join(mine, "document_id", "left_semi")


def job_totals(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, pages, chunks, rows (of tabular pages): what a job reports."""
    of_pages = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("n_rows").alias("rows"))
    of_chunks = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    both = of_pages.join(of_chunks, "document_id", "full")
    return both.select("document_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "chunks", "rows")])


def queue_is_idle(workers: DataFrame) -> DataFrame:
    """One row: whether no worker has active or reserved tasks (true without workers)."""
    return workers.agg((F.coalesce(F.sum(F.col("active") + F.col("reserved")), F.lit(0)) == 0).alias("idle"))


def listed(rows: DataFrame, created: str, key: str) -> DataFrame:
    """Newest first; of one time, by key."""
    return rows.orderBy(F.desc_nulls_last(created), key)


def iso_time(at: Column) -> Column:
    """A time as ``2024-01-02T03:04:05``, with microseconds where there are any."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def stage_durations(events: DataFrame, *, job: str = "job_id", stage: str = "stage", at: str = "ts", order: str = "event_id") -> DataFrame:
    """job, stage, n_events, total_ms: the time from each event of a job to its next one, added up by stage."""
    after = F.lead(at).over(Window.partitionBy(job).orderBy(at, order))
    spans = events.withColumn("ms", F.coalesce(elapsed_ms(F.col(at), after), F.lit(0)))
    return spans.groupBy(job, stage).agg(F.count("*").alias("n_events"), F.sum("ms").alias("total_ms"))


def valid_codes(codes: DataFrame, minutes: int, now: Column, *, user: str = "user_id", created: str = "created_at", key: str = "code_id") -> DataFrame:
    """Each user's latest code, if it has not expired."""
    latest = latest_n(codes, [user], 1, F.desc(created), F.desc(key))
    return latest.filter(F.col(created) + F.make_dt_interval(mins=F.lit(minutes)) > now)


def matching(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any of the columns, or in any element of a list, whatever the case; all for an empty one."""
    if not needle.strip():
        return rows
    kinds, low = dict(rows.dtypes), F.lit(needle.strip().lower())
    hit = F.lit(False)
    for c in columns:
        one = F.exists(c, lambda x: F.contains(F.lower(x), low)) if kinds[c].startswith("array") else F.contains(F.lower(F.col(c).cast("string")), low)
        hit = hit | F.coalesce(one, F.lit(False))
    return rows.filter(hit)


def visible_choice(chosen: Column, visible: Column) -> Column:
    """The chosen sources that are visible."""
    return F.array_intersect(chosen, visible)


def mine_and_shared(notebooks: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame]:
    """(the user's notebooks, those of others that are shared)."""
    own = F.col("owner_id") == user_id
    return notebooks.filter(own), notebooks.filter(~own & F.col("shared"))
