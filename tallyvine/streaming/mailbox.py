"""Incremental mailbox ingestion.

The message transforms are plain DataFrame functions and serve the batch
("fetch now") and the streaming form alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyvine.functions.files import decode_base64url
from tallyvine.operators.dashboards import connected_mailboxes
from tallyvine.operators.upkeep import (
    check_uploads, derive_id, new_inbox_rows, new_invoice_rows, new_job_rows, new_upload_events, resolve_uploads,
)
from tallyvine.schemas import EVENTS, INBOX_MESSAGES, INVOICES, JOBS, MESSAGE, MIME_MESSAGE
from tallyvine.session import materialise
from tallyvine.sources.config import MailboxConfig
from tallyvine.sources.runs import RunStore, Table

DAY_MS = 86_400_000
EXCLUDED_FOLDERS = ("spam", "trash")


# --- message transforms ----------------------------------------------------------


def _part(node: Column, path: Column) -> Column:
    """What counts of one part of a tree: its place, name, type, attachment id and inline data."""
    text = lambda where: F.try_variant_get(node, where, "string")
    return F.struct(
        path.alias("path"), text("$.filename").alias("filename"), text("$.mimeType").alias("mimeType"),
        text("$.body.attachmentId").alias("attachmentId"), text("$.body.data").alias("data"),
    )


def mime_parts(payload: Column) -> Column:
    """All parts of a message's tree, however deep, in depth-first order: ``array<struct<path, filename, ...>>``.

    ``payload`` is the JSON text of the tree; ``path`` holds the index taken at every level, so
    its order is the walk's order, a part before the parts in it. The tree is walked level by
    level inside its row; there are at most as many levels as opening brackets. A text that is
    no JSON, and null, have no parts.
    """
    root = F.struct(F.array().cast("array<int>").alias("path"), F.try_parse_json(payload).alias("node"))
    levels = F.sequence(F.lit(0), F.length(payload) - F.length(F.replace(payload, F.lit("["))))
    start = F.struct(
        F.array(root).alias("open"),
        F.array().cast("array<struct<path:array<int>,filename:string,mimeType:string,attachmentId:string,data:string>>").alias("parts"),
    )

    def children(n: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(n["node"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(inner, lambda child, i: F.struct(F.concat(n["path"], F.array(i.cast("int"))).alias("path"), child.alias("node")))

    def deeper(state: Column, _: Column) -> Column:
        return F.struct(
            F.flatten(F.transform(state["open"], children)).alias("open"),
            F.concat(state["parts"], F.transform(state["open"], lambda n: _part(n["node"], n["path"]))).alias("parts"),
        )

    walked = F.aggregate(levels, start, deeper, lambda state: F.array_sort(state["parts"]))
    return F.when(F.try_parse_json(payload).isNotNull(), walked)


def from_mime(messages: DataFrame) -> DataFrame:
    """Messages of ``MIME_MESSAGE`` with ``headers`` and ``parts``, as the other transforms take them; ``parts`` has all levels."""
    header = "array<struct<name:string,value:string>>"
    rest = [c for c in messages.columns if c != "payload"]
    return messages.select(
        *rest, F.try_variant_get(F.try_parse_json("payload"), "$.headers", header).alias("headers"), mime_parts(F.col("payload")).alias("parts")
    )


def header_map(headers: Column) -> Column:
    """Header values by lower-cased name; the last of a repeated name wins, ones without a name do not count."""
    named = F.filter(headers, lambda h: h["name"].isNotNull())
    entries = F.transform(named, lambda h: F.struct(F.lower(h["name"]), h["value"]))
    return F.map_from_entries(entries)


def with_headers(messages: DataFrame) -> DataFrame:
    mapped = messages.withColumn("h", header_map(F.col("headers")))
    return mapped.withColumn("sender", F.try_element_at("h", F.lit("from"))).withColumn(
        "subject", F.try_element_at("h", F.lit("subject"))
    ).drop("h")


def subject_matches(subject: Column, config: MailboxConfig) -> Column:
    """Any keyword occurs in the subject, case ignored; no keywords match everything."""
    words = config.keywords()
    if not words:
        return F.lit(True)
    low = F.lower(F.coalesce(subject, F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def has_attachment(parts: Column) -> Column:
    return F.exists(
        parts,
        lambda p: (F.coalesce(F.length(p["attachmentId"]), F.lit(0)) > 0)
        & (F.coalesce(F.length(p["filename"]), F.lit(0)) > 0),
    )


def select_messages(messages: DataFrame, config: MailboxConfig) -> DataFrame:
    """Messages with an attachment and a matching subject, outside spam and trash."""
    return with_headers(messages).where(
        has_attachment(F.col("parts")) & subject_matches(F.col("subject"), config)
        & ~F.coalesce(F.lower("folder").isin(*EXCLUDED_FOLDERS), F.lit(False))
    )


def new_since_cursor(
    messages: DataFrame, sources: DataFrame, config: MailboxConfig, now_ms: int,
    unbounded: bool = False,
) -> DataFrame:
    """Messages after each source's cursor; without one, within the backfill window.

    ``unbounded`` ignores the dates; the caller then leaves the cursor alone. The
    cursor has second precision. Only connected sources are read.
    """
    cursors = sources.where("status = 'connected'").select(
        F.col("id").alias("source_id"), "workspace_id", "last_polled_at"
    )
    joined = messages.join(cursors, "source_id")
    if not unbounded:
        has_cursor = F.coalesce("last_polled_at", F.lit(0).cast("bigint")) != 0
        second = F.lit(1000).cast("bigint")
        after = F.call_function("div", F.col("last_polled_at"), second) * second
        since = F.when(has_cursor, after).otherwise(
            F.lit(now_ms - config.backfill_days * DAY_MS).cast("bigint")
        )
        joined = joined.where(F.col("received_at") >= since)
    return joined.drop("last_polled_at")


def advance_cursors(
    sources: DataFrame, polled: DataFrame, now_ms: int, taken: DataFrame | None = None
) -> DataFrame:
    """Move the cursor of the polled sources; a fetch-now run does not call this.

    ``taken`` is what a capped poll took (``cap_messages``): a source with more than that
    goes on after the last second taken, so the rest comes with the next poll.
    """
    seen = polled.groupBy("source_id").agg(F.count("*").alias("seen"))
    at = F.lit(now_ms).cast("bigint")
    if taken is not None:
        read = taken.groupBy("source_id").agg(F.count("*").alias("read"), F.max("received_at").alias("last"))
        seen = seen.join(read, "source_id", "left")
        second = F.lit(1000).cast("bigint")
        after = (F.call_function("div", F.col("last"), second) + F.lit(1).cast("bigint")) * second
        at = F.when(F.col("read") < F.col("seen"), after).otherwise(at)
    done = seen.select(F.col("source_id").alias("id"), at.alias("at"))
    return sources.join(done, "id", "left").withColumn(
        "last_polled_at", F.coalesce("at", "last_polled_at")
    ).select(*sources.columns)


def disconnect_sources(sources: DataFrame, revoked: DataFrame) -> DataFrame:
    """Sources whose access was revoked; they are no longer read."""
    gone = revoked.select(F.col("source_id").alias("id"), F.lit(True).alias("gone")).distinct()
    return sources.join(gone, "id", "left").withColumn(
        "status", F.when(F.col("gone").isNotNull(), "disconnected").otherwise(F.col("status"))
    ).select(*sources.columns)


def cap_messages(messages: DataFrame, config: MailboxConfig, limit: int | None = None) -> DataFrame:
    """At most about so many messages per source and poll, oldest first; all without a cap.

    Messages of one second stay together, so that the cursor can go on after them. Each
    task keeps only the oldest ones of a source before the shuffle.
    """
    most = config.max_messages_per_poll if limit is None else limit
    if most is None:
        return messages
    second = F.call_function("div", F.col("received_at"), F.lit(1000).cast("bigint"))
    w = Window.partitionBy("source_id").orderBy(second)
    return messages.withColumn("n", F.rank().over(w)).where(F.col("n") <= most).drop("n")


def flatten_parts(messages: DataFrame) -> DataFrame:
    """One row per downloadable part, in message order."""
    kept = [c for c in messages.columns if c not in ("parts", "headers")]
    return messages.select(*kept, F.posexplode("parts").alias("part_no", "p")).where(
        "coalesce(length(p.attachmentId), 0) > 0 and coalesce(length(p.filename), 0) > 0"
    ).select(*kept, "part_no", "p.filename", "p.mimeType", "p.attachmentId", "p.data")


def judge_parts(messages: DataFrame, config: MailboxConfig) -> DataFrame:
    """Parts with their verdict: ``take``, ``skip`` or ``abandon``.

    A part of another type is skipped. Without a cap every other part is taken; with one,
    the first part beyond it is skipped and the parts after that are abandoned, which
    their rows say. The position among the
    accepted parts is found inside the message's own part list, so no row of
    one message ever has to meet the rows of another.
    """
    types = config.supported_content_types
    most = config.max_attachments_per_message

    def usable(p: Column) -> Column:
        return (F.coalesce(F.length(p["attachmentId"]), F.lit(0)) > 0) & (
            F.coalesce(F.length(p["filename"]), F.lit(0)) > 0
        )

    def allowed(p: Column) -> Column:
        return usable(p) & F.coalesce(p["mimeType"].isin(*types), F.lit(False))

    # Index of the first allowed part beyond the cap; null when there is none.
    allowed_at = F.filter(
        F.transform("parts", lambda p, i: F.when(allowed(p), i)), lambda i: i.isNotNull()
    )
    cut = F.lit(None).cast("int") if most is None else F.get(allowed_at, F.lit(most))
    kept = [c for c in messages.columns if c not in ("parts", "headers")]
    rows = messages.withColumn("cut", cut).select(
        *kept, "cut", F.posexplode("parts").alias("part_no", "p")
    ).where(usable(F.col("p")))
    verdict = (
        F.when(F.col("part_no") > F.col("cut"), "abandon")
        .when(F.col("part_no") == F.col("cut"), "skip")
        .when(~allowed(F.col("p")), "skip")
        .otherwise("take")
    )
    return rows.withColumn("verdict", verdict).select(
        *kept, "part_no", "p.filename", "p.mimeType", "p.attachmentId", "p.data", "verdict"
    )


def to_uploads(judged: DataFrame) -> DataFrame:
    """Accepted parts as upload rows with decoded bytes and the mailbox reference."""
    taken = judged.where("verdict = 'take' and coalesce(length(data), 0) > 0")
    owner = ["user_id"] if "user_id" in judged.columns else []
    return taken.select(
        *owner, F.concat_ws(":", F.lit("gmail"), "message_id", "attachmentId").alias("external_id"),
        derive_id("upl", F.col("source_id"), F.col("message_id"), F.col("attachmentId"))
        .alias("upload_id"),
        "source_id", "workspace_id", "message_id", "sender", "subject", "filename", "received_at",
        decode_base64url(F.col("data")).alias("data"),
    )


def poll_stats(messages: DataFrame, judged: DataFrame, resolved: DataFrame) -> DataFrame:
    """Scanned messages, ingested and skipped parts per source.

    ``resolved`` is ``(source_id, was_duplicate)`` of the parts that got through;
    everything else that was looked at counts as skipped.
    """
    zero = F.lit(0).cast("bigint")
    scanned = messages.groupBy("source_id").agg(F.count("*").alias("scanned"))
    looked = judged.where("verdict <> 'abandon'").groupBy("source_id").agg(F.count("*").alias("parts"))
    fresh = resolved.where("not was_duplicate").groupBy("source_id").agg(F.count("*").alias("ingested"))
    return scanned.join(looked, "source_id", "left").join(fresh, "source_id", "left").select(
        "source_id", "scanned",
        F.coalesce("ingested", zero).alias("ingested"),
        (F.coalesce("parts", zero) - F.coalesce("ingested", zero)).alias("skipped"),
    )


def new_attachments(uploads: DataFrame, inbox: DataFrame) -> DataFrame:
    """First arrival of every (tenant, hash) that the inbox does not hold."""
    key = ["workspace_id", "file_sha256"]
    checked = check_uploads(uploads).where("reject_reason is null").drop("data", "reject_reason")
    rest = [c for c in checked.columns if c not in key]
    first = checked.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct("received_at", "upload_id")).alias("first")
    )
    return first.join(inbox.select(*key), key, "left_anti").select(*key, "first.*")


# --- streaming -------------------------------------------------------------------


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 100, schema: str = MESSAGE) -> DataFrame:
    """Message feed from a landing folder, ``MESSAGE`` or ``MIME_MESSAGE``; the checkpoint is the cursor."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def attachment_stream(
    messages: DataFrame, sources: DataFrame, workspaces: DataFrame, config: MailboxConfig,
) -> DataFrame:
    """Stream of checked attachments of connected mailboxes.

    The join with the sources is stream-static and re-reads them per batch, so a
    disconnected source drops out. No state and no watermark: a message is taken
    however late it comes, and ``ingest_batch`` removes repeats against the stored keys.
    """
    live = connected_mailboxes(sources, workspaces).select("source_id", "workspace_id")
    selected = select_messages(messages.join(live, "source_id"), config)
    checked = check_uploads(to_uploads(judge_parts(selected, config)))
    return checked.where("reject_reason is null").drop("reject_reason")


#: What the ingest keeps, and how it is looked up.
MAIL_TABLES = {
    "inbox_messages": Table(INBOX_MESSAGES, ("file_sha256", "workspace_id")),
    "invoices": Table(INVOICES, ("inbox_message_id", "workspace_id")),
    "jobs": Table(JOBS, ("inbox_message_id", "id")),
    "events": Table(EVENTS, ("target_id", "id")),
    "poll_stats": Table("source_id string, batch_id bigint, scanned bigint, ingested bigint, skipped bigint", ("source_id", "batch_id")),
    "blobs": Table("file_storage_key string, data binary", ("file_storage_key",), merged=False, file_rows=1_000),
}


def mail_store(spark: SparkSession, root: str) -> RunStore:
    return RunStore(spark, root, MAIL_TABLES)


def mail_inbox_rows(resolved: DataFrame) -> DataFrame:
    """Inbox rows of new attachments, with the message they came with."""
    own = ["source_id", "external_id", "sender", "subject"]
    mail = resolved.where("not was_duplicate").select(F.col("inbox_message_id").alias("id"), *[F.col(c).alias(f"mail_{c}") for c in own])
    rows = new_inbox_rows(resolved.withColumn("filename", F.col("subject")))
    return rows.drop(*own).join(mail, "id").select(*[F.col(f"mail_{c}").alias(c) if c in own else F.col(c) for c in rows.columns])


def ingest_messages(
    store: RunStore, sources: Callable[[], DataFrame], workspaces: Callable[[], DataFrame], config: MailboxConfig,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: messages of any tree become inbox rows, invoices, jobs, events, file contents and statistics.

    All of a batch becomes visible by one manifest; a batch done again, whole or after it was
    killed, replaces what it did. Repeats are found against the stored rows of the batch's own
    hashes. An attachment that is known adds a job and nothing else. ``sources`` and ``workspaces``
    are asked for every batch, so a disconnected mailbox drops out. No state and no watermark:
    a message counts however late it comes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        live = connected_mailboxes(sources(), workspaces()).select("source_id", "workspace_id", F.col("owner_user_id").alias("user_id"))
        messages = from_mime(batch) if "payload" in batch.columns else batch
        chosen = materialise(select_messages(messages.join(live, "source_id"), config), "mail-chosen")
        judged = judge_parts(chosen, config)
        checked = materialise(check_uploads(to_uploads(judged)).where("reject_reason is null"), "mail-checked")
        known = materialise(store.lookup("inbox_messages", checked, batch_id).join(
            checked.select("workspace_id", "file_sha256").distinct(), ["workspace_id", "file_sha256"], "left_semi"
        ), "mail-known")
        bills = store.lookup("invoices", known.select(F.col("id").alias("inbox_message_id")), batch_id)
        resolved = materialise(resolve_uploads(checked, known, bills), "mail-resolved")
        inbox = mail_inbox_rows(resolved)
        first = resolved.where("not was_duplicate").select("upload_id", "inbox_message_id")
        contents = checked.select("upload_id", "data").join(first, "upload_id").join(
            inbox.select(F.col("id").alias("inbox_message_id"), "file_storage_key"), "inbox_message_id"
        )
        rows = {
            "inbox_messages": inbox, "invoices": new_invoice_rows(resolved), "jobs": new_job_rows(resolved),
            "events": new_upload_events(resolved), "blobs": contents.select("file_storage_key", "data"),
            "poll_stats": poll_stats(chosen, judged, resolved).withColumn("batch_id", F.lit(batch_id).cast("bigint")),
        }
        store.commit(batch_id, {name: _shaped(df, store.tables[name].schema) for name, df in rows.items()})

    return write


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; those that ``df`` does not have are null."""
    fields = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def start_mail_ingest(
    messages: DataFrame, store: RunStore, sources: Callable[[], DataFrame], workspaces: Callable[[], DataFrame],
    checkpoint: str, config: MailboxConfig, once: bool = True,
):
    """Run the ingest of a stream of messages; ``once`` processes what is available and stops."""
    writer = messages.writeStream.foreachBatch(ingest_messages(store, sources, workspaces, config)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_batch(inbox_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for attachments alone: inbox rows that the store does not hold yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = mail_store(batch.sparkSession, inbox_path)
        rows = batch.select(
            derive_id("msg", F.col("workspace_id"), F.col("file_sha256")).alias("id"),
            "workspace_id", "source_id", "external_id", "sender", "subject", "received_at",
            "content_type", "file_size_bytes", "file_sha256", F.lit("queued").alias("status"),
        )
        key = ["workspace_id", "file_sha256"]
        rest = [c for c in rows.columns if c not in key]
        fresh = materialise(rows.groupBy(*key).agg(
            F.min_by(F.struct(*rest), F.struct("received_at", "external_id")).alias("f")
        ).select(*key, "f.*"), "mail-fresh")
        new = fresh.join(store.lookup("inbox_messages", fresh, batch_id).select(*key), key, "left_anti")
        store.commit(batch_id, {"inbox_messages": _shaped(new, INBOX_MESSAGES)})

    return write


def start_ingest(
    attachments: DataFrame, inbox_path: str, checkpoint: str, once: bool = True
):
    """Run the ingest of attachments; ``once`` processes what is available and stops. ``mail_store`` reads the result."""
    writer = attachments.writeStream.foreachBatch(ingest_batch(inbox_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
