"""Table upkeep: inserts, updates and replacements as whole-table transforms.

Each function returns the new rows or the new table; the caller writes them.
New ids are hashes of the row's key, so running a step again gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.functions.files import MAX_UPLOAD_BYTES, sha256_hex, sniff_content_type, storage_key
from tallyvine.functions.numbers import money_to_minor
from tallyvine.operators.dashboards import invoice_per_message, latest_per_key
from tallyvine.operators.fields import header_wide
from tallyvine.session import materialise

# Job attempts, default reason.
MAX_ATTEMPTS = 3
IGNORE_REASON = "user_marked"


def derive_id(prefix: str, *parts: Column) -> Column:
    """Repeatable id of a row from its key."""
    text = F.concat_ws("\u0001", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 32))


# --- ingest ------------------------------------------------------------------


def check_uploads(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add type, size, hash and ``reject_reason`` (null when accepted)."""
    data = F.col("data")
    size = F.coalesce(F.length(data), F.lit(0))
    kind = sniff_content_type(data)
    return uploads.select(
        "*",
        size.cast("bigint").alias("file_size_bytes"),
        kind.alias("content_type"),
        sha256_hex(data).alias("file_sha256"),
        F.when(size == 0, "upload is empty")
        .when(size > max_bytes, "upload exceeds limit")
        .when(kind.isNull(), "unsupported file type")
        .alias("reject_reason"),
    )


def resolve_uploads(checked: DataFrame, inbox: DataFrame, invoices: DataFrame) -> DataFrame:
    """Accepted uploads with message id, invoice id and whether they are duplicates.

    ``checked`` has ``upload_id``, ``workspace_id`` and ``received_at`` besides the
    columns of ``check_uploads``. The first upload of a (tenant, hash) that the
    inbox does not hold yet is new; every other one repeats a message. The first
    one per key comes from an aggregate with map-side combine, so a file that
    makes up a large share of the uploads ships one row per task.
    """
    accepted = checked.where("reject_reason is null").drop("reject_reason", "data")
    key = ["workspace_id", "file_sha256"]
    first = accepted.groupBy(*key).agg(
        F.min(F.struct("received_at", "upload_id")).alias("first")
    )
    known = inbox.select(*key, F.col("id").alias("known_id"))
    owners = (
        first.join(known, key, "left")
        .join(
            invoice_per_message(invoices).withColumnRenamed("inbox_message_id", "known_id"),
            ["workspace_id", "known_id"], "left",
        )
        .select(
            *key, "known_id", F.col("invoice_id").alias("known_invoice"),
            F.col("first.upload_id").alias("first_upload"),
        )
    )
    message = F.coalesce("known_id", derive_id("msg", F.col("workspace_id"), F.col("file_sha256")))
    return (
        accepted.join(owners, key)
        .withColumn("inbox_message_id", message)
        .withColumn(
            "invoice_id",
            F.coalesce("known_invoice", derive_id("inv", F.col("inbox_message_id"))),
        )
        .withColumn("job_id", derive_id("job", F.col("upload_id"), F.col("inbox_message_id")))
        .withColumn(
            "was_duplicate",
            F.col("known_id").isNotNull() | (F.col("upload_id") != F.col("first_upload")),
        )
        .withColumn(
            "creates_invoice",
            F.col("known_invoice").isNull() & (F.col("upload_id") == F.col("first_upload")),
        )
        .drop("known_id", "known_invoice", "first_upload")
    )


def new_inbox_rows(resolved: DataFrame) -> DataFrame:
    return resolved.where("not was_duplicate").select(
        F.col("inbox_message_id").alias("id"), "workspace_id",
        derive_id("src", F.col("workspace_id"), F.lit("upload")).alias("source_id"),
        F.lit(None).cast("string").alias("external_id"),
        F.lit(None).cast("string").alias("sender"),
        F.col("filename").alias("subject"),
        "received_at", "content_type",
        storage_key(
            F.col("workspace_id"), F.col("file_sha256"), F.col("inbox_message_id"),
            F.col("content_type"),
        ).alias("file_storage_key"),
        "file_size_bytes", "file_sha256",
        F.lit("queued").alias("status"),
        F.lit(None).cast("string").alias("ignored_reason"),
        F.col("received_at").alias("created_at"),
    )


def new_invoice_rows(resolved: DataFrame) -> DataFrame:
    """Pending invoices: for new messages, and for known ones that have none."""
    return resolved.where("creates_invoice").select(
        F.col("invoice_id").alias("id"), "workspace_id", "inbox_message_id",
        F.lit("INR").alias("currency"), F.lit("pending").alias("status"),
        F.col("received_at").alias("created_at"),
    )


def new_job_rows(resolved: DataFrame) -> DataFrame:
    """One queued job per upload, duplicates included."""
    return resolved.select(
        F.col("job_id").alias("id"), "workspace_id", "inbox_message_id", "invoice_id",
        F.lit("full").alias("stage"), F.lit("queued").alias("state"),
        F.lit(0).alias("attempts"), F.lit(MAX_ATTEMPTS).alias("max_attempts"),
        F.col("received_at").alias("next_run_at"), F.col("received_at").alias("created_at"),
    )


def new_upload_events(resolved: DataFrame) -> DataFrame:
    """Audit rows of the new messages."""
    details = F.to_json(F.struct(
        F.col("file_size_bytes").alias("size_bytes"), "content_type", F.lit("upload").alias("source")
    ))
    return resolved.where("not was_duplicate").select(
        derive_id("evt", F.col("invoice_id"), F.lit("invoice.uploaded")).alias("id"),
        "workspace_id", F.col("user_id").alias("actor_user_id"),
        F.lit("invoice.uploaded").alias("action"), F.lit("invoice").alias("target_type"),
        F.col("invoice_id").alias("target_id"), details.alias("metadata_json"),
        F.col("received_at").alias("ts"),
    )


def ingest(uploads: DataFrame, inbox: DataFrame, invoices: DataFrame) -> dict[str, DataFrame]:
    """All rows one ingest adds. The resolved uploads feed four outputs, so they
    are written once to the shared folder."""
    checked = check_uploads(uploads)
    resolved = materialise(resolve_uploads(checked, inbox, invoices), "resolved-uploads")
    return {
        "rejected": checked.where("reject_reason is not null").drop("data"),
        "resolved": resolved,
        "inbox_messages": new_inbox_rows(resolved),
        "invoices": new_invoice_rows(resolved),
        "jobs": new_job_rows(resolved),
        "events": new_upload_events(resolved),
    }


def find_by_hash(wanted: DataFrame, inbox: DataFrame) -> DataFrame:
    """Inbox rows for requested (tenant, hash) pairs."""
    return inbox.join(
        wanted.select("workspace_id", "file_sha256").distinct(), ["workspace_id", "file_sha256"]
    )


# --- invoices ----------------------------------------------------------------

UPDATABLE = (
    "vendor_name", "client_name", "client_gstin", "seller_gstin", "invoice_no", "invoice_date",
    "total_amount_minor",
)


def coalescing_update(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite columns with the non-null values of ``updates`` (one row per key)."""
    changed = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in changed])
    return table.join(renamed, key, "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns]
    )


def project_fields(fields: DataFrame) -> DataFrame:
    """Extracted fields as invoice columns; blanks count as missing."""
    wide = header_wide(fields)
    filled = lambda name: F.nullif(F.col(name), F.lit(""))
    return wide.select(
        "doc_id",
        filled("invoice_no").alias("invoice_no"),
        filled("invoice_date").alias("invoice_date"),
        filled("seller").alias("vendor_name"),
        filled("client").alias("client_name"),
        filled("seller_tax_id").alias("seller_gstin"),
        filled("client_tax_id").alias("client_gstin"),
    )


def invoice_totals(items: DataFrame) -> DataFrame:
    """Sum of the readable gross amounts per document, null when none is readable or 64 bits do not hold it."""
    return items.groupBy("doc_id").agg(
        F.try_sum(money_to_minor(F.col("item_gross_worth"))).alias("total_amount_minor")
    )


def promoted_status(invoices: DataFrame, findings: DataFrame) -> DataFrame:
    """Status after a run: ``flagged`` when a rule failed, else ``under_review``."""
    failing = (
        findings.where("outcome = 'FAIL'")
        .groupBy(F.col("invoice_id").alias("id"))
        .agg(F.count("*").alias("fails"))
    )
    status = F.when(F.col("fails") > 0, "flagged").otherwise("under_review")
    return invoices.join(failing, "id", "left").withColumn("status", status).drop("fails")


def stored_findings(findings: DataFrame) -> DataFrame:
    """Findings in table form: upper-case outcome, id per row."""
    return findings.select(
        derive_id("vf", F.col("invoice_id"), F.col("rule_name"), F.col("target")).alias("id"),
        "workspace_id", "invoice_id", "rule_name", "target",
        F.upper("outcome").alias("outcome"), "reason", "expected", "observed", "created_at",
    )


def replace_findings(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Findings of the re-validated invoices are replaced, all others kept."""
    kept = table.join(fresh.select("invoice_id").distinct(), "invoice_id", "left_anti")
    return kept.select(*table.columns).unionByName(fresh.select(*table.columns))


def upsert_runs(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """One run per (invoice, version): the fresh one where there is one, however old its time; other versions stay.

    The winners are found among keys, times and ids in one aggregate; the runs themselves are only filtered by them.
    """
    key, order = ["invoice_id", "pipeline_version"], ["created_at", "id"]
    slim = lambda runs, rank: runs.select(*key, F.lit(rank).alias("rank"), *order)
    won = slim(table, 0).unionByName(slim(fresh, 1)).groupBy(*key).agg(F.max(F.struct("rank", *order)).alias("won")).select(*key, "won.*")

    def winners(runs: DataFrame, rank: int) -> DataFrame:
        marks = won.where(F.col("rank") == rank).select(*[F.col(c).alias(f"won_{c}") for c in (*key, *order)])
        same = F.lit(True)
        for c in (*key, *order):
            same = same & F.col(c).eqNullSafe(F.col(f"won_{c}"))
        return runs.select(*table.columns).join(marks, same, "left_semi")

    return winners(table, 0).unionByName(winners(fresh, 1)).dropDuplicates([*key, *order])


def latest_runs(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["workspace_id", "invoice_id"], ["created_at", "id"])


# --- sources -----------------------------------------------------------------


def ensure_upload_sources(tenants: DataFrame, sources: DataFrame) -> DataFrame:
    """The upload source of every tenant, created where it is missing."""
    have = sources.where("kind = 'upload'").groupBy("workspace_id").agg(F.min("id").alias("have"))
    return tenants.select("workspace_id").distinct().join(have, "workspace_id", "left").select(
        "workspace_id",
        F.coalesce("have", derive_id("src", F.col("workspace_id"), F.lit("upload"))).alias("source_id"),
        F.col("have").isNull().alias("was_created"),
    )


def upsert_connections(sources: DataFrame, connections: DataFrame, kind: str = "gmail") -> DataFrame:
    """Mailbox connections ``(workspace_id, email_address)``: refresh or create.

    The label always names the account that was connected last.
    """
    label = F.when(
        F.coalesce("email_address", F.lit("")) != "", F.concat(F.lit("Gmail · "), "email_address")
    ).otherwise("Gmail")
    have = sources.where(F.col("kind") == kind).groupBy("workspace_id").agg(F.min("id").alias("have"))
    return connections.join(have, "workspace_id", "left").select(
        "workspace_id",
        F.coalesce("have", derive_id("src", F.col("workspace_id"), F.lit(kind))).alias("source_id"),
        F.lit(kind).alias("kind"), label.alias("label"), F.lit("connected").alias("status"),
        F.col("have").isNull().alias("was_new"),
    )


# --- inbox -------------------------------------------------------------------


def requeue_selected(requests: DataFrame, inbox: DataFrame, invoices: DataFrame) -> DataFrame:
    """Chosen ``(workspace_id, message_id)`` rows that belong to the tenant."""
    rows = inbox.select("workspace_id", F.col("id").alias("message_id"), "status")
    bills = invoice_per_message(invoices).withColumnRenamed("inbox_message_id", "message_id")
    chosen = requests.select("workspace_id", "message_id").distinct()
    return rows.join(chosen, ["workspace_id", "message_id"], "left_semi").join(
        bills, ["workspace_id", "message_id"], "left"
    )


def requeue_counts(requests: DataFrame, selected: DataFrame) -> DataFrame:
    """Per tenant: rows queued, requested ids skipped."""
    asked = requests.groupBy("workspace_id").agg(F.count("*").alias("asked"))
    queued = selected.groupBy("workspace_id").agg(F.count("*").alias("queued"))
    zero = F.lit(0).cast("bigint")
    return asked.join(queued, "workspace_id", "left").select(
        "workspace_id", F.coalesce("queued", zero).alias("queued"),
        F.greatest(zero, F.col("asked") - F.coalesce("queued", zero)).alias("skipped"),
    )


def requeue_pending(listed: DataFrame) -> DataFrame:
    """All queued or failed rows of the inbox list, or of the page of it that a caller passes."""
    return listed.where("status in ('queued', 'failed')")


def stuck_messages(inbox: DataFrame, jobs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Rows waiting for a run that no live job will do, with the job to create."""
    live = jobs.where("state in ('queued', 'running')").select(F.col("inbox_message_id").alias("id"))
    bills = invoices.groupBy("workspace_id", F.col("inbox_message_id").alias("id")).agg(
        F.min("id").alias("invoice_id")
    )
    return (
        inbox.where("status in ('extracting', 'queued')")
        .select("id", "workspace_id", "status")
        .join(live, "id", "left_anti")
        .join(bills, ["workspace_id", "id"], "left")
        .select(
            "workspace_id", F.col("id").alias("inbox_message_id"), "status", "invoice_id",
            F.lit("queued").alias("new_status"),
        )
    )


def flip_status(
    table: DataFrame, chosen: DataFrame, status: str, reason: Column | None = None
) -> DataFrame:
    """Set ``status`` (and the reason) of the chosen ``(workspace_id, id)`` rows."""
    marks = chosen.select("workspace_id", "id").distinct().withColumn("chosen", F.lit(True))
    hit = F.col("chosen").isNotNull()
    out = table.join(marks, ["workspace_id", "id"], "left").withColumn(
        "status", F.when(hit, status).otherwise(F.col("status"))
    )
    if reason is not None:
        out = out.withColumn("ignored_reason", F.when(hit, reason).otherwise(F.col("ignored_reason")))
    return out.select(*table.columns)


def mark_ignored(inbox: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ignore the chosen rows; without a reason they count as marked by the user."""
    reasons = chosen.groupBy("workspace_id", "id").agg(F.max("reason").alias("given"))
    hit = F.col("hit").isNotNull()
    return (
        inbox.join(reasons.withColumn("hit", F.lit(True)), ["workspace_id", "id"], "left")
        .withColumn("status", F.when(hit, "ignored").otherwise(F.col("status")))
        .withColumn(
            "ignored_reason",
            F.when(hit, F.coalesce(F.nullif("given", F.lit("")), F.lit(IGNORE_REASON)))
            .otherwise(F.col("ignored_reason")),
        )
        .select(*inbox.columns)
    )


# --- stored files ------------------------------------------------------------


def reconcile_files(listing: DataFrame, inbox: DataFrame) -> DataFrame:
    """Files without a message (orphans) and messages without a file (missing)."""
    on_disk = listing.select("file_storage_key", F.col("length").alias("bytes"))
    wanted = inbox.where("file_storage_key is not null").select("file_storage_key").distinct()
    orphans = on_disk.join(wanted, "file_storage_key", "left_anti").select(
        F.lit("orphan").alias("kind"), "file_storage_key", "bytes"
    )
    missing = wanted.join(on_disk, "file_storage_key", "left_anti").select(
        F.lit("missing").alias("kind"), "file_storage_key", F.lit(0).cast("bigint").alias("bytes")
    )
    return orphans.unionByName(missing)


def reconcile_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


# --- accountant links --------------------------------------------------------


def check_links(requests: DataFrame, workspaces: DataFrame, users: DataFrame) -> DataFrame:
    """Link requests ``(workspace_id, ca_gstin)`` with the reason for refusal.

    The tenant registered under the GSTIN must exist and belong to an accountant.
    """
    offices = (
        workspaces.where("gstin is not null")
        .groupBy(F.col("gstin").alias("ca_gstin"))
        .agg(F.min_by(F.struct("id", "owner_user_id", "name"), "id").alias("office"))
        .select("ca_gstin", F.col("office.id").alias("ca_workspace_id"),
                F.col("office.name").alias("ca_name"),
                F.col("office.owner_user_id").alias("owner_user_id"))
    )
    roles = users.select(F.col("id").alias("owner_user_id"), "role")
    # The refusal texts.
    reason = (
        F.when(F.coalesce(F.length("ca_gstin"), F.lit(0)) != 15, "GSTIN must be 15 characters")
        .when(F.col("ca_workspace_id").isNull(), "no CA registered with that GSTIN")
        .when(
            F.coalesce(F.col("role"), F.lit("")) != "ca",
            "that GSTIN is registered but not as a CA workspace",
        )
    )
    return (
        requests.join(offices, "ca_gstin", "left")
        .join(roles, "owner_user_id", "left")
        .select(
            "workspace_id", "ca_gstin", reason.alias("reject_reason"),
            F.when(reason.isNull(), F.col("ca_workspace_id")).alias("ca_workspace_id"),
            F.when(reason.isNull(), F.col("ca_name")).alias("ca_name"),
        )
    )


def apply_links(workspaces: DataFrame, checked: DataFrame, unlink: DataFrame | None = None) -> DataFrame:
    """Set the accepted links, clear the links of the tenants in ``unlink``."""
    accepted = checked.where("reject_reason is null").groupBy(F.col("workspace_id").alias("id")).agg(
        F.max("ca_gstin").alias("new_gstin")
    )
    out = workspaces.join(accepted, "id", "left").withColumn(
        "ca_gstin", F.coalesce("new_gstin", "ca_gstin")
    )
    if unlink is not None:
        gone = unlink.select(F.col("workspace_id").alias("id"), F.lit(True).alias("gone")).distinct()
        out = out.join(gone, "id", "left").withColumn(
            "ca_gstin", F.when(F.col("gone").isNull(), F.col("ca_gstin"))
        )
    return out.select(*workspaces.columns)
