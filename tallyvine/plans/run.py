"""One run over the due jobs: from documents to findings, totals and status, and what failed, as one change set.

Every table's change is rows with merge semantics: runs are upserted by (invoice, version),
findings replaced by invoice, invoices and inbox rows updated by id, where a null means
"leave as it is", jobs by id. ``applied`` merges a change set into stored tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.audit import due_jobs
from tallyvine.operators.fields import header_wide
from tallyvine.operators.rules import FAIL, PASS, validate
from tallyvine.operators.upkeep import (
    coalescing_update, derive_id, invoice_totals, project_fields, replace_findings, stored_findings, upsert_runs,
)
from tallyvine.plans.extraction import Extraction, extract_documents
from tallyvine.session import materialise
from tallyvine.sources.store import not_yet_stored, stage_json

# Version of the stages, and what a job says that failed, by the reason shown with its message.
PIPELINE_VERSION = "ocr@rapidocr,extract@heuristic,tables@spatial,validate@default"
NO_MESSAGE = "inbox message for job not found"
NO_INVOICE = "job has no invoice_id (upload didn't create a skeleton)"
FAILURES = {
    "pdf_password_protected": "PDF is password-protected",
    "unsupported_file": "failed to decode uploaded bytes as an image",
    "extraction_timeout": "extraction pipeline crashed",
}


@dataclass(frozen=True)
class RunChanges:
    """Changed rows by table, and ``summary``: ``invoice_id, pass_count, fail_count`` of what ran."""

    tables: dict[str, DataFrame]
    summary: DataFrame


def plan_jobs(jobs: DataFrame, inbox: DataFrame, unreadable: DataFrame, now_ms: int) -> DataFrame:
    """Due jobs with ``error`` (null where they run) and ``reason``, which the inbox row of a failed one gets.

    ``unreadable`` is ``(inbox_message_id, reason)`` of files that could not be decoded or read;
    the first reason by name counts.
    """
    due = due_jobs(jobs, now_ms).select("id", "workspace_id", "inbox_message_id", "invoice_id", "attempts")
    there = inbox.select("workspace_id", F.col("id").alias("inbox_message_id"), F.lit(True).alias("there"))
    bad = unreadable.groupBy("inbox_message_id").agg(F.min("reason").alias("reason"))
    known = F.coalesce(*[F.when(F.col("reason") == r, text) for r, text in FAILURES.items()], F.col("reason"))
    error = F.when(F.col("there").isNull(), NO_MESSAGE).when(F.col("invoice_id").isNull(), NO_INVOICE).otherwise(known)
    joined = due.join(there, ["workspace_id", "inbox_message_id"], "left").join(bad, "inbox_message_id", "left")
    own = F.col("there").isNotNull() & F.col("invoice_id").isNotNull()
    return joined.withColumns({"error": error, "reason": F.when(own, F.col("reason"))}).drop("there")


def documents_to_run(planned: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``doc_id, workspace_id``: invoices that the planned jobs run, each once; without those that ``stored(id)`` names."""
    docs = planned.where("error is null").groupBy(F.col("invoice_id").alias("doc_id")).agg(F.min("workspace_id").alias("workspace_id"))
    return docs if stored is None else not_yet_stored(docs, stored)


def _stage_outputs(docs: DataFrame, extraction: Extraction) -> DataFrame:
    """``doc_id`` and the JSON text of each stage; what one document has is collected, nothing more."""
    field = F.struct("value", "confidence", "source", "source_detail")
    fields = extraction.fields.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", field)))).alias("fields"))
    columns = [c for c in extraction.items.columns if c not in ("doc_id", "item_index")]
    items = extraction.items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_index", *columns))).alias("items"))
    columns = [c for c in extraction.findings.columns if c != "doc_id"]
    findings = extraction.findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("findings"))
    out = docs
    for stage, rows, name in (("extraction", fields, "fields"), ("tables", items, "items"), ("validation", findings, "findings")):
        out = out.join(stage_json(rows, [name], f"{stage}_result_json").drop(name), "doc_id", "left")
    return out


def run_changes(planned: DataFrame, docs: DataFrame, extraction: Extraction, now_ms: int, version: str = PIPELINE_VERSION) -> RunChanges:
    """The change set of planned jobs whose documents have been extracted; ``extraction`` is keyed by invoice.

    A document without a field or an item still gets its run and its status.
    """
    now = F.lit(now_ms).cast("bigint")
    outputs = _stage_outputs(docs, extraction)
    runs = outputs.select(
        derive_id("run", F.col("doc_id"), F.lit(version)).alias("id"), "workspace_id", F.col("doc_id").alias("invoice_id"),
        F.lit(version).alias("pipeline_version"), "extraction_result_json", "tables_result_json", "validation_result_json", now.alias("created_at"),
    )
    owned = extraction.findings.join(docs, "doc_id").withColumnRenamed("doc_id", "invoice_id").withColumn("created_at", now)
    summary = docs.select(F.col("doc_id").alias("invoice_id")).join(
        owned.groupBy("invoice_id").agg(F.count_if(F.col("outcome") == PASS).alias("passed"), F.count_if(F.col("outcome") == FAIL).alias("failed")),
        "invoice_id", "left",
    ).select("invoice_id", F.coalesce("passed", F.lit(0).cast("bigint")).alias("pass_count"), F.coalesce("failed", F.lit(0).cast("bigint")).alias("fail_count"))
    summary = materialise(summary, "run-summary")
    status = summary.select("invoice_id", F.when(F.col("fail_count") > 0, "flagged").otherwise("under_review").alias("status"))
    invoices = (
        docs.select("doc_id").join(project_fields(extraction.fields), "doc_id", "left").join(invoice_totals(extraction.items), "doc_id", "left")
        .withColumnRenamed("doc_id", "invoice_id").join(status, "invoice_id").withColumnRenamed("invoice_id", "id")
    )
    failed = F.col("error").isNotNull()
    messages = planned.where("error is null or reason is not null").groupBy("workspace_id", F.col("inbox_message_id").alias("id")).agg(
        F.max(F.when(failed, "failed")).alias("broken"), F.min("reason").alias("ignored_reason")
    ).select("workspace_id", "id", F.coalesce("broken", F.lit("extracted")).alias("status"), "ignored_reason")
    done = planned.select(
        "id", "workspace_id", F.when(failed, "failed").otherwise("done").alias("state"), (F.col("attempts") + 1).alias("attempts"),
        now.alias("started_at"), now.alias("finished_at"), F.left("error", F.lit(500)).alias("error_message"),
    )
    return RunChanges({
        "pipeline_runs": runs, "validation_findings": stored_findings(owned), "invoices": invoices, "inbox_messages": messages, "jobs": done,
    }, summary)


def run_due(
    jobs: DataFrame, inbox: DataFrame, unreadable: DataFrame, lines: DataFrame, now_ms: int,
    stored: DataFrame | None = None, version: str = PIPELINE_VERSION,
) -> RunChanges:
    """All due jobs from recognised lines to their change set. ``lines`` are keyed by invoice; only the due ones are read on.

    ``stored(id)`` names invoices whose run is kept: their jobs are done without a new one.
    """
    planned = materialise(plan_jobs(jobs, inbox, unreadable, now_ms), "run-jobs")
    docs = materialise(documents_to_run(planned, stored), "run-documents")
    found = extract_documents(lines.join(docs.select("doc_id"), "doc_id", "left_semi"))
    # A page without any line has no row of its own: its header is empty, and its rules say so.
    empty = docs.select("doc_id").join(found.fields.select("doc_id").distinct(), "doc_id", "left_anti")
    header = header_wide(found.fields)
    blank = empty.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in header.columns if c != "doc_id"])
    findings = materialise(found.findings.unionByName(validate(blank)), "run-findings")
    return run_changes(planned, docs, Extraction(found.fields, found.items, findings), now_ms, version)


def applied(changes: RunChanges, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored tables with a change set merged in. A null in a change leaves an invoice's or a message's column as it was."""
    out = dict(tables)
    runs = changes.tables["pipeline_runs"]
    missing = [F.lit(None).cast(t).alias(c) for c, t in tables["pipeline_runs"].dtypes if c not in runs.columns]
    out["pipeline_runs"] = upsert_runs(tables["pipeline_runs"], runs.select("*", *missing).select(*tables["pipeline_runs"].columns))
    # An invoice that ran has its findings replaced, by none if it has none.
    stale = tables["validation_findings"].join(runs.select("invoice_id"), "invoice_id", "left_anti").select(*tables["validation_findings"].columns)
    out["validation_findings"] = replace_findings(stale, changes.tables["validation_findings"].select(*stale.columns))
    out["invoices"] = coalescing_update(tables["invoices"], changes.tables["invoices"])
    out["inbox_messages"] = coalescing_update(tables["inbox_messages"], changes.tables["inbox_messages"].drop("workspace_id"))
    # A job that is done has no error any more.
    marks = changes.tables["jobs"].drop("workspace_id")
    fresh = [c for c in marks.columns if c != "id"]
    joined = tables["jobs"].join(marks.select("id", F.struct(*fresh).alias("new")), "id", "left")
    out["jobs"] = joined.select(*[
        F.when(F.col("new").isNotNull(), F.col(f"new.{c}").cast(t)).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c, t in tables["jobs"].dtypes
    ])
    return out
