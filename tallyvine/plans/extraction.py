"""The whole extraction: lines -> fields, items -> findings -> table rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.fields import document_layout, extract_fields, header_wide
from tallyvine.operators.items import extract_items
from tallyvine.operators.rules import outcome_summary, validate, validate_batch
from tallyvine.operators.upkeep import invoice_totals, project_fields
from tallyvine.session import materialise


@dataclass(frozen=True)
class Extraction:
    fields: DataFrame
    items: DataFrame
    findings: DataFrame


def extract_documents(lines: DataFrame) -> Extraction:
    """Fields, items and single-document findings of all documents.

    Labels are scored once, into a layout of one row per document. Layout, fields and
    items are written to the shared folder, so the lines are read five times in all,
    however many results are taken from the extraction.
    """
    layout = materialise(document_layout(lines), "layout")
    fields = materialise(extract_fields(lines, layout), "fields")
    items = materialise(extract_items(lines, layout), "items")
    return Extraction(fields, items, validate(header_wide(fields), items))


def document_report(extraction: Extraction) -> DataFrame:
    """One row per document: header values, total, outcome counts."""
    summary = outcome_summary(extraction.findings)
    totals = invoice_totals(extraction.items)
    counts = extraction.items.groupBy("doc_id").agg(F.count("*").alias("item_count"))
    return (
        project_fields(extraction.fields)
        .join(summary, "doc_id", "left")
        .join(totals, "doc_id", "left")
        .join(counts, "doc_id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("bigint")))
    )


def batch_findings(extraction: Extraction, index: DataFrame) -> DataFrame:
    """Findings including batch duplicates; ``index`` is ``(doc_id, batch_index)``."""
    header = header_wide(extraction.fields).join(index, "doc_id")
    return validate_batch(header, extraction.items)
