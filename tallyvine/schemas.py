"""Table schemas as DDL, and the closed value sets of their enum columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCR_DETECTION = (
    "doc_id string, page_width int, page_height int, "
    "detections array<struct<polygon: array<array<double>>, text: string, score: string>>"
)
OCR_LINE = (
    "doc_id string, line_no int, text string, x0 double, y0 double, x1 double, y1 double, "
    "polygon array<array<double>>, confidence double, page_width int, page_height int"
)
OCR_TOKEN = (
    "doc_id string, line_no int, token_no int, text string, x0 double, y0 double, x1 double, "
    "y1 double, polygon array<array<double>>, confidence double"
)
FIELD = "doc_id string, name string, value string, confidence double, source string, source_detail string"
ITEM = (
    "doc_id string, item_index int, item_desc string, item_qty string, item_net_price string, "
    "item_net_worth string, item_vat string, item_gross_worth string"
)
FINDING = (
    "doc_id string, rule_name string, target string, outcome string, reason string, "
    "expected string, observed string"
)
GROUND_TRUTH = "doc_id string, split string, ground_truth string"

USERS = (
    "id string, role string, email string, phone string, password_hash string, display_name string, "
    "created_at bigint, last_login_at bigint, locked_until bigint, failed_login_count int"
)
WORKSPACES = (
    "id string, owner_user_id string, name string, gstin string, created_via string, tier string, "
    "status string, region string, default_extraction_mode string, ca_gstin string, created_at bigint"
)
SOURCES = (
    "id string, workspace_id string, kind string, label string, status string, "
    "default_extraction_mode string, credentials_encrypted binary, last_polled_at bigint, "
    "created_at bigint"
)
INBOX_MESSAGES = (
    "id string, workspace_id string, source_id string, external_id string, sender string, "
    "subject string, received_at bigint, content_type string, file_storage_key string, "
    "file_size_bytes bigint, file_sha256 string, status string, ignored_reason string, created_at bigint"
)
INVOICES = (
    "id string, workspace_id string, inbox_message_id string, vendor_name string, client_name string, "
    "client_gstin string, seller_gstin string, invoice_no string, invoice_date string, "
    "total_amount_minor bigint, currency string, status string, created_at bigint, "
    "approved_at bigint, approved_by_user_id string"
)
PIPELINE_RUNS = (
    "id string, workspace_id string, invoice_id string, pipeline_version string, "
    "ocr_result_json string, extraction_result_json string, tables_result_json string, "
    "validation_result_json string, ocr_ms double, extract_ms double, tables_ms double, "
    "validate_ms double, total_ms double, created_at bigint"
)
VALIDATION_FINDINGS = (
    "id string, workspace_id string, invoice_id string, rule_name string, target string, "
    "outcome string, reason string, expected string, observed string, created_at bigint"
)
JOBS = (
    "id string, workspace_id string, inbox_message_id string, invoice_id string, stage string, "
    "state string, attempts int, max_attempts int, next_run_at bigint, started_at bigint, "
    "finished_at bigint, error_message string, created_at bigint"
)
EVENTS = (
    "id string, workspace_id string, actor_user_id string, action string, target_type string, "
    "target_id string, metadata_json string, ts bigint"
)
SESSIONS = (
    "id string, user_id string, token_hash string, expires_at bigint, user_agent string, "
    "ip_address string, revoked_at bigint, created_at bigint"
)
OTP_CHALLENGES = (
    "id string, phone string, code_hash string, purpose string, expires_at bigint, attempts int, "
    "max_attempts int, used_at bigint, created_at bigint"
)
CLIENT_LABEL_OVERRIDES = "workspace_id string, client_gstin string, display_name string, created_at bigint"
MESSAGE = (
    "source_id string, message_id string, received_at bigint, folder string, "
    "headers array<struct<name: string, value: string>>, "
    "parts array<struct<filename: string, mimeType: string, attachmentId: string, data: string>>"
)
#: A message as the mail interface gives it: ``payload`` is the JSON text of its tree of parts.
MIME_MESSAGE = "source_id string, message_id string, received_at bigint, folder string, payload string"

# Closed value sets (the CHECK constraints of the tables).
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "role"): ("business", "ca", "admin"),
    ("sources", "kind"): ("gmail", "outlook", "whatsapp", "upload", "folder"),
    ("sources", "status"): ("stub", "connected", "error", "disconnected"),
    ("inbox_messages", "status"): ("queued", "extracting", "extracted", "failed", "ignored"),
    ("invoices", "status"): ("pending", "under_review", "approved", "rejected", "flagged"),
    ("validation_findings", "outcome"): ("PASS", "FAIL", "NOT_APPLICABLE"),
    ("jobs", "stage"): ("ocr", "extract", "tables", "validate", "full"),
    ("jobs", "state"): ("queued", "running", "done", "failed", "cancelled"),
}
# The columns that must be unique together.
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "inbox_messages": ("workspace_id", "file_sha256"),
    "pipeline_runs": ("invoice_id", "pipeline_version"),
    "client_label_overrides": ("workspace_id", "client_gstin"),
}


def enum_violation(table: str) -> Column:
    """True for a row whose enum columns hold a value outside their set."""
    bad = F.lit(False)
    for (owner, column), allowed in ENUMS.items():
        if owner == table:
            bad = bad | ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return bad


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    key = UNIQUE_KEYS[table]
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).where("row_count > 1")
