"""Dashboard and list queries, and access-audit snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyvine.functions.messages import (
    FAILURE_FALLBACK,
    FAILURE_TEXTS,
    RULE_FALLBACK,
    RULE_TEXTS,
    with_rule_texts,
)
from tallyvine.functions.periods import month_bounds
from tallyvine.operators import audit as A
from tallyvine.operators import dashboards as D
from tallyvine.session import shared_folder
from verification.registry import query


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULE_VALUES = ", ".join(
    "(" + ", ".join(lit(x) for x in (name, *texts)) + ")" for name, texts in RULE_TEXTS.items()
)
RULE_CTE = f"rule_text(rule_name, title, explanation, suggestion) AS (VALUES {RULE_VALUES})"
FAIL_CASE = "CASE ignored_reason " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in FAILURE_TEXTS.items()
) + " END"
FAILURE_SQL = (
    f"CASE WHEN status IN ('failed', 'ignored') THEN coalesce({FAIL_CASE}, "
    f"CASE WHEN status = 'failed' THEN {lit(FAILURE_FALLBACK)} END) END"
)
MONTH_MS = "epoch_ms(date_trunc('month', make_timestamp(created_at * 1000)))"
FAILS = """(SELECT count(*) FROM validation_findings f WHERE f.invoice_id = i.id
  AND f.workspace_id = i.workspace_id AND f.outcome = 'FAIL')"""
TILES = f"""
SELECT workspace_id, {MONTH_MS} AS month_ms, count(*) AS invoice_count,
  cast(coalesce(sum(total_amount_minor), 0) as bigint) AS total_spend_minor,
  cast(floor(cast(coalesce(sum(CASE WHEN fails > 0 THEN 0 ELSE coalesce(total_amount_minor, 0) END), 0)
    as decimal(38, 0)) * 18 / 118) as bigint) AS itc_estimate_minor,
  cast(sum(CASE WHEN fails > 0 THEN 1 ELSE 0 END) as bigint) AS needs_review_count,
  cast(sum(CASE WHEN status IN ('approved', 'under_review', 'flagged') THEN 1 ELSE 0 END) as bigint)
    AS extracted_count,
  cast(sum(CASE WHEN status IN ('pending', 'rejected') THEN 1 ELSE 0 END) as bigint) AS pending_count
FROM (SELECT i.*, {FAILS} AS fails FROM invoices i) x"""
IV = ("invoices", "validation_findings")


@query("q01_month_totals", TILES + " GROUP BY 1, 2", IV)
def _(g):
    return D.monthly_totals(g.invoices, g.validation_findings)


START, END = month_bounds(1998, 3)


@query(
    "q01_one_tenant_month",
    f"SELECT * EXCLUDE (workspace_id, month_ms) FROM ({TILES} WHERE workspace_id = 'ws-3' "
    f"AND created_at >= {START} AND created_at < {END} GROUP BY 1, 2)", IV,
)
def _(g):
    return D.totals_for_period(g.invoices, g.validation_findings, "ws-3", START, END)


@query(
    "q02_invoices_with_failures",
    """SELECT i.workspace_id, i.id FROM invoices i WHERE EXISTS (SELECT 1 FROM validation_findings f
    WHERE f.invoice_id = i.id AND f.workspace_id = i.workspace_id AND f.outcome = 'FAIL')""", IV,
)
def _(g):
    return D.invoices_with_failures(g.invoices, g.validation_findings).select("workspace_id", "id")


VENDORS = f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, month_ms ORDER BY total_minor DESC, vendor_name) AS rank
  FROM (SELECT workspace_id, {MONTH_MS} AS month_ms, vendor_name, count(*) AS invoice_count,
          cast(coalesce(sum(total_amount_minor), 0) as bigint) AS total_minor
        FROM invoices WHERE vendor_name IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 5"""


@query("q03_top_vendors", VENDORS, ("invoices",))
def _(g):
    return D.top_vendors(g.invoices)


REVIEW = f"""SELECT * FROM (
  SELECT workspace_id, id AS invoice_id, vendor_name, invoice_no, invoice_date, total_amount_minor,
    created_at, fails AS failing_rules,
    row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id) AS rank
  FROM (SELECT i.*, {FAILS} AS fails FROM invoices i) WHERE fails > 0) WHERE rank <= 5"""


@query("q04_needs_review", REVIEW, IV)
def _(g):
    return D.needs_review(g.invoices, g.validation_findings)


@query(
    "q05_dashboard",
    """SELECT t.*, coalesce(v.top_vendors, '[]') AS top_vendors, coalesce(r.needs_review, '[]') AS needs_review
    FROM tiles t LEFT JOIN (
      SELECT workspace_id, month_ms, '[' || string_agg('{"vendor_name":"' || vendor_name || '","invoice_count":'
        || invoice_count || ',"total_minor":' || total_minor || '}', ',' ORDER BY rank) || ']' AS top_vendors
      FROM vendors GROUP BY 1, 2) v USING (workspace_id, month_ms)
    LEFT JOIN (
      SELECT workspace_id, '[' || string_agg('{"invoice_id":"' || invoice_id || '","failing_rules":'
        || failing_rules || '}', ',' ORDER BY rank) || ']' AS needs_review
      FROM review GROUP BY 1) r USING (workspace_id)""",
    IV, extra=f"tiles AS ({TILES} GROUP BY 1, 2), vendors AS ({VENDORS}), review AS ({REVIEW})",
)
def _(g):
    return D.dashboard(g.invoices, g.validation_findings)


CLIENTS = """SELECT w.ca_gstin, w.id AS workspace_id, w.name, w.gstin,
  (SELECT count(*) FROM invoices i WHERE i.workspace_id = w.id) AS invoice_count,
  cast(coalesce((SELECT sum(total_amount_minor) FROM invoices i WHERE i.workspace_id = w.id), 0) as bigint)
    AS total_spend_minor,
  (SELECT count(*) FROM validation_findings f WHERE f.workspace_id = w.id AND f.outcome = 'FAIL') AS open_flags
FROM workspaces w WHERE w.ca_gstin IS NOT NULL"""
WIV = ("workspaces", "invoices", "validation_findings")


@query("q06_client_rollup", CLIENTS, WIV)
def _(g):
    return D.client_rollup(g.workspaces, g.invoices, g.validation_findings)


@query(
    "q07_authorised_workspaces",
    """SELECT r.ca_gstin, r.workspace_id FROM (SELECT c.gstin AS ca_gstin, i.workspace_id
      FROM (SELECT DISTINCT workspace_id FROM invoices) i JOIN workspaces c ON c.id = 'ca-2') r
    WHERE EXISTS (SELECT 1 FROM workspaces w WHERE w.id = r.workspace_id AND w.ca_gstin = r.ca_gstin)""",
    ("workspaces", "invoices"),
)
def _(g):
    # One office asks for every tenant that has invoices.
    asked = g.invoices.select("workspace_id").distinct().withColumn(
        "ca_gstin", F.lit("52CAXYZ0002K1Z9")
    )
    return D.authorised_workspaces(asked, g.workspaces).select("ca_gstin", "workspace_id")


CLIENT_INVOICES = """SELECT w.ca_gstin, i.workspace_id, i.id AS invoice_id, i.vendor_name, i.invoice_no,
  i.invoice_date, i.total_amount_minor, i.currency, i.status,
  (SELECT count(*) FROM validation_findings f WHERE f.invoice_id = i.id AND f.outcome = 'FAIL')
    AS failing_rules, i.created_at
FROM invoices i JOIN workspaces w ON w.id = i.workspace_id WHERE w.ca_gstin IS NOT NULL"""


@query("q08_client_invoices", CLIENT_INVOICES, WIV)
def _(g):
    return D.client_invoices(g.workspaces, g.invoices, g.validation_findings)


@query(
    "q08_client_invoices_page",
    f"""SELECT * FROM ({CLIENT_INVOICES} AND w.ca_gstin = '52CAXYZ0002K1Z9' AND w.id = 'ws-7')
    ORDER BY created_at DESC, invoice_id LIMIT 100 OFFSET 20""", WIV,
)
def _(g):
    rows = D.client_invoices(
        g.workspaces, g.invoices, g.validation_findings, "52CAXYZ0002K1Z9", "ws-7"
    )
    return D.newest_first(rows, "created_at", "invoice_id", 100, 20)


@query(
    "q09_rollup_totals",
    f"""SELECT ca_gstin, count(*) AS clients, cast(sum(invoice_count) as bigint) AS invoice_count,
    cast(sum(total_spend_minor) as bigint) AS total_spend_minor,
    cast(sum(open_flags) as bigint) AS open_flags FROM ({CLIENTS}) GROUP BY 1""", WIV,
)
def _(g):
    return D.rollup_totals(D.client_rollup(g.workspaces, g.invoices, g.validation_findings))


INBOX = f"""SELECT m.workspace_id, m.id, i.id AS invoice_id, coalesce(s.kind, 'upload') AS source_kind,
  m.sender, m.subject, m.received_at, m.content_type, m.status, i.vendor_name, i.total_amount_minor,
  coalesce(i.currency, 'INR') AS currency, {FAILURE_SQL.replace('status', 'm.status').replace('ignored_reason', 'm.ignored_reason')}
    AS failure_message
FROM inbox_messages m LEFT JOIN sources s ON m.source_id = s.id
LEFT JOIN invoices i ON i.inbox_message_id = m.id"""
INBOX_VIEWS = ("inbox_messages", "sources", "invoices")


@query("q10_inbox_list", INBOX, INBOX_VIEWS)
def _(g):
    return D.inbox_list(g.inbox_messages, g.sources, g.invoices)


@query(
    "q10_inbox_page",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id
      ORDER BY received_at DESC, invoice_id) AS rank FROM ({INBOX} WHERE m.status = 'queued'))
    WHERE rank > 5 AND rank <= 105""", INBOX_VIEWS,
)
def _(g):
    rows = D.inbox_list(g.inbox_messages, g.sources, g.invoices, "queued")
    return D.page_per_tenant(rows, "workspace_id", "received_at", "invoice_id", 100, 5)


@query("q11_inbox_counts", "SELECT workspace_id, count(*) AS messages FROM inbox_messages GROUP BY 1",
       ("inbox_messages",))
def _(g):
    return D.inbox_counts(g.inbox_messages)


@query(
    "q12_invoice_lists",
    """SELECT * FROM (SELECT workspace_id, id, status, created_at, row_number() OVER
      (PARTITION BY workspace_id ORDER BY created_at DESC, id) AS rank FROM invoices)
    WHERE rank > 10 AND rank <= 60""", ("invoices",),
)
def _(g):
    rows = g.invoices.select("workspace_id", "id", "status", "created_at")
    return D.page_per_tenant(rows, "workspace_id", "created_at", "id", 50, 10)


@query(
    "q12_inbox_by_status",
    "SELECT workspace_id, id, received_at FROM inbox_messages WHERE status = 'failed'",
    ("inbox_messages",),
)
def _(g):
    return g.inbox_messages.where("status = 'failed'").select("workspace_id", "id", "received_at")


@query(
    "q13_point_lookups",
    """SELECT i.workspace_id, i.id, i.invoice_no FROM invoices i WHERE EXISTS (SELECT 1 FROM jobs j
    WHERE j.state = 'failed' AND j.invoice_id = i.id AND j.workspace_id = i.workspace_id)""",
    ("invoices", "jobs"),
)
def _(g):
    asked = g.jobs.where("state = 'failed'").select("workspace_id", F.col("invoice_id").alias("id"))
    return D.lookup(g.invoices, asked, ["workspace_id", "id"]).select("workspace_id", "id", "invoice_no")


SUMMARY = """SELECT i.workspace_id, i.id AS invoice_id, i.status, i.vendor_name, i.invoice_no, i.invoice_date,
  i.total_amount_minor, i.currency, coalesce(s.kind, 'upload') AS source_kind, m.received_at,
  m.status AS extraction_status,
  coalesce(c.p, 0) AS pass_count, coalesce(c.f, 0) AS fail_count, coalesce(c.n, 0) AS not_applicable_count,
  '/api/invoices/' || i.id || '/image' AS image_url
FROM invoices i JOIN inbox_messages m ON m.id = i.inbox_message_id AND m.workspace_id = i.workspace_id
LEFT JOIN sources s ON s.id = m.source_id
LEFT JOIN (SELECT workspace_id, invoice_id, count(*) FILTER (outcome = 'PASS') AS p,
    count(*) FILTER (outcome = 'FAIL') AS f, count(*) FILTER (outcome = 'NOT_APPLICABLE') AS n
  FROM validation_findings GROUP BY 1, 2) c ON c.workspace_id = i.workspace_id AND c.invoice_id = i.id"""
SUMMARY_VIEWS = ("invoices", "inbox_messages", "sources", "validation_findings")


def summaries(g):
    return D.invoice_summaries(g.invoices, g.inbox_messages, g.sources, g.validation_findings)


@query("q14_invoice_summaries", SUMMARY, SUMMARY_VIEWS)
def _(g):
    return summaries(g)


TEXTS = ", ".join(
    f"coalesce(t.{c}, {lit(general)}) AS display_{c}"
    for c, general in zip(("title", "explanation", "suggestion"), RULE_FALLBACK)
)


@query(
    "q15_business_flags",
    f"""SELECT f.workspace_id, f.invoice_id, f.rule_name, f.target, {TEXTS}
    FROM validation_findings f LEFT JOIN rule_text t ON t.rule_name = f.rule_name WHERE f.outcome = 'FAIL'""",
    ("validation_findings",), extra=RULE_CTE,
)
def _(g):
    return D.business_flags(g.validation_findings).select(
        "workspace_id", "invoice_id", "rule_name", "target", "display_title",
        "display_explanation", "display_suggestion",
    )


@query(
    "q16_accountant_details",
    """SELECT b.*, r.pipeline_version, r.total_ms, r.ocr_result_json,
      CASE WHEN json_valid(r.extraction_result_json) THEN r.extraction_result_json END AS extraction_result_json,
      r.tables_result_json, r.validation_result_json
    FROM base b LEFT JOIN (SELECT * FROM pipeline_runs QUALIFY row_number() OVER
      (PARTITION BY workspace_id, invoice_id ORDER BY created_at DESC, id DESC) = 1) r
    USING (workspace_id, invoice_id)""",
    (*SUMMARY_VIEWS, "pipeline_runs"), extra=f"base AS ({SUMMARY})",
)
def _(g):
    return D.accountant_details(summaries(g), g.pipeline_runs)


@query(
    "q17_invoice_per_message",
    """SELECT workspace_id, inbox_message_id, id AS invoice_id FROM invoices QUALIFY row_number() OVER
    (PARTITION BY workspace_id, inbox_message_id ORDER BY created_at DESC, id DESC) = 1""", ("invoices",),
)
def _(g):
    return D.invoice_per_message(g.invoices)


@query(
    "q18_connected_mailboxes",
    """SELECT s.id AS source_id, s.workspace_id, w.owner_user_id, s.last_polled_at FROM sources s
    JOIN workspaces w ON w.id = s.workspace_id WHERE s.kind = 'gmail' AND s.status = 'connected'""",
    ("sources", "workspaces"),
)
def _(g):
    return D.connected_mailboxes(g.sources, g.workspaces)


CORPUS = "SELECT doc_id, lang AS split, doc_id AS index FROM documents"


@query(
    "q19_corpus_meta",
    """SELECT lang AS split, count(*) AS documents, count(l.doc_id) AS cached_documents
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def _(g):
    docs = g.documents.select("doc_id", F.col("lang").alias("split"))
    return D.corpus_meta(docs, g.labels)


@query(
    "q19_corpus_list",
    """SELECT doc_id, lang AS split, doc_id AS index, doc_id IN (SELECT doc_id FROM labels) AS cached
    FROM documents""",
)
def _(g):
    docs = g.documents.select("doc_id", F.col("lang").alias("split"), F.col("doc_id").alias("index"))
    return D.corpus_list(docs, g.labels)


@query(
    "f25_rule_texts",
    f"""SELECT f.id, {TEXTS} FROM validation_findings f LEFT JOIN rule_text t ON t.rule_name = f.rule_name""",
    ("validation_findings",), extra=RULE_CTE,
)
def _(g):
    return with_rule_texts(g.validation_findings).select(
        "id", "display_title", "display_explanation", "display_suggestion"
    )


@query("f26_failure_messages", f"SELECT id, status, {FAILURE_SQL} AS message FROM inbox_messages",
       ("inbox_messages",))
def _(g):
    from tallyvine.functions.messages import failure_message

    return g.inbox_messages.select(
        "id", "status", failure_message(F.col("status"), F.col("ignored_reason")).alias("message")
    )


# --- access audit --------------------------------------------------------------

AS_OF = 1705276800000


@query(
    "a01_active_sessions",
    f"SELECT id, user_id, expires_at FROM sessions WHERE revoked_at IS NULL AND expires_at > {AS_OF}",
    ("sessions",),
)
def _(g):
    return A.active_sessions(g.sessions, AS_OF).select("id", "user_id", "expires_at")


@query(
    "a02_latest_challenges",
    f"""SELECT phone, purpose, id, created_at, expires_at, attempts FROM otp_challenges
    WHERE used_at IS NULL AND expires_at > {AS_OF} AND attempts < max_attempts
    QUALIFY row_number() OVER (PARTITION BY phone, purpose ORDER BY created_at DESC, id DESC) = 1""",
    ("otp_challenges",),
)
def _(g):
    return A.latest_challenges(g.otp_challenges, AS_OF)


LOGIN_CTE = """logins AS (SELECT id AS login_id, user_id, ts, action <> 'login.failed' AS success
  FROM audit_events),
islands AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, login_id)
  AS island FROM logins),
states AS (SELECT user_id, login_id, ts, success, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER
  (PARTITION BY user_id, island ORDER BY ts, login_id) AS n FROM islands)"""


def logins(g):
    return g.audit_events.select(
        F.col("id").alias("login_id"), "user_id", "ts", (F.col("action") != "login.failed").alias("success")
    )


@query(
    "a03_lockout_states",
    """SELECT user_id, login_id, ts, success, cast(n as bigint) AS failed_login_count,
    CASE WHEN NOT success AND n >= 2 THEN ts + 900000 END AS locked_until FROM states""",
    ("audit_events",), extra=LOGIN_CTE,
)
def _(g):
    return A.lockout_states(logins(g), 2, 900_000)


@query(
    "a03_locked_users",
    f"""SELECT user_id, cast(n as bigint) AS failed_login_count, ts + 86400000 * 10 AS locked_until FROM
    (SELECT * FROM states WHERE ts <= {AS_OF} QUALIFY row_number() OVER
      (PARTITION BY user_id ORDER BY ts DESC, login_id DESC) = 1)
    WHERE NOT success AND n >= 2 AND ts + 86400000 * 10 > {AS_OF}""",
    ("audit_events",), extra=LOGIN_CTE,
)
def _(g):
    return A.locked_users(A.lockout_states(logins(g), 2, 864_000_000), AS_OF)


DUE = 915148800000


@query("a04_due_jobs", f"SELECT id, next_run_at FROM jobs WHERE state = 'queued' AND next_run_at <= {DUE}",
       ("jobs",))
def _(g):
    return A.due_jobs(g.jobs, DUE).select("id", "next_run_at")


@query(
    "a04_next_due",
    f"""SELECT id, next_run_at FROM jobs WHERE state = 'queued' AND next_run_at <= {DUE}
    ORDER BY next_run_at, id LIMIT 50""", ("jobs",),
)
def _(g):
    return A.next_due(g.jobs, DUE, 50).select("id", "next_run_at")


@query(
    "q10_deep_page",
    f"""SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY workspace_id
      ORDER BY received_at DESC, invoice_id) as int) AS rank FROM ({INBOX}))
    WHERE rank > 120 AND rank <= 170""", INBOX_VIEWS,
)
def _(g):
    """The fourth page or so of every tenant's whole list, through the directory of ranges."""
    path = f"{shared_folder(g.spark)}/pages-{uuid.uuid4().hex}"
    rows = D.inbox_list(g.inbox_messages, g.sources, g.invoices)
    D.write_pages(rows, path, "workspace_id", "received_at", "invoice_id", 500)
    return D.read_page(g.spark, path, "workspace_id", "received_at", "invoice_id", 50, 120)


@query(
    "q01_stored_months",
    f"""SELECT * FROM ({TILES} GROUP BY 1, 2) WHERE month_ms >= 820454400000""", IV,
)
def _(g):
    """Tiles kept by month: first without the flagged invoices, then their months again; later months only are read."""
    path = f"{shared_folder(g.spark)}/months-{uuid.uuid4().hex}"
    D.refresh_months(g.invoices.where("status <> 'flagged'"), g.validation_findings, path)
    batch = g.invoices.where("status = 'flagged'")
    D.refresh_months(g.invoices, g.validation_findings, path, D.changed_months(batch))
    columns = D.monthly_totals(g.invoices, g.validation_findings).columns
    return D.stored_months(g.spark, path, "tiles", 820454400000).select(*columns)
