"""Sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tallyvine.functions.files import sha256_hex, sniff_content_type, storage_key
from tallyvine.operators.evaluate import EVALUATED_FIELDS, ITEM_FIELDS
from tallyvine.plans import reports
from tallyvine.session import shared_folder
from tallyvine.sources import csv_export as C
from tallyvine.sources import groundtruth as G
from tallyvine.sources import store as S
from tallyvine.sources.config import KEYWORDS, mailbox_config
from verification.evaluation_queries import FG, HEADER, PER_FIELD, SCORES
from verification.registry import query
from verification.upkeep_queries import SNIFF


@query(
    "s01_corpus_ids",
    "SELECT lang AS split, 'katanaml-' || lang || '-' || lpad(cast(doc_id as varchar), 5, '0') AS id FROM documents",
)
def _(g):
    split = F.col("lang")
    return g.documents.select(split.alias("split"), G.document_id(split, F.col("doc_id")).alias("id"))


@query("s01_split_counts", "SELECT lang AS split, count(*) AS documents FROM documents GROUP BY 1")
def _(g):
    return G.split_counts(g.documents.select(F.col("lang").alias("split")))


def truth_docs(g):
    """Ground-truth records: header from the order, items from its lines; some wrapped,
    some bare, some broken, some missing."""
    header = g.header.select(
        "doc_id", F.col("batch_index"),
        F.struct(*[F.col(c) for c in EVALUATED_FIELDS]).alias("header"),
    )
    items = g.item.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("item_index", *ITEM_FIELDS))).alias("items")
    )
    both = header.join(items, "doc_id", "left").select(
        "doc_id", "header", F.col("header.client").alias("kind"),
        F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in ITEM_FIELDS])).alias("items"),
    )
    iban = F.col("header.iban")
    bare = F.to_json(F.struct("header", "items"))
    wrapped = F.to_json(F.struct(F.struct("header", "items").alias("gt_parse")))
    text = (
        F.when(iban.isNull(), F.lit(None).cast("string"))
        .when(F.contains(iban, F.lit("-")), F.concat(F.lit("{broken "), bare))
        .when(F.contains(iban, F.lit(" ")), bare)
        .otherwise(wrapped)
    )
    return both.select("doc_id", text.cast("binary").alias("ground_truth"))


READABLE = "iban IS NOT NULL AND NOT contains(iban, '-')"


@query(
    "s02_parsed_truth",
    "SELECT doc_id, contains(iban, '-') IS TRUE AS kept_raw, iban IS NULL AS missing FROM header", ("header",),
)
def _(g):
    parsed = G.parse_truth(truth_docs(g))
    return parsed.select(
        "doc_id", F.col("raw").isNotNull().alias("kept_raw"), F.col("ground_truth").isNull().alias("missing")
    )


@query(
    "s03_truth_headers",
    " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS name, CASE WHEN {READABLE} THEN {n} END AS value FROM header" for n in EVALUATED_FIELDS
    ), ("header",),
)
def _(g):
    return G.header_of(G.parse_truth(truth_docs(g)))


@query(
    "s03_truth_items",
    f"SELECT item.* FROM item JOIN header USING (doc_id) WHERE {READABLE}", ("item", "header"),
)
def _(g):
    return G.items_of(G.parse_truth(truth_docs(g)))


@query("s04_sniffed_types", f"SELECT upload_id, {SNIFF} AS content_type FROM (SELECT *, hex(data) AS h FROM uploads)",
       ("uploads",))
def _(g):
    return g.uploads.select("upload_id", sniff_content_type(F.col("data")).alias("content_type"))


@query("s05_content_hashes", "SELECT upload_id, sha256(data) AS sha FROM uploads", ("uploads",))
def _(g):
    return g.uploads.select("upload_id", sha256_hex(F.col("data")).alias("sha"))


@query(
    "s06_storage_keys",
    """SELECT id, workspace_id || '/' || left(file_sha256, 2) || '/' || id ||
    CASE content_type WHEN 'image/png' THEN '.png' ELSE '.pdf' END AS key FROM inbox_messages""",
    ("inbox_messages",),
)
def _(g):
    key = storage_key(F.col("workspace_id"), F.col("file_sha256"), F.col("id"), F.col("content_type"))
    return g.inbox_messages.select("id", key.alias("key"))


@query(
    "s06_stored_blobs",
    """SELECT workspace_id, sha256(data) AS file_sha256, left(sha256(data), 2) AS sha_prefix, octet_length(data) AS bytes FROM uploads
    WHERE octet_length(data) > 0""", ("uploads",),
)
def _(g):
    """Contents written by tenant and first hash digits, and read back with their folders."""
    path = f"{shared_folder(g.spark)}/blobs-{uuid.uuid4().hex}"
    S.write_blobs(g.uploads.where("length(data) > 0").select("workspace_id", "data", sha256_hex(F.col("data")).alias("file_sha256")), path)
    back = g.spark.read.schema("workspace_id string, sha_prefix string, file_sha256 string, data binary").parquet(path)
    return back.select("workspace_id", F.sha2("data", 256).alias("file_sha256"), "sha_prefix", F.length("data").cast("bigint").alias("bytes"))


# Store records: one per event; the user is the id, the event number the order.
RECORDS = """CASE event_type WHEN 'error' THEN '{broken' WHEN 'view' THEN '  '
  WHEN 'signup' THEN concat('{{"data":', cast(event_id as string), '}}')
  ELSE concat('{{"id":"', cast(user_id as string), '","data":{{"event":', cast(event_id as string), '}}}}') END"""
LAST = """SELECT cast(user_id as varchar) AS id, '{"event":' || max(event_id) || '}' AS data FROM events
WHERE event_type IN ('click', 'purchase') GROUP BY 1"""


def record_lines(g):
    return g.events.select(
        F.col("event_id").alias("seq"), F.expr(RECORDS.replace("{{", "{").replace("}}", "}")).alias("value")
    )


@query("s07_store_replay", LAST)
def _(g):
    return S.last_records(S.parse_records(record_lines(g)), ["seq"])


@query("s07_store_round_trip", LAST)
def _(g):
    path = f"{shared_folder(g.spark)}/store-{uuid.uuid4().hex}"
    records = S.parse_records(record_lines(g))
    S.append_store(records, path, F.col("seq"))
    return S.read_store(g.spark, path)


CSV = "SELECT doc_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in EVALUATED_FIELDS) + (
    ", coalesce(cast(item_index as varchar), '') AS item_index, "
    + ", ".join(f"coalesce({c}, '') AS {c}" for c in ITEM_FIELDS)
) + " FROM header LEFT JOIN item USING (doc_id)"


@query("s08_csv_rows", CSV, ("header", "item"))
def _(g):
    return C.csv_rows(g.header, g.item)


@query("s09_csv_round_trip", CSV.replace("SELECT doc_id, ", "SELECT "), ("header", "item"))
def _(g):
    path = f"{shared_folder(g.spark)}/csv-{uuid.uuid4().hex}"
    C.write_csv(C.csv_rows(g.header, g.item), path)
    back = g.spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).schema(
        ", ".join(f"{c} string" for c in C.ALL_COLUMNS)
    ).csv(path)
    return back.fillna("")


@query(
    "s10_stage_outputs",
    """SELECT id, CASE WHEN disc_ok THEN fields END AS fields, items FROM (SELECT id, json_valid(extraction_result_json) AS disc_ok,
      cast(json_extract(CASE WHEN json_valid(extraction_result_json) THEN extraction_result_json END, '$.fields') as int) AS fields,
      cast(json_extract(tables_result_json, '$.items') as int) AS items FROM pipeline_runs)""", ("pipeline_runs",),
)
def _(g):
    return g.pipeline_runs.select(
        "id", S.read_json(F.col("extraction_result_json"), "fields int")["fields"].alias("fields"),
        S.read_json(F.col("tables_result_json"), "items int")["items"].alias("items"),
    )


@query(
    "s10_stage_json",
    """SELECT doc_id, '{"invoice_no":' || coalesce('"' || invoice_no || '"', 'null') || ',"invoice_date":'
    || coalesce('"' || invoice_date || '"', 'null') || '}' AS packed FROM header""", ("header",),
)
def _(g):
    return S.stage_json(g.header, ["invoice_no", "invoice_date"], "packed").select("doc_id", "packed")


@query(
    "s11_audit_metadata",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN '{"type":"' || event_type || '","user":"' || user_id || '"}' END
    AS metadata_json FROM events""",
)
def _(g):
    entries = F.when(
        F.col("event_type") != "view",
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")),
    ).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return g.events.select("event_id", S.metadata_json(entries).alias("metadata_json"))


@query("s11_appended_events", "SELECT id, workspace_id, action, ts FROM audit_events", ("audit_events",))
def _(g):
    """The day's audit rows in two appends."""
    path = f"{shared_folder(g.spark)}/audit-{uuid.uuid4().hex}"
    rows = g.audit_events.select("id", "workspace_id", "action", "ts")
    S.append_events(rows.where("action = 'login.failed'"), path)
    S.append_events(rows.where("action <> 'login.failed'"), path)
    return g.spark.read.schema(rows.schema).parquet(path)


@query(
    "s12_without_seeded_tenants",
    """SELECT id, workspace_id FROM invoices WHERE workspace_id NOT IN (SELECT workspace_id FROM audit_events
    WHERE json_extract_string(metadata_json, '$.seed') = 'demo')""",
    ("invoices", "audit_events"),
)
def _(g):
    return S.without_tenants(g.invoices, S.tagged_tenants(g.audit_events, "demo")).select("id", "workspace_id")


WIPED = ("workspaces", "users", "sources", "inbox_messages", "invoices", "pipeline_runs", "validation_findings", "jobs", "audit_events")
GONE = """gone_ws AS (SELECT id, owner_user_id FROM workspaces WHERE id IN (SELECT workspace_id FROM audit_events WHERE json_extract_string(metadata_json, '$.seed') = 'demo')),
gone_msg AS (SELECT id FROM inbox_messages WHERE workspace_id IN (SELECT id FROM gone_ws)),
gone_inv AS (SELECT id FROM invoices WHERE workspace_id IN (SELECT id FROM gone_ws) OR inbox_message_id IN (SELECT id FROM gone_msg)),
gone AS (SELECT 'workspaces' AS kind, id FROM gone_ws UNION ALL SELECT 'users', id FROM users WHERE id IN (SELECT owner_user_id FROM gone_ws)
  UNION ALL SELECT 'sources', id FROM sources WHERE workspace_id IN (SELECT id FROM gone_ws)
  UNION ALL SELECT 'inbox_messages', id FROM gone_msg UNION ALL SELECT 'invoices', id FROM gone_inv
  UNION ALL SELECT 'pipeline_runs', id FROM pipeline_runs WHERE invoice_id IN (SELECT id FROM gone_inv)
  UNION ALL SELECT 'validation_findings', id FROM validation_findings WHERE invoice_id IN (SELECT id FROM gone_inv)
  UNION ALL SELECT 'jobs', id FROM jobs WHERE inbox_message_id IN (SELECT id FROM gone_msg)
  UNION ALL SELECT 'events', id FROM audit_events WHERE json_extract_string(metadata_json, '$.seed') = 'demo')"""


def seeded(g):
    tables = {t: g.view(t) for t in WIPED[:-1]}
    return tables, S.tombstones(tables, S.tagged_tenants(g.audit_events, "demo"), g.audit_events, "demo")


@query("s12_tombstones", "SELECT * FROM gone", WIPED, GONE)
def _(g):
    out = None
    for kind, ids in seeded(g)[1].items():
        rows = ids.select(F.lit(kind).alias("kind"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "s12_wiped_and_seeded_again",
    """SELECT 'invoices' AS kind, id, status AS detail FROM invoices WHERE id NOT IN (SELECT id FROM gone WHERE kind = 'invoices')
    UNION ALL SELECT 'jobs', id, state FROM jobs WHERE id NOT IN (SELECT id FROM gone WHERE kind = 'jobs')
    UNION ALL SELECT 'invoices', i.id, 'pending' FROM invoices i JOIN gone_ws w ON w.id = i.workspace_id WHERE i.status = 'flagged'""", WIPED, GONE,
)
def _(g):
    """The tagged tenants' flagged invoices are put in again, as pending."""
    tables, gone = seeded(g)
    again = tables["invoices"].join(gone["workspaces"].select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi").where("status = 'flagged'")
    again = again.withColumn("status", F.lit("pending")).select(*tables["invoices"].columns)
    left = S.wiped({t: tables[t] for t in ("invoices", "jobs")}, gone, {"invoices": again})
    row = lambda kind, column: left[kind].select(F.lit(kind).alias("kind"), "id", F.col(column).alias("detail"))
    return row("invoices", "status").unionByName(row("jobs", "state"))


# A configuration document as an operator writes it: the parser's keywords do the counting.
SETTINGS = {"email_ingestion": {"subject_keywords": [f" {k.title()} " for k in KEYWORDS] + ["  "], "max_attachments_per_message": 5}}


@query(
    "s14_keyword_documents",
    "SELECT doc_id, len(list_filter(" + str(list(KEYWORDS)) + ", lambda k: contains(lower(text), k))) AS keywords FROM documents",
)
def _(g):
    low = F.lower("text")
    words = F.array(*[F.lit(k) for k in mailbox_config(json.dumps(SETTINGS)).keywords()])
    return g.documents.select(
        "doc_id", F.size(F.filter(words, lambda k: F.contains(low, k))).cast("bigint").alias("keywords")
    )


@query("e15_report_round_trip", SCORES.format(PER_FIELD), FG, HEADER)
def _(g):
    path = f"{shared_folder(g.spark)}/report-{uuid.uuid4().hex}"
    frames = reports.header_report(g.field, g.field_gt)
    reports.write_report({"fields": frames["fields"]}, path)
    return g.spark.read.schema(frames["fields"].schema).json(f"{path}/fields")
