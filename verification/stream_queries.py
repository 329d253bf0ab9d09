"""Incremental ingestion in batch form, the throttle and the hourly rollup, and two
streaming runs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyvine.operators import audit as A
from tallyvine.session import shared_folder
from tallyvine.sources.config import CONTENT_TYPES, MailboxConfig
from tallyvine.streaming import audit_stream as S
from tallyvine.streaming import mailbox as M
from verification.registry import query
from verification.upkeep_queries import DID

CONFIG = MailboxConfig(subject_keywords=("Invoice", "bill ", "po"), max_attachments_per_message=2,
                       max_messages_per_poll=20)
NOW = 1706745600000
TYPES = "(" + ", ".join(f"'{t}'" for t in CONTENT_TYPES) + ")"

# A message per conversation, a part per turn. Its mailbox follows from the first
# speaker, its subject from the number of turns.
PARTS = """part AS (SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'application/pdf' WHEN 'assistant' THEN 'image/png' ELSE 'text/plain' END AS mime,
    CASE WHEN role = 'assistant' AND length(text) < 120 THEN '' ELSE 'file-' || turn END AS filename,
    'att-' || turn AS attachment_id FROM conversations),
message AS (SELECT conv_id, 'msg-' || conv_id AS message_id, count(*) AS n,
    CASE WHEN min(role) = 'assistant' AND max(role) = 'system' THEN 'src-11-gmail'
      WHEN count(*) > 4 THEN 'src-7-gmail' WHEN count(*) = 2 THEN 'src-0-gmail' ELSE 'src-12-gmail' END AS source_id,
    CASE WHEN count(*) > 6 THEN 'Your INVOICE' WHEN count(*) > 4 THEN 'Newsletter' WHEN count(*) > 2 THEN 'A Bill ' ELSE 'report' END AS subject,
    1704067200000 + conv_id * 3600000 AS received_at,
    CASE conv_id % 11 WHEN 3 THEN 'SPAM' WHEN 7 THEN 'trash' ELSE 'inbox' END AS folder,
    count(*) FILTER (filename <> '') > 0 AS attached FROM part GROUP BY 1)"""
WORDS = "(lower(folder) NOT IN ('spam', 'trash') AND (contains(lower(subject), 'invoice') OR contains(lower(subject), 'bill') OR contains(lower(subject), 'po')))"


def messages(g):
    turns = g.conversations.select(
        "conv_id", "role",
        F.struct(
            F.col("turn"),
            F.when((F.col("role") == "assistant") & (F.length("text") < 120), "")
            .otherwise(F.concat(F.lit("file-"), F.col("turn").cast("string"))).alias("filename"),
            F.when(F.col("role") == "user", "application/pdf").when(F.col("role") == "assistant", "image/png")
            .otherwise("text/plain").alias("mimeType"),
            F.concat(F.lit("att-"), F.col("turn").cast("string")).alias("attachmentId"),
            F.translate(
                F.base64(F.concat(F.expr("unhex('255044462D')"), F.col("text").cast("binary"))), "+/", "-_"
            ).alias("data"),
        ).alias("p"),
    )
    # A message record holds its own parts; a conversation is one message.
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("p")).alias("parts"), F.count("*").alias("n"),
        F.min("role").alias("lo"), F.max("role").alias("hi"),
    )
    n = F.col("n")
    source = (
        F.when((F.col("lo") == "assistant") & (F.col("hi") == "system"), "src-11-gmail")
        .when(n > 4, "src-7-gmail").when(n == 2, "src-0-gmail").otherwise("src-12-gmail")
    )
    subject = F.when(n > 6, "Your INVOICE").when(n > 4, "Newsletter").when(n > 2, "A Bill ").otherwise("report")
    header = lambda name, value: F.struct(F.lit(name).cast("string").alias("name"), value.alias("value"))
    return grouped.select(
        source.alias("source_id"),
        F.concat(F.lit("msg-"), F.col("conv_id").cast("string")).alias("message_id"),
        (F.lit(1704067200000) + F.col("conv_id") * 3600000).alias("received_at"),
        F.when(F.col("conv_id") % 11 == 3, "SPAM").when(F.col("conv_id") % 11 == 7, "trash").otherwise("inbox").alias("folder"),
        F.array(
            header(None, F.lit("nameless")), header("Subject", F.lit("first")), header("From", F.concat(F.lit("s@"), source)),
            header("SUBJECT", subject),
        ).alias("headers"),
        F.transform("parts", lambda p: F.struct(
            p["filename"].alias("filename"), p["mimeType"].alias("mimeType"),
            p["attachmentId"].alias("attachmentId"), p["data"].alias("data"),
        )).alias("parts"),
    )


SRC = ("sources",)
SINCE = f"""CASE WHEN coalesce(s.last_polled_at, 0) <> 0 THEN (s.last_polled_at // 1000) * 1000
  ELSE {NOW - 30 * 86400000} END"""


@query(
    "r01_since_cursor",
    f"""SELECT message_id, m.source_id, s.workspace_id FROM message m JOIN sources s ON s.id = m.source_id
    WHERE s.status = 'connected' AND received_at >= {SINCE}""", SRC, PARTS,
)
def _(g):
    return M.new_since_cursor(messages(g), g.sources, CONFIG, NOW).select("message_id", "source_id", "workspace_id")


@query(
    "r01_fetch_now",
    "SELECT message_id, m.source_id FROM message m JOIN sources s ON s.id = m.source_id WHERE s.status = 'connected'",
    SRC, PARTS,
)
def _(g):
    return M.new_since_cursor(messages(g), g.sources, CONFIG, NOW, unbounded=True).select("message_id", "source_id")


@query(
    "r01_cursors",
    f"""SELECT id, CASE WHEN id IN (SELECT source_id FROM message) THEN {NOW} ELSE last_polled_at END AS last_polled_at
    FROM sources""", SRC, PARTS,
)
def _(g):
    return M.advance_cursors(g.sources, messages(g), NOW).select("id", "last_polled_at")


@query("r02_selected_messages", f"SELECT message_id, subject FROM message WHERE attached AND {WORDS}", (), PARTS)
def _(g):
    return M.select_messages(messages(g), CONFIG).select("message_id", "subject")


@query(
    "r03_flattened_parts",
    """SELECT 'msg-' || conv_id AS message_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 as int) AS part_no,
      filename, mime AS "mimeType" FROM part QUALIFY filename <> ''""", (), PARTS,
)
def _(g):
    return M.flatten_parts(messages(g)).select("message_id", "part_no", "filename", "mimeType")


# The same parts as a tree: an odd turn is forwarded inside the message of the one before it.
NESTED = f"""{PARTS}, nested AS (SELECT conv_id, cast('{{"parts":[' || string_agg(CASE WHEN turn % 2 = 1
      THEN '{{"mimeType":"message/rfc822","filename":"","parts":[' ELSE '' END || '{{"filename":"' || filename || '","mimeType":"' || mime
      || '","body":{{"attachmentId":"' || attachment_id || '"}}}},', '' ORDER BY turn) || '{{}}' || repeat(']}}', cast(count(*) FILTER (turn % 2 = 1) as int))
      || ']}}' as json) AS payload FROM part GROUP BY 1),
walk AS (/* recursive */ SELECT conv_id, cast([] as int[]) AS path, payload AS node FROM nested
  UNION ALL SELECT conv_id, list_append(path, cast(i as int)), json_extract(node, '$.parts[' || i || ']')
  FROM (SELECT *, unnest(range(cast(coalesce(json_array_length(node, '$.parts'), 0) as bigint))) AS i FROM walk))"""


def nested_messages(g):
    """Messages of ``MIME_MESSAGE``: the flat ones with their parts as a tree."""
    field = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    part = lambda p, i: F.concat(
        F.when(i % 2 == 1, '{"mimeType":"message/rfc822","filename":"","parts":[').otherwise(""),
        F.lit("{"), field("filename", p["filename"]), F.lit(","), field("mimeType", p["mimeType"]), F.lit(',"body":{'),
        field("attachmentId", p["attachmentId"]), F.lit(","), field("data", F.translate(p["data"], "\r\n", "")), F.lit("}},"),
    )
    odd = F.floor(F.size("parts") / 2).cast("int")
    headers = F.to_json(F.filter("headers", lambda h: h["name"].isNotNull()))
    tree = F.concat(F.lit('{"headers":'), headers, F.lit(',"parts":['), F.array_join(F.transform("parts", part), ""), F.lit("{}"), F.repeat(F.lit("]}"), odd), F.lit("]}"))
    return messages(g).select("source_id", "message_id", "received_at", "folder", tree.alias("payload"))


@query(
    "r03_nested_parts",
    """SELECT 'msg-' || conv_id AS message_id, array_to_string(path, '.') AS place, json_extract_string(node, '$.filename') AS filename,
    json_extract_string(node, '$.body.attachmentId') AS attachment_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY path) AS rank FROM walk""", (), NESTED,
)
def _(g):
    parts = M.from_mime(nested_messages(g)).select("message_id", F.posexplode("parts").alias("i", "p"))
    return parts.select(
        "message_id", F.array_join(F.col("p.path").cast("array<string>"), ".").alias("place"), "p.filename",
        F.col("p.attachmentId").alias("attachment_id"), (F.col("i") + 1).cast("long").alias("rank"),
    )


JUDGED = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part_no FROM part),
usable AS (SELECT *, mime IN {TYPES} AS allowed, count(*) FILTER (mime IN {TYPES}) OVER
    (PARTITION BY conv_id ORDER BY part_no) AS k FROM numbered WHERE filename <> ''),
judged AS (SELECT conv_id, part_no, filename, mime, text, CASE
    WHEN k > 3 OR (k = 3 AND NOT allowed) THEN 'abandon' WHEN k = 3 THEN 'skip'
    WHEN NOT allowed THEN 'skip' ELSE 'take' END AS verdict FROM usable)"""


@query(
    "r04_judged_parts",
    "SELECT 'msg-' || conv_id AS message_id, cast(part_no as int) AS part_no, verdict FROM judged", (), f"{PARTS}, {JUDGED}",
)
def _(g):
    return M.judge_parts(messages(g), CONFIG).select("message_id", "part_no", "verdict")


@query(
    "r05_capped_messages",
    """SELECT source_id, message_id FROM message QUALIFY rank() OVER (PARTITION BY source_id
    ORDER BY received_at // 1000) <= 20""", (), PARTS,
)
def _(g):
    # The cap per poll is the operator's own feature.
    return M.cap_messages(messages(g), CONFIG).select("source_id", "message_id")


def polled(g):
    new = M.new_since_cursor(messages(g), g.sources, CONFIG, NOW, unbounded=True)
    return M.select_messages(new, CONFIG)


POLLED = f"""{PARTS}, {JUDGED}, polled AS (SELECT m.*, s.workspace_id FROM message m JOIN sources s ON s.id = m.source_id
    WHERE s.status = 'connected' AND attached AND {WORDS}),
taken AS (SELECT p.workspace_id, p.source_id, p.message_id, p.received_at, p.subject, 's@' || p.source_id AS sender,
    'gmail:' || p.message_id || ':att-' || n.turn AS external_id, sha256(from_hex('255044462D') || encode(n.text)) AS file_sha256,
    row_number() OVER (PARTITION BY p.workspace_id, sha256(from_hex('255044462D') || encode(n.text))
      ORDER BY p.received_at, p.conv_id, n.part_no) AS rn
  FROM polled p JOIN judged j USING (conv_id) JOIN numbered n ON n.conv_id = j.conv_id AND n.part_no = j.part_no
  WHERE j.verdict = 'take')"""


@query(
    "r06_new_attachments",
    "SELECT workspace_id, file_sha256, min(received_at) AS received_at, min(subject) AS subject FROM taken GROUP BY 1, 2",
    SRC, POLLED,
)
def _(g):
    uploads = M.to_uploads(M.judge_parts(polled(g), CONFIG))
    empty = g.inbox_messages.select("workspace_id", "file_sha256")
    fresh = M.new_attachments(uploads, empty)
    return fresh.groupBy("workspace_id", "file_sha256").agg(
        F.min("received_at").alias("received_at"), F.min("subject").alias("subject")
    )


# Every accepted part of connected, live mailboxes; a hash is new once in a tenant.
STREAMED = f"""{PARTS}, live AS (SELECT s.id AS source_id, s.workspace_id, w.owner_user_id AS user_id FROM sources s JOIN workspaces w ON w.id = s.workspace_id
    WHERE s.kind = 'gmail' AND s.status = 'connected'),
arrived AS (SELECT l.workspace_id, l.user_id, p.source_id, m.message_id, p.attachment_id, sha256(from_hex('255044462D') || encode(p.text)) AS file_sha256,
    octet_length(from_hex('255044462D') || encode(p.text)) AS bytes
  FROM (SELECT part.*, source_id FROM part JOIN message USING (conv_id)) p JOIN message m USING (conv_id) JOIN live l ON l.source_id = m.source_id
  WHERE m.attached AND {WORDS.replace('lower(subject)', 'lower(m.subject)')} AND p.filename <> '' AND p.mime IN {TYPES}),
known AS (SELECT workspace_id, any_value(user_id) AS user_id, file_sha256, any_value(bytes) AS bytes, {DID.format('msg', 'workspace_id, file_sha256')} AS message
  FROM arrived GROUP BY workspace_id, file_sha256)"""


@query(
    "r06_stream_rows",
    f"""SELECT 'inbox' AS kind, message AS id, workspace_id, cast(bytes as varchar) AS detail FROM known
    UNION ALL SELECT 'invoice', {DID.format('inv', 'message')}, workspace_id, message FROM known
    UNION ALL SELECT 'job', {DID.format('job', f"{DID.format('upl', 'a.source_id, a.message_id, a.attachment_id')}, message")}, workspace_id, message
      FROM arrived a JOIN known USING (workspace_id, file_sha256)
    UNION ALL SELECT 'event', {DID.format('evt', f"{DID.format('inv', 'message')}, 'invoice.uploaded'")}, workspace_id, user_id FROM known
    UNION ALL SELECT 'blob', message, NULL, file_sha256 FROM known""", ("sources", "workspaces"), STREAMED,
)
def _(g):
    """Nested messages through the whole ingest as a stream of several batches."""
    folder = f"{shared_folder(g.spark)}/mail-{uuid.uuid4().hex}"
    nested_messages(g).repartition(4, "message_id").write.json(f"{folder}/in")
    store = M.mail_store(g.spark, f"{folder}/store")
    stream = M.read_messages(g.spark, f"{folder}/in", 2, M.MIME_MESSAGE)
    config = MailboxConfig(subject_keywords=CONFIG.subject_keywords)
    M.start_mail_ingest(stream, store, lambda: g.sources, lambda: g.workspaces, f"{folder}/state", config).awaitTermination()
    row = lambda kind, df, detail, key="id": df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "workspace_id", detail.alias("detail"))
    inbox = store.read("inbox_messages")
    blobs = store.read("blobs").join(inbox.select("id", "file_storage_key"), "file_storage_key").withColumn("workspace_id", F.lit(None).cast("string"))
    return (
        row("inbox", inbox, F.col("file_size_bytes").cast("string"))
        .unionByName(row("invoice", store.read("invoices"), F.col("inbox_message_id")))
        .unionByName(row("job", store.read("jobs"), F.col("inbox_message_id")))
        .unionByName(row("event", store.read("events"), F.col("actor_user_id")))
        .unionByName(row("blob", blobs, F.sha2("data", 256)))
    )


@query(
    "r07_poll_stats",
    """SELECT source_id, scanned, ingested, parts - ingested AS skipped FROM
    (SELECT p.source_id, count(DISTINCT p.message_id) AS scanned, count(*) FILTER (j.verdict <> 'abandon') AS parts
     FROM polled p LEFT JOIN judged j USING (conv_id) GROUP BY 1)
    JOIN (SELECT source_id, count(*) FILTER (rn = 1) AS ingested FROM taken GROUP BY 1) USING (source_id)""",
    SRC, POLLED,
)
def _(g):
    chosen = polled(g)
    judged = M.judge_parts(chosen, CONFIG)
    fresh = M.new_attachments(M.to_uploads(judged), g.inbox_messages).withColumn("was_duplicate", F.lit(False))
    return M.poll_stats(chosen, judged, fresh)


@query(
    "r08_disconnected_sources",
    """SELECT id, CASE WHEN id IN (SELECT source_id FROM message WHERE subject = 'report') THEN 'disconnected'
    ELSE status END AS status FROM sources""", SRC, PARTS,
)
def _(g):
    revoked = M.with_headers(messages(g)).where("subject = 'report'").select("source_id")
    return M.disconnect_sources(g.sources, revoked).select("id", "status")


@query("r09_message_headers", "SELECT message_id, 's@' || source_id AS sender, subject FROM message", (), PARTS)
def _(g):
    return M.with_headers(messages(g)).select("message_id", "sender", "subject")


def keyed(g):
    return g.audit_events.select(F.col("actor_user_id").alias("key"), "event_id", "ts")


# Units: a token is 1000 * 86400 of them, a millisecond refills 3.
THROTTLED = """keyed AS MATERIALIZED (SELECT actor_user_id AS key, event_id, ts,
    row_number() OVER (PARTITION BY actor_user_id ORDER BY ts, event_id) AS n FROM audit_events),
bucket AS (/* recursive */ SELECT key, event_id, ts, n, 259200000 AS before FROM keyed WHERE n = 1
  UNION ALL SELECT k.key, k.event_id, k.ts, k.n,
    least(259200000, b.before - CASE WHEN b.before >= 86400000 THEN 86400000 ELSE 0 END + (k.ts - b.ts) * 3)
  FROM bucket b JOIN keyed k ON k.key = b.key AND k.n = b.n + 1)"""


@query(
    "r10_throttle_verdicts",
    """SELECT key, event_id, ts, before >= 86400000 AS allowed,
    CASE WHEN before < 86400000 THEN greatest(1, (86400000 - before) // 3000) END AS retry_after FROM bucket""",
    ("audit_events",), THROTTLED,
)
def _(g):
    return A.throttle_verdicts(keyed(g), 3, 86_400)


HOURLY = """SELECT (ts // 3600000) * 3600000 AS hour_ms, action, count(*) AS events FROM audit_events GROUP BY 1, 2"""


@query("r11_hourly_rollup", HOURLY, ("audit_events",))
def _(g):
    return S.hourly_rollup(g.audit_events)


@query(
    "r11_hourly_rollup_stream",
    f"SELECT * FROM ({HOURLY}) WHERE hour_ms + 7200000 <= (SELECT max(ts) FROM audit_events)", ("audit_events",),
)
def _(g):
    """The same rollup as a stream: hours the watermark has closed."""
    folder = f"{shared_folder(g.spark)}/rollup-{uuid.uuid4().hex}"
    g.audit_events.select("action", "ts").write.parquet(f"{folder}/in")
    stream = g.spark.readStream.schema("action string, ts bigint").parquet(f"{folder}/in")
    job = (
        S.hourly_rollup(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return g.spark.read.schema("hour_ms bigint, action string, events bigint").parquet(f"{folder}/out")


@query("r11_hourly_rollup_stream_whole", HOURLY, ("audit_events",))
def _(g):
    """Every hour as a stream, those still open too."""
    folder = f"{shared_folder(g.spark)}/rollup-{uuid.uuid4().hex}"
    g.audit_events.select("action", "ts").write.parquet(f"{folder}/in")
    stream = g.spark.readStream.schema("action string, ts bigint").option("maxFilesPerTrigger", 16).parquet(f"{folder}/in")
    job = (
        stream.writeStream.foreachBatch(S.rollup_batch(f"{folder}/out"))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return S.stored_rollup(g.spark, f"{folder}/out")
