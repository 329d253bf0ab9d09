"""Lockouts and throttling against plain loops; stores, files, CSV and streams."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyvine.operators import audit
from tallyvine.operators.dashboards import corpus_list
from tallyvine.session import shared_folder
from tallyvine.sources import csv_export, runs, seed, store
from tallyvine.sources.config import MailboxConfig
from tallyvine.streaming import audit_stream, mailbox


def throttle_loop(events, capacity, per_seconds):
    rate, out, buckets = capacity / per_seconds, {}, {}
    for key, event, ts in sorted(events, key=lambda e: (e[2], e[1])):
        tokens, last = buckets.get(key, (float(capacity), ts))
        tokens = min(float(capacity), tokens + (ts - last) / 1000.0 * rate)
        ok = tokens >= 1.0
        out[event] = (ok, None if ok else int(max(1.0, (1.0 - tokens) / rate)))
        buckets[key] = (tokens - 1.0 if ok else tokens, ts)
    return out


def sample_events(n=600):
    rng = random.Random(3)
    # One key holds a third of all rows and spans many slices.
    return [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 400_000)) for i in range(n)]


def test_throttle_equals_loop(spark):
    events = sample_events()
    df = spark.createDataFrame(events, "key string, event_id bigint, ts bigint")
    for capacity, per in ((3, 10), (1, 1), (5, 60)):
        got = {r.event_id: (r.allowed, r.retry_after) for r in audit.throttle_verdicts(df, capacity, per, 5_000).collect()}
        assert got == throttle_loop(events, capacity, per)


def test_lockout_equals_loop(spark):
    rng = random.Random(5)
    logins = [(f"l{i:04d}", "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 5)}", rng.randint(0, 1_000_000), rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(logins, "login_id string, user_id string, ts bigint, success boolean")
    want, counts = {}, {}
    for login, user, ts, success in sorted(logins, key=lambda x: (x[2], x[0])):
        counts[user] = 0 if success else counts.get(user, 0) + 1
        want[login] = (counts[user], ts + 900 if not success and counts[user] >= 3 else None)
    for slice_ms in (1_000, 50_000, 10**9):
        states = audit.lockout_states(df, 3, 900, slice_ms)
        assert {r.login_id: (r.failed_login_count, r.locked_until) for r in states.collect()} == want


def test_store_replay(spark, tmp_path):
    lines = ['{"id":"a","data":{"n":1}}', "", "{broken", '{"data":{"n":2}}', '{"id":"b","data":{"n":3}}', '{"id":"a","data":{"n":4}}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    got = {r.id: json.loads(r.data) for r in store.read_foreign_store(spark, str(tmp_path / "s.jsonl")).collect()}
    assert got == {"a": {"n": 4}, "b": {"n": 3}}
    own = str(tmp_path / "own")
    frame = lambda rows: spark.createDataFrame(rows, "id string, data string")
    store.append_store(frame([("a", '{"n":1}'), ("b", '{"n":2}')]), own, 1)
    store.append_store(frame([("a", '{"n":9}')]), own, 2)
    assert {r.id: r.data for r in store.read_store(spark, own).collect()} == {"a": '{"n":9}', "b": '{"n":2}'}


def test_file_listing(spark, tmp_path):
    (tmp_path / "blobs" / "ws" / "ab").mkdir(parents=True)
    (tmp_path / "blobs" / "ws" / "ab" / "x.pdf").write_bytes(b"%PDF-1")
    rows = store.list_files(spark, str(tmp_path / "blobs"), str(tmp_path / "blobs")).collect()
    assert [(r.file_storage_key, r.length) for r in rows] == [("ws/ab/x.pdf", 6)]


def test_csv(spark, tmp_path):
    names = ", ".join(f"{c} string" for c in csv_export.HEADER_COLUMNS)
    header = spark.createDataFrame([("a", "1", None, 'x "q", y', " pad ", None, None, None), ("b",) + (None,) * 7], f"doc_id string, {names}")
    items = spark.createDataFrame([("a", 0, "d", "1,00", None, None, None, None)],
                                  "doc_id string, item_index int, " + ", ".join(f"{c} string" for c in csv_export.ITEM_FIELDS))
    csv_export.write_csv(csv_export.csv_rows(header, items), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    lines = [line for line in text.splitlines() if not line.startswith("invoice_no,")]
    assert lines == ['1,,"x ""q"", y", pad ,,,,0,d,"1,00",,,,', ",,,,,,,,,,,,,"]


def test_seed(spark):
    shops, bills = seed.demo_workspaces(spark, "t"), seed.demo_invoices(spark, "t", 2024, 1)
    assert shops.count() == 5 and shops.where("ca_gstin is null").count() == 1
    per = bills.groupBy("workspace_id").agg(F.count("*").alias("n"), F.count_if("failing").alias("bad")).collect()
    assert len(per) == 4 and all(5 <= r.n <= 7 and 1 <= r.bad <= 2 for r in per)


def test_corpus_order(spark):
    docs = spark.createDataFrame([("a", "test", 0), ("b", "test", 1), ("c", "test", 2)], "doc_id string, split string, index int")
    done = spark.createDataFrame([("c",)], "doc_id string")
    assert [r.doc_id for r in corpus_list(docs, done).collect()] == ["c", "a", "b"]


def message(source, number, ts, texts, subject="Invoice", folder=None):
    data = lambda t: base64.urlsafe_b64encode(b"%PDF-" + t.encode()).decode()
    return {"source_id": source, "message_id": number, "received_at": ts, "folder": folder,
            "headers": [{"value": "nameless"}, {"name": "Subject", "value": subject}, {"name": "From", "value": "a@b"}],
            "parts": [{"filename": f"f{i}.pdf", "mimeType": "application/pdf", "attachmentId": f"t{i}", "data": data(t)} for i, t in enumerate(texts)]}


def test_mailbox_stream_keeps_first_arrival_over_all_time(spark, tmp_path):
    feed, inbox = tmp_path / "feed", str(tmp_path / "inbox")
    feed.mkdir()
    sources = spark.createDataFrame([("s1", "w1", "gmail", "connected", None), ("s2", "w2", "gmail", "disconnected", None)],
                                    "id string, workspace_id string, kind string, status string, last_polled_at bigint")
    shops = spark.createDataFrame([("w1", "u1"), ("w2", "u2")], "id string, owner_user_id string")

    def run(name, messages):
        (feed / name).write_text("\n".join(json.dumps(m) for m in messages))
        stream = mailbox.attachment_stream(mailbox.read_messages(spark, str(feed)), sources, shops, MailboxConfig())
        mailbox.start_ingest(stream, inbox, str(tmp_path / "state")).awaitTermination()

    run("1.json", [message("s1", "m1", 1704067200000, ["one", "two", "one"]), message("s2", "m2", 1704067200000, ["three"]),
                   message("s1", "m3", 1704067201000, ["four"], "holiday pictures")])
    assert spark.read.parquet(inbox).count() == 2
    month = 30 * 86_400_000
    run("2.json", [message("s1", "m4", 1704067200000 + month, ["one", "five"])])
    rows = spark.read.parquet(inbox).collect()
    assert len(rows) == 3 and len({r.file_sha256 for r in rows}) == 3
    assert {r.external_id for r in rows} == {"gmail:m1:t0", "gmail:m1:t1", "gmail:m4:t1"}


def test_mailbox_stream_takes_messages_however_late(spark, tmp_path):
    feed, inbox = tmp_path / "feed", str(tmp_path / "inbox")
    feed.mkdir()
    sources = spark.createDataFrame([(f"s{i}", f"w{i}", "gmail", "connected", None) for i in (1, 2)],
                                    "id string, workspace_id string, kind string, status string, last_polled_at bigint")
    shops = spark.createDataFrame([("w1", "u1"), ("w2", "u2")], "id string, owner_user_id string")
    now, days = 1704067200000, 5 * 86_400_000
    for name, m in (("1.json", message("s1", "m1", now, ["one"])), ("2.json", message("s2", "m2", now - days, ["two"])),
                    ("3.json", message("s2", "m3", now, ["three"], folder="SPAM")), ("4.json", message("s2", "m4", now, ["two"]))):
        (feed / name).write_text(json.dumps(m))
        stream = mailbox.attachment_stream(mailbox.read_messages(spark, str(feed)), sources, shops, MailboxConfig())
        mailbox.start_ingest(stream, inbox, str(tmp_path / "state")).awaitTermination()
    assert {r.external_id for r in spark.read.parquet(inbox).collect()} == {"gmail:m1:t0", "gmail:m2:t0"}


def test_capped_polls_read_everything_in_the_end(spark):
    rows = [("s", f"m{i}", 1000 * (i // 3) + i % 3) for i in range(20)]
    messages = spark.createDataFrame(rows, "source_id string, message_id string, received_at bigint")
    sources = spark.createDataFrame([("s", "w", "connected", 1)], "id string, workspace_id string, status string, last_polled_at bigint")
    config, seen = MailboxConfig(max_messages_per_poll=2), []
    for _ in range(20):
        new = mailbox.new_since_cursor(messages, sources, config, 10**6)
        taken = mailbox.cap_messages(new, config)
        seen += [r.message_id for r in taken.collect()]
        sources = spark.createDataFrame(mailbox.advance_cursors(sources, new, 10**6, taken).collect(), sources.schema)
    assert sorted(seen) == sorted(r[1] for r in rows)


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Context:
        master = "local-cluster[3,2,3000]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_throttle_stream_equals_batch(spark, tmp_path):
    events = sorted(sample_events(200), key=lambda e: e[2])
    feed = tmp_path / "events"
    df = spark.createDataFrame(events, "key string, event_id bigint, ts bigint")
    df.coalesce(1).write.parquet(str(feed))
    stream = spark.readStream.schema(df.schema).parquet(str(feed))
    verdicts = audit_stream.throttle_stream(stream, 3, 10)
    job = (verdicts.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    job.awaitTermination()
    got = {r.event_id: (r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == throttle_loop(events, 3, 10)


def test_throttle_stream_gives_late_events_a_verdict(spark, tmp_path):
    feed, state, out = tmp_path / "events", str(tmp_path / "state"), str(tmp_path / "out")
    schema = "key string, event_id bigint, ts bigint"
    for rows in ([("a", 1, 1_000_000)], [("b", 2, 9_000_000)], [("a", 3, 900_000), ("a", 4, 1_000_500)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        verdicts = audit_stream.throttle_stream(spark.readStream.schema(schema).parquet(str(feed)), 2, 10)
        (verdicts.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", state).trigger(availableNow=True).start()).awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_rollup_stream_gives_open_hours_and_counts_late_events(spark, tmp_path):
    feed, state, out = tmp_path / "events", str(tmp_path / "state"), str(tmp_path / "out")
    hour, schema = 3_600_000, "action string, ts bigint"
    for rows in ([("a", 0), ("a", 1)], [("a", 9 * hour), ("b", 9 * hour + 5)], [("a", 2), ("b", 8 * hour)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema(schema).parquet(str(feed))
        (stream.writeStream.foreachBatch(audit_stream.rollup_batch(out))
         .option("checkpointLocation", state).trigger(availableNow=True).start()).awaitTermination()
    audit_stream.rollup_batch(out)(spark.createDataFrame([("a", 2), ("b", 8 * hour)], schema), 2)  # a batch done again
    got = {(r.hour_ms, r.action): r.events for r in audit_stream.stored_rollup(spark, out).collect()}
    assert got == {(0, "a"): 3, (9 * hour, "a"): 1, (9 * hour, "b"): 1, (8 * hour, "b"): 1}


def exact_throttle_loop(events, capacity, per_seconds, buckets=None):
    """In whole numbers; an event older than its bucket refills nothing."""
    one, out, buckets = 1000 * per_seconds, {}, dict(buckets or {})
    for key, event, ts in sorted(events, key=lambda e: (e[2], e[1])):
        tokens, last = buckets.get(key, (capacity * one, ts))
        at = max(ts, last)
        tokens = min(capacity * one, tokens + (at - last) * capacity)
        ok = tokens >= one
        out[event] = (ok, None if ok else max(1, (one - tokens) // (capacity * 1000)))
        buckets[key] = (tokens - one if ok else tokens, at)
    return out, buckets


@pytest.mark.parametrize(("n", "keys", "capacity", "per", "rows"), [(600, 3, 3, 10, 37), (300, 1, 1, 1, 7), (400, 200, 2, 30, 11), (500, 2, 7, 5, 499)])
def test_throttle_parts_compose_to_the_loop(spark, n, keys, capacity, per, rows):
    """One key fills many parts; a second batch goes on with the stored buckets, some of its events late."""
    rng = random.Random(n)
    events = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, keys)}", i, rng.randint(0, 200_000)) for i in range(n)]
    df = spark.createDataFrame(events, "key string, event_id bigint, ts bigint")
    walked = audit.throttle_walk(df, capacity, per, rows_per_task=rows)
    want, buckets = exact_throttle_loop(events, capacity, per)
    assert {r.event_id: (r.allowed, r.retry_after) for r in walked.collect()} == want
    later = [(k, i + n, ts + rng.randint(-50_000, 150_000)) for k, i, ts in events]
    states = spark.createDataFrame([(k, t, a) for k, (t, a) in buckets.items()], "key string, tokens bigint, at bigint")
    got = audit.throttle_walk(spark.createDataFrame(later, df.schema), capacity, per, states, rows).collect()
    assert {r.event_id: (r.allowed, r.retry_after) for r in got} == exact_throttle_loop(later, capacity, per, buckets)[0]
    assert audit.throttle_verdicts(df.limit(0), capacity, per).collect() == []


def test_transfer_maps_stay_small(spark):
    bucket, transfer, rng = audit._Bucket(5, 60), audit._Transfer(), random.Random(1)
    gaps = [rng.choice([0, 0, 1, 500, 7_000, 20_000]) for _ in range(3_000)]
    for gap in gaps:
        transfer.after(bucket, gap)
        assert len(transfer.pieces) <= 2 * 5 + 3
    for start in (0, 1, bucket.one, 3 * bucket.one - 1, bucket.full):
        tokens = start
        for gap in gaps:
            tokens = bucket.refilled(tokens, gap)
            tokens -= bucket.one if tokens >= bucket.one else 0
        assert transfer(start) == tokens


def mime_tree(rng, depth):
    node = {"filename": rng.choice(["", "a.pdf", None]), "mimeType": rng.choice(["application/pdf", "text/plain"]),
            "body": {"attachmentId": rng.choice([None, f"x{rng.randint(0, 99)}"]), "data": "[["}}
    if depth and rng.random() < 0.8:
        node["parts"] = [mime_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return node


def walked(node, path=()):
    yield list(path), node.get("filename"), node.get("mimeType"), node["body"].get("attachmentId")
    for i, child in enumerate(node.get("parts", [])):
        yield from walked(child, (*path, i))


def test_mime_trees_of_any_depth(spark):
    rng = random.Random(2)
    trees = [mime_tree(rng, rng.randint(0, 7)) for _ in range(100)]
    deep = node = {"body": {}}
    for i in range(60):
        node["parts"] = [{"filename": f"f{i}", "mimeType": "m", "body": {"attachmentId": "a"}}]
        node = node["parts"][0]
    trees.append(deep)
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(-1, "{broken"), (-2, None), (-3, "")]
    got = {r.i: r.parts for r in mailbox.from_mime(spark.createDataFrame(rows, "i long, payload string")).collect()}
    for i, t in enumerate(trees):
        assert [(list(p.path), p.filename, p.mimeType, p.attachmentId) for p in got[i]] == list(walked(t))
    assert got[-1] is None and got[-2] is None and got[-3] is None


def forwarded(source, number, ts, text, depth):
    """A mail whose bill lies so many levels down, beside an inline part without a name."""
    bill = {"filename": "bill.pdf", "mimeType": "application/pdf", "body": {"attachmentId": "t", "data": base64.urlsafe_b64encode(b"%PDF-" + text.encode()).decode()}}
    for _ in range(depth):
        bill = {"mimeType": "message/rfc822", "parts": [{"mimeType": "text/plain", "body": {"data": "aGk="}}, bill]}
    headers = [{"name": "Subject", "value": "Invoice"}, {"name": "From", "value": "a@b"}]
    return {"source_id": source, "message_id": number, "received_at": ts, "payload": {"headers": headers, "parts": [bill]}}


def mail_tables(store):
    return {t: sorted(r.id for r in store.read(t).collect()) for t in ("inbox_messages", "invoices", "jobs", "events")}


def test_mail_ingest_commits_all_tables_together(spark, tmp_path, monkeypatch):
    feed, state = tmp_path / "feed", str(tmp_path / "state")
    feed.mkdir()
    sources = spark.createDataFrame([("s1", "w1", "gmail", "connected", None)], "id string, workspace_id string, kind string, status string, last_polled_at bigint")
    shops = spark.createDataFrame([("w1", "u1")], "id string, owner_user_id string")
    store = mailbox.mail_store(spark, str(tmp_path / "store"))

    def run(name, messages):
        (feed / name).write_text("\n".join(json.dumps(m) for m in messages))
        stream = mailbox.read_messages(spark, str(feed), schema=mailbox.MIME_MESSAGE)
        mailbox.start_mail_ingest(stream, store, lambda: sources, lambda: shops, state, MailboxConfig()).awaitTermination()

    now = 1704067200000
    run("1.json", [forwarded("s1", "m1", now, "one", 2), forwarded("s1", "m2", now + 1, "one", 0), forwarded("s1", "m3", now + 2, "two", 5)])
    first = mail_tables(store)
    assert [len(v) for v in first.values()] == [2, 2, 3, 2]
    row = store.read("inbox_messages").where("external_id = 'gmail:m1:t'").first()
    assert (row.sender, row.subject, row.source_id, row.status) == ("a@b", "Invoice", "s1", "queued")
    assert {bytes(r.data) for r in store.read("blobs").collect()} == {b"%PDF-one", b"%PDF-two"}
    assert {r.file_storage_key for r in store.read("blobs").collect()} == {r.file_storage_key for r in store.read("inbox_messages").collect()}
    stats = store.read("poll_stats").first()
    assert (stats.scanned, stats.ingested, stats.skipped) == (3, 2, 1)

    # Killed before the manifest: nothing of the batch is seen.
    monkeypatch.setattr(type(store), "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        run("2.json", [forwarded("s1", "m4", now + 3, "one", 1), forwarded("s1", "m5", now + 4, "three", 1)])
    assert mail_tables(store) == first
    monkeypatch.undo()
    # Done again by the restarted stream: the repeat adds a job, the new bill one row to each table.
    run("2.json", [forwarded("s1", "m4", now + 3, "one", 1), forwarded("s1", "m5", now + 4, "three", 1)])
    second = mail_tables(store)
    assert [len(v) for v in second.values()] == [3, 3, 5, 3]
    assert all(set(first[t]) <= set(second[t]) and len(set(second[t])) == len(second[t]) for t in first)
    # A batch that is done once more replaces itself.
    batch = spark.createDataFrame([(m["source_id"], m["message_id"], m["received_at"], None, json.dumps(m["payload"])) for m in
                                   [forwarded("s1", "m4", now + 3, "one", 1), forwarded("s1", "m5", now + 4, "three", 1)]], mailbox.MIME_MESSAGE)
    mailbox.ingest_messages(store, lambda: sources, lambda: shops, MailboxConfig())(batch, store.batches()[-1])
    assert mail_tables(store) == second


def scanned_rows(df):
    """Rows that the scans of a collected frame gave out."""
    def scans(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(plan.plan())
        own = [plan.metrics().get("numOutputRows").get().value()] if name == "FileSourceScanExec" else []
        kids = plan.children()
        return own + [x for i in range(kids.size()) for x in scans(kids.apply(i))]

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_runs_merge_and_lookups_read_what_they_need(spark, tmp_path):
    tables = {"keys": runs.Table("k string, n bigint", ("k",)), "bytes": runs.Table("k string", ("k",), merged=False)}
    store = runs.RunStore(spark, str(tmp_path / "s"), tables)
    per, batches = 2_000, 18
    keyed = lambda b: spark.range(b * per, (b + 1) * per).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("n"))
    for b in range(batches):
        store.commit(b, {"keys": keyed(b), "bytes": keyed(b).select("k").limit(1)})
    files = [f for f in (tmp_path / "s" / "table=keys").rglob("*.parquet")]
    assert store.read("keys").count() == per * batches and len(store.manifest()["keys"]) <= 2 * runs.FAN
    assert len(files) <= 3 * runs.FAN and len(store.manifest()["bytes"]) == batches
    wanted = keyed(3).limit(5).unionByName(spark.createDataFrame([("nobody", 0), (None, 0)], "k string, n bigint"))
    found = store.lookup("keys", wanted)
    keys = {r.k for r in wanted.collect()}
    frame = found.select("k")
    got = [r.k for r in frame.collect()]
    assert len(got) == 5 and set(got) <= keys
    plan = found.select("k")
    plan._jdf.collectToPython()
    assert scanned_rows(plan) < per * batches / 3
    # A batch done again replaces itself; runs of killed attempts go.
    store.commit(batches - 1, {"keys": keyed(batches - 1), "bytes": keyed(0).limit(0).select("k")})
    assert store.read("keys").count() == per * batches and store.read("bytes").count() == batches - 1
    assert store.read("keys", before=batches - 1).count() == per * (batches - 1)
