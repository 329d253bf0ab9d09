"""Wipes, pages, months, newest rows and whole runs on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyvine.operators import dashboards, rules
from tallyvine.plans import run
from tallyvine.sources import store
from tests.test_documents import HEADER, page


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_wipe_follows_every_parent_and_leaves_the_rest(spark):
    tables = {
        "workspaces": frame(spark, [("w1", "u1"), ("w2", "u2"), ("w3", "u1")], "id string, owner_user_id string"),
        "users": frame(spark, [("u1",), ("u2",), ("u9",)], "id string"),
        "sources": frame(spark, [("s1", "w1"), ("s2", "w2"), ("s3", None)], "id string, workspace_id string"),
        "inbox_messages": frame(spark, [("m1", "w1"), ("m2", "w2")], "id string, workspace_id string"),
        # i2 lies in another tenant but hangs on a message that goes.
        "invoices": frame(spark, [("i1", "w1", None), ("i2", "w2", "m1"), ("i3", "w2", "m2")], "id string, workspace_id string, inbox_message_id string"),
        "pipeline_runs": frame(spark, [("r1", "i1"), ("r2", "i2"), ("r3", "i3")], "id string, invoice_id string"),
        "validation_findings": frame(spark, [("f3", "i3"), ("f2", "i2")], "id string, invoice_id string"),
        "jobs": frame(spark, [("j1", "m1"), ("j2", "m2"), ("j3", None)], "id string, inbox_message_id string"),
    }
    events = frame(spark, [("e1", "w1", '{"seed":"demo"}'), ("e2", "w2", '{"seed":"other"}'), ("e3", "w1", None), ("e4", None, '{"seed":"demo"}'), ("e5", "w2", "{broken")],
                   "id string, workspace_id string, metadata_json string")
    gone = store.tombstones(tables, store.tagged_tenants(events, "demo"), events, "demo")
    ids = {t: sorted(r.id for r in df.collect()) for t, df in gone.items()}
    assert ids == {"workspaces": ["w1"], "sources": ["s1"], "inbox_messages": ["m1"], "invoices": ["i1", "i2"], "pipeline_runs": ["r1", "r2"],
                   "validation_findings": ["f2"], "jobs": ["j1"], "users": ["u1"], "events": ["e1", "e4"]}
    again = {"invoices": frame(spark, [("i1", "w1", "new"), ("i3", "w2", "changed")], tables["invoices"].schema)}
    left = store.wiped(tables, gone, again)
    assert sorted(map(tuple, left["invoices"].collect())) == [("i1", "w1", "new"), ("i3", "w2", "changed")]
    assert sorted(r.id for r in left["jobs"].collect()) == ["j2", "j3"]
    nothing = store.tombstones(tables, store.tagged_tenants(events, "nobody"), events, "nobody")
    assert all(df.isEmpty() for df in nothing.values())


def test_foreign_store_in_many_splits(spark, tmp_path):
    rng, want = random.Random(1), {}
    with open(tmp_path / "s.jsonl", "w") as out:
        for i in range(4_000):
            key, value = f"k{rng.randint(0, 300)}", {"n": i, "t": "é" * rng.randint(0, 9)}
            if rng.random() < 0.05:
                out.write("{broken\n")
                continue
            out.write(json.dumps({"id": key, "data": value}, ensure_ascii=False) + "\n")
            want[key] = value
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = store.numbered_lines(spark, str(tmp_path / "s.jsonl"))
        assert lines.select("block").distinct().count() > 5
        assert {r.id: json.loads(r.data) for r in store.read_foreign_store(spark, str(tmp_path / "s.jsonl")).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_deep_pages_read_only_their_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [("big" if rng.random() < 0.6 else f"t{rng.randint(0, 5)}", f"id{i:05d}", rng.randint(0, 400)) for i in range(3_000)] + [(None, "x", 1)]
    df = frame(spark, rows, "tenant string, id string, at bigint")
    dashboards.write_pages(df, str(tmp_path / "p"), "tenant", "at", "id", 200)
    for one, limit, offset in ((None, 7, 0), (None, 30, 150), ("big", 25, 1_400), ("big", 5, 10_000), ("nobody", 5, 0)):
        got = dashboards.read_page(spark, str(tmp_path / "p"), "tenant", "at", "id", limit, offset, one)
        want = set()
        for tenant in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == tenant), key=lambda r: (-r[2], r[1]))[offset : offset + limit]
            want |= {(*r, offset + i + 1) for i, r in enumerate(own)} if one in (None, tenant) else set()
        assert {(r.tenant, r.id, r["at"], r["rank"]) for r in got.collect()} == want
    directory = spark.read.parquet(str(tmp_path / "p" / "directory"))
    assert directory.where("tenant = 'big'").count() > 5
    deep = dashboards.read_page(spark, str(tmp_path / "p"), "tenant", "at", "id", 25, 1_400, "big")
    assert "page_range" in deep._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_short_ranges_share_a_stored_block(spark, tmp_path):
    """Tasks and files follow the rows, not how short the ranges are; ranges hold as many rows as asked for."""
    df = frame(spark, [("t", f"id{i:05d}", i % 50) for i in range(2_000)], "tenant string, id string, at bigint")
    dashboards.write_pages(df, str(tmp_path / "p"), "tenant", "at", "id", 20)
    assert len([x for x in (tmp_path / "p" / "rows").iterdir() if "=" in x.name]) == 1
    directory = spark.read.parquet(str(tmp_path / "p" / "directory"))
    assert sorted((r["first"], r["n"]) for r in directory.collect()) == [(i * 20, 20) for i in range(100)]


MONTH = 31 * 86_400_000


def test_months_are_replaced_by_their_batches(spark, tmp_path):
    schema = "id string, workspace_id string, vendor_name string, total_amount_minor bigint, status string, created_at bigint"
    invoices = frame(spark, [(f"i{k}", f"w{k % 3}", f"v{k % 4}", 100 * k, "approved", (k % 5) * MONTH) for k in range(60)], schema)
    findings = frame(spark, [(f"w{k % 3}", f"i{k}", "FAIL" if k % 7 == 0 else "PASS") for k in range(60)], "workspace_id string, invoice_id string, outcome string")
    path = str(tmp_path / "m")
    dashboards.refresh_months(invoices, findings, path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "m" / "tiles").rglob("*.parquet")}
    new = frame(spark, [("i99", "w1", "v9", 5_000, "pending", 2 * MONTH + 5)], schema)
    after = invoices.unionByName(new)
    dashboards.refresh_months(after, findings, path, dashboards.changed_months(new))
    key = lambda df: sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    for name, rows in (("tiles", dashboards.monthly_totals(after, findings)), ("vendors", dashboards.top_vendors(after, 5))):
        assert key(dashboards.stored_months(spark, path, name).select(*rows.columns)) == key(rows)
    kept = [f for f in (tmp_path / "m" / "tiles").rglob("*.parquet") if files.get(f) == f.stat().st_mtime_ns]
    assert len(kept) == len(files) - 1 or len(kept) >= 4
    one = dashboards.stored_months(spark, path, "tiles", MONTH, 2 * MONTH + 1, "w1")
    assert "PartitionFilters: [isnotnull(month_ms" in one._jdf.queryExecution().executedPlan().toString()
    touched = dashboards.changed_months(new.limit(0), frame(spark, [("w0", "i0", "FAIL")], findings.schema), invoices).collect()
    assert len(touched) == 1
    dashboards.refresh_months(after, findings, path, dashboards.changed_months(new.limit(0)))


def test_newest_rows_come_whole(spark):
    rows = [("a", 1, 5, "x" * 500), ("a", 2, 5, "y"), ("a", 3, None, "z"), ("b", 4, None, None), (None, 5, 1, "n"), (None, 6, 0, "o")]
    df = frame(spark, rows, "k string, id bigint, at bigint, text string")
    newest = dashboards.latest_per_key(df, ["k"], ["at", "id"])
    assert {tuple(r) for r in newest.collect()} == {("a", 2, 5, "y"), ("b", 4, None, None), (None, 5, 1, "n")}
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert newest.columns == ["k", "id", "at", "text"] and "max(struct" in plan


@pytest.fixture(scope="module")
def finished(spark):
    """Four due jobs on two readable invoices, one locked file, one without message, one without invoice, one not due."""
    lines = page(spark, {"i1": HEADER, "i2": [("nothing to see", 1, 1, 50, 9)], "i7": HEADER})
    job = "id string, workspace_id string, inbox_message_id string, invoice_id string, state string, attempts int, next_run_at bigint, started_at bigint, finished_at bigint, error_message string"
    row = lambda i, m, inv, state="queued", at=1: (i, "w", m, inv, state, 0, at, None, None, "old")
    jobs = frame(spark, [row("j1", "m1", "i1"), row("j2", "m2", "i2"), row("j3", "m3", "i3"), row("j4", "gone", "i4"), row("j5", "m5", None),
                         row("j6", "m1", "i1"), row("j7", "m7", "i7", "queued", 99), row("j8", "m8", "i8", "done"), row("j9", "m9", "i9")], job)
    inbox = frame(spark, [(m, "w", "queued", None) for m in ("m1", "m2", "m3", "m5", "m7", "m8", "m9")], "id string, workspace_id string, status string, ignored_reason string")
    bad = frame(spark, [("m3", "pdf_password_protected"), ("m3", "z"), ("m5", "unsupported_file")], "inbox_message_id string, reason string")
    return jobs, inbox, run.run_due(jobs, inbox, bad, lines, 50)


def test_run_finishes_what_it_can_and_says_what_it_cannot(spark, finished):
    jobs, inbox, changes = finished
    done = {r.id: (r.state, r.attempts, r.error_message) for r in changes.tables["jobs"].collect()}
    assert done == {
        "j1": ("done", 1, None), "j2": ("done", 1, None), "j6": ("done", 1, None), "j9": ("done", 1, None),
        "j3": ("failed", 1, "PDF is password-protected"), "j4": ("failed", 1, run.NO_MESSAGE), "j5": ("failed", 1, run.NO_INVOICE),
    }
    messages = {r.id: (r.status, r.ignored_reason) for r in changes.tables["inbox_messages"].collect()}
    assert messages == {"m1": ("extracted", None), "m2": ("extracted", None), "m9": ("extracted", None), "m3": ("failed", "pdf_password_protected")}
    runs = {r.invoice_id: r for r in changes.tables["pipeline_runs"].collect()}
    assert set(runs) == {"i1", "i2", "i9"}  # each once; i9 has no line at all
    assert json.loads(runs["i1"].extraction_result_json)["fields"]["invoice_no"]["value"] == "97159829"
    found = changes.tables["validation_findings"].groupBy("invoice_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "NOT_APPLICABLE").alias("na")).collect()
    assert {r.invoice_id: r.n for r in found} == {"i1": 6, "i2": 6, "i9": 6} and all(r.na == 6 for r in found if r.invoice_id != "i1")
    status = {r.id: r.status for r in changes.tables["invoices"].collect()}
    fails = {r.invoice_id: r.fail_count for r in changes.summary.collect()}
    assert status == {k: "flagged" if v else "under_review" for k, v in fails.items()} and status["i9"] == "under_review"


def test_a_run_done_again_changes_nothing(spark, finished):
    jobs, inbox, changes = finished
    tables = {
        "jobs": jobs, "inbox_messages": inbox,
        "invoices": frame(spark, [("i1", "w", "kept?", 7, "pending"), ("i2", "w", "kept", 8, "pending"), ("i8", "w", "other", 9, "approved")],
                          "id string, workspace_id string, vendor_name string, total_amount_minor bigint, status string"),
        "validation_findings": changes.tables["validation_findings"].limit(0).unionByName(
            changes.tables["validation_findings"].where("invoice_id = 'i1'").limit(1).withColumns({"id": F.lit("stale")})),
        "pipeline_runs": changes.tables["pipeline_runs"].limit(0),
    }
    narrow = run.RunChanges(changes.tables | {"invoices": changes.tables["invoices"].select("id", "vendor_name", "total_amount_minor", "status")}, changes.summary)
    once = run.applied(narrow, tables)
    twice = run.applied(narrow, {t: spark.createDataFrame(df.collect(), df.schema) for t, df in once.items()})
    rows = lambda df: sorted(map(str, df.collect()))
    assert all(rows(once[t]) == rows(twice[t]) for t in tables)
    bills = {r.id: r for r in once["invoices"].collect()}
    assert bills["i2"].vendor_name == "kept" and bills["i2"].status == "under_review" and bills["i8"].status == "approved"
    assert "stale" not in {r.id for r in once["validation_findings"].collect()} and once["pipeline_runs"].count() == 3
    after = {r.id: (r.state, r.error_message) for r in once["jobs"].collect()}
    assert after["j1"] == ("done", None) and after["j7"] == ("queued", "old") and after["j8"] == ("done", "old")
    # Invoices whose run is stored are not run again.
    planned = run.plan_jobs(jobs, inbox, spark.createDataFrame([], "inbox_message_id string, reason string"), 50)
    assert {r.doc_id for r in run.documents_to_run(planned, spark.createDataFrame([("i1",)], "id string")).collect()} == {"i2", "i3", "i9"}


def test_amounts_are_compared_at_one_scale(spark):
    rows = [("2", "3,5", "7,00"), ("2", "3,5", "8,01"), ("1", "100", "101,0000"), ("1", "100", "101,0001"), ("9" * 30, "9" * 30, "1"), ("1", "1", "9" * 36 + ",99"), ("x", "1", "1")]
    items = frame(spark, [("d", i, None, q, p, n, None, None) for i, (q, p, n) in enumerate(rows)],
                  "doc_id string, item_index int, item_desc string, item_qty string, item_net_price string, item_net_worth string, item_vat string, item_gross_worth string")
    got = {r.target: (r.outcome, r.reason) for r in rules.item_findings(items).where("rule_name = 'item_net_worth_consistency'").collect()}
    assert [got[f"item[{i}].net_worth"][0] for i in range(len(rows))] == ["pass", "fail", "pass", "fail", "not_applicable", "not_applicable", "not_applicable"]
    assert got["item[4].net_worth"][1] == rules.BEYOND and got["item[5].net_worth"][1] == rules.BEYOND


def test_findings_are_worked_out_before_the_generator(spark):
    header = spark.createDataFrame([("d", "123456", "1/2/2024", "123-45-6789", None, "x")], "doc_id string, invoice_no string, invoice_date string, seller_tax_id string, client_tax_id string, iban string")
    items = spark.createDataFrame([("d", 0, "2,00", "3,00", "6,00", "10%", "6,60")], "doc_id string, item_index int, item_qty string, item_net_price string, item_net_worth string, item_vat string, item_gross_worth string")
    for found, n in ((rules.header_findings(header), 6), (rules.item_findings(items), 2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        generator = next(line for line in plan.splitlines() if "Generate " in line)
        assert "CASE WHEN" not in generator and found.count() == n
