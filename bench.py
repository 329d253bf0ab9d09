"""Headline queries, timed to a sink that takes every row. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
The positioned lines are derived from the given tables once, before the clock
starts, because the reference's published extraction times start from them too.
"""

from __future__ import annotations

import json
import os
import time

from tallyvine.operators.fields import extract_fields
from tallyvine.operators.items import extract_items
from tallyvine.session import local_session, materialise
from verification import registry
from verification.views import Given

NAMES = [
    "q01_month_totals", "q03_top_vendors", "q04_needs_review", "q05_dashboard", "q06_client_rollup",
    "q08_client_invoices", "q10_inbox_list", "q14_invoice_summaries", "q16_accountant_details",
    "v12_batch_duplicates", "v14_batch_findings", "e03_field_scores", "e10_item_scores",
    "u01_resolved_uploads", "u08_upserted_runs", "a03_lockout_states", "r10_throttle_verdicts",
    "r11_hourly_rollup",
]


def timed(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    times: dict[str, float] = {}
    # The same work every round, on no table: tells a slower machine from slower code. Not in the total.
    fixed = spark.range(0, 300_000_000, 1, int(cpus)).selectExpr("sum(hash(id, id % 1000)) AS s", "count(DISTINCT id % 100000) AS n")
    timed(fixed)
    calibration = timed(fixed)
    timed(registry.QUERIES["q01_month_totals"](spark, sf_dir))  # warm-up
    for name in NAMES:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    lines = materialise(Given(spark, sf_dir).ocr_line, "bench-lines")
    documents = Given(spark, sf_dir).orders.count()
    for name, extract in (("x10_fields", extract_fields), ("t08_items", extract_items)):
        start = time.time()
        extract(lines).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spent = times["x10_fields"] + times["t08_items"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "extraction_ms_per_document": round(1000 * spent / documents, 4),
        "extraction_documents": documents, "calibration_sec": calibration,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
