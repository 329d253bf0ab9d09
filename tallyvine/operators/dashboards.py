"""Dashboard and list queries.

Each query is written for all tenants at once; a single tenant is a filter on
top, which the optimiser moves into the scan. Findings are always reduced to
one row per invoice or tenant before they meet another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvine.functions.messages import failure_message, with_rule_texts
from tallyvine.functions.numbers import itc_estimate
from tallyvine.functions.periods import month_start

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def fail_counts(findings: DataFrame, per_tenant: bool = True) -> DataFrame:
    """FAIL findings per invoice; ``per_tenant`` also matches the tenant."""
    keys = ["workspace_id", "invoice_id"] if per_tenant else ["invoice_id"]
    return (
        findings.where("outcome = 'FAIL'").groupBy(*keys).agg(F.count("*").alias("failing_rules"))
    )


def with_fail_counts(invoices: DataFrame, findings: DataFrame, per_tenant: bool = True) -> DataFrame:
    """Invoices with their number of failing rules (0 when none)."""
    counts = fail_counts(findings, per_tenant).withColumnRenamed("invoice_id", "id")
    keys = ["workspace_id", "id"] if per_tenant else ["id"]
    return invoices.join(counts, keys, "left").withColumn(
        "failing_rules", F.coalesce("failing_rules", _zero())
    )


def invoices_with_failures(invoices: DataFrame, findings: DataFrame) -> DataFrame:
    """Invoices that have at least one failing rule."""
    failing = findings.where("outcome = 'FAIL'").select(
        "workspace_id", F.col("invoice_id").alias("id")
    )
    return invoices.join(failing, ["workspace_id", "id"], "left_semi")


def in_period(df: DataFrame, start_ms: int, end_ms: int, column: str = "created_at") -> DataFrame:
    """Half-open time range; both bounds reach the scan."""
    return df.where((F.col(column) >= start_ms) & (F.col(column) < end_ms))


def for_tenant(df: DataFrame, workspace_id: str, column: str = "workspace_id") -> DataFrame:
    return df.where(F.col(column) == workspace_id)


def _kpi_aggregates() -> list[Column]:
    amount = F.col("total_amount_minor")
    failing = F.col("failing_rules") > 0
    # Which states count as extracted and as pending.
    extracted = F.col("status").isin("approved", "under_review", "flagged")
    pending = F.col("status").isin("pending", "rejected")
    return [
        F.count("*").alias("invoice_count"),
        F.coalesce(F.sum(amount), _zero()).alias("total_spend_minor"),
        F.coalesce(F.sum(F.when(~failing, amount)), _zero()).alias("clean_total_minor"),
        F.count_if(failing).alias("needs_review_count"),
        F.count_if(extracted).alias("extracted_count"),
        F.count_if(pending).alias("pending_count"),
    ]


def _with_itc(totals: DataFrame) -> DataFrame:
    return totals.withColumn(
        "itc_estimate_minor", itc_estimate(F.col("clean_total_minor"))
    ).drop("clean_total_minor")


def monthly_totals(invoices: DataFrame, findings: DataFrame) -> DataFrame:
    """KPI tiles of every tenant and month of upload."""
    return _with_itc(
        with_fail_counts(invoices, findings)
        .groupBy("workspace_id", month_start(F.col("created_at")).alias("month_ms"))
        .agg(*_kpi_aggregates())
    )


def totals_for_period(
    invoices: DataFrame, findings: DataFrame, workspace_id: str, start_ms: int, end_ms: int
) -> DataFrame:
    """KPI tiles of one tenant and period: always exactly one row."""
    scoped = in_period(for_tenant(invoices, workspace_id), start_ms, end_ms)
    return _with_itc(
        with_fail_counts(scoped, for_tenant(findings, workspace_id)).agg(*_kpi_aggregates())
    )


def _top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key. Spark cuts each task's input to the limit
    before the shuffle, so a key with very many rows ships only a few of them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_vendors(invoices: DataFrame, limit: int = 5) -> DataFrame:
    """Largest vendors by spend per tenant and month; unnamed vendors are left out."""
    spend = (
        invoices.where("vendor_name is not null")
        .groupBy("workspace_id", month_start(F.col("created_at")).alias("month_ms"), "vendor_name")
        .agg(
            F.count("*").alias("invoice_count"),
            F.coalesce(F.sum("total_amount_minor"), _zero()).alias("total_minor"),
        )
    )
    order = [F.desc("total_minor"), F.asc("vendor_name")]
    return _top_per_key(spend, ["workspace_id", "month_ms"], order, limit)


def needs_review(invoices: DataFrame, findings: DataFrame, limit: int = 5) -> DataFrame:
    """Newest invoices with a failing rule per tenant, over all months."""
    failing = fail_counts(findings).withColumnRenamed("invoice_id", "id")
    rows = invoices.join(failing, ["workspace_id", "id"]).select(
        "workspace_id", F.col("id").alias("invoice_id"), "vendor_name", "invoice_no",
        "invoice_date", "total_amount_minor", "created_at", "failing_rules",
    )
    order = [F.desc("created_at"), F.asc("invoice_id")]
    return _top_per_key(rows, ["workspace_id"], order, limit)


def dashboard(
    invoices: DataFrame, findings: DataFrame, vendor_limit: int = 5, review_limit: int = 5
) -> DataFrame:
    """One row per tenant and month: tiles, best vendor list and review list as JSON.

    The lists are already cut to their limits, so the collected arrays are small.
    """
    tiles = monthly_totals(invoices, findings)
    vendors = (
        top_vendors(invoices, vendor_limit)
        .groupBy("workspace_id", "month_ms")
        .agg(F.to_json(F.transform(
            F.array_sort(F.collect_list(
                F.struct("rank", "vendor_name", "invoice_count", "total_minor"))),
            lambda v: F.struct(v["vendor_name"].alias("vendor_name"),
                               v["invoice_count"].alias("invoice_count"),
                               v["total_minor"].alias("total_minor")),
        )).alias("top_vendors"))
    )
    review = (
        needs_review(invoices, findings, review_limit)
        .groupBy("workspace_id")
        .agg(F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "invoice_id", "failing_rules"))),
            lambda v: F.struct(v["invoice_id"].alias("invoice_id"),
                               v["failing_rules"].alias("failing_rules")),
        )).alias("needs_review"))
    )
    empty = F.lit("[]")
    return (
        tiles.join(vendors, ["workspace_id", "month_ms"], "left")
        .join(review, "workspace_id", "left")
        .withColumn("top_vendors", F.coalesce("top_vendors", empty))
        .withColumn("needs_review", F.coalesce("needs_review", empty))
    )


def refresh_months(invoices: DataFrame, findings: DataFrame, path: str, months: DataFrame | None = None, vendor_limit: int = 5) -> None:
    """Keep tiles and best vendors by (month, tenant): those of the given ``months(month_ms)`` are computed anew, or all.

    Each month is a partition of its own and is replaced as a whole; the others' files stay.
    ``changed_months`` says which months a batch of changed invoices and findings touches.
    """
    if months is not None:
        starts = [r[0] for r in months.select("month_ms").distinct().collect()]  # a row a month
        if not starts:
            return
        touched = F.lit(False)
        for start in starts:
            touched = touched | ((F.col("created_at") >= start) & (F.col("created_at") < start + 32 * 86_400_000))
        # The range reaches the scan, the exact month decides.
        invoices = invoices.where(touched & month_start(F.col("created_at")).isin(starts))
        findings = findings.join(invoices.select("workspace_id", F.col("id").alias("invoice_id")), ["workspace_id", "invoice_id"], "left_semi")
    for name, rows in (("tiles", monthly_totals(invoices, findings)), ("vendors", top_vendors(invoices, vendor_limit))):
        writer = rows.repartition("month_ms").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("month_ms").parquet(f"{path}/{name}")


def changed_months(invoices: DataFrame, findings: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Months that a batch of invoices touches, and with ``stored`` invoices those that its findings do."""
    months = invoices.select(month_start(F.col("created_at")).alias("month_ms"))
    if findings is not None and stored is not None:
        named = findings.select("workspace_id", F.col("invoice_id").alias("id"))
        months = months.unionByName(stored.join(named, ["workspace_id", "id"], "left_semi").select(month_start(F.col("created_at")).alias("month_ms")))
    return months.distinct()


def stored_months(spark: SparkSession, path: str, name: str, start_ms: int | None = None, end_ms: int | None = None, workspace_id: str | None = None) -> DataFrame:
    """What ``refresh_months`` keeps, ``tiles`` or ``vendors``; a period reads only its months."""
    rows = spark.read.parquet(f"{path}/{name}")
    rows = rows.withColumn("month_ms", F.col("month_ms").cast("bigint")) if dict(rows.dtypes)["month_ms"] != "bigint" else rows
    if start_ms is not None:
        rows = rows.where(F.col("month_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("month_ms") < end_ms)
    return rows if workspace_id is None else for_tenant(rows, workspace_id)


def client_rollup(workspaces: DataFrame, invoices: DataFrame, findings: DataFrame) -> DataFrame:
    """Linked client tenants with invoice and open-flag totals.

    Invoices and flags are counted apart, so neither multiplies the other.
    """
    spend = invoices.groupBy("workspace_id").agg(
        F.count("*").alias("invoice_count"),
        F.coalesce(F.sum("total_amount_minor"), _zero()).alias("total_spend_minor"),
    )
    flags = findings.where("outcome = 'FAIL'").groupBy("workspace_id").agg(
        F.count("*").alias("open_flags")
    )
    linked = workspaces.where("ca_gstin is not null").select(
        "ca_gstin", F.col("id").alias("workspace_id"), "name", "gstin"
    )
    return (
        linked.join(spend, "workspace_id", "left")
        .join(flags, "workspace_id", "left")
        .select(
            "ca_gstin", "workspace_id", "name", "gstin",
            F.coalesce("invoice_count", _zero()).alias("invoice_count"),
            F.coalesce("total_spend_minor", _zero()).alias("total_spend_minor"),
            F.coalesce("open_flags", _zero()).alias("open_flags"),
        )
        .orderBy("ca_gstin", "name")
    )


def authorised_workspaces(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requests ``(ca_gstin, workspace_id)`` whose tenant is linked to that accountant."""
    linked = workspaces.select("ca_gstin", F.col("id").alias("workspace_id"))
    return requests.join(linked, ["ca_gstin", "workspace_id"], "left_semi")


def client_invoices(
    workspaces: DataFrame, invoices: DataFrame, findings: DataFrame,
    ca_gstin: str | None = None, workspace_id: str | None = None,
) -> DataFrame:
    """Invoices of linked clients with failing-rule counts, newest first.

    The link is part of the join, so naming a tenant of somebody else yields
    nothing. The failing rules are counted by invoice only.
    """
    linked = workspaces.where("ca_gstin is not null")
    if ca_gstin is not None:
        linked = linked.where(F.col("ca_gstin") == ca_gstin)
    if workspace_id is not None:
        linked = linked.where(F.col("id") == workspace_id)
    scoped = invoices.join(
        linked.select("ca_gstin", F.col("id").alias("workspace_id")), "workspace_id"
    )
    return with_fail_counts(scoped, findings, per_tenant=False).select(
        "ca_gstin", "workspace_id", F.col("id").alias("invoice_id"), "vendor_name", "invoice_no",
        "invoice_date", "total_amount_minor", "currency", "status", "failing_rules", "created_at",
    )


#: Rows of one range of a paged list, and least rows of one stored block of ranges.
PAGE_RANGE = 200_000


def write_pages(df: DataFrame, path: str, tenant: str, column: str, tie: str, rows: int = PAGE_RANGE) -> None:
    """Store a list for reading pages however deep: ranges of ``rows`` rows in list order, and a directory of them.

    The order is (tenant, newest first, tie); a large tenant lies in many ranges. Short ranges
    share a block, one task's file, so that tasks, files and what the driver samples to cut the
    list follow its rows and not how short the ranges are. The directory has a row for each
    tenant of each range: its rows there, and those in the ranges before.
    """
    order = [F.asc(tenant), F.desc(column), F.asc(tie)]
    blocks = max(1, -(-df.count() // max(rows, PAGE_RANGE)))
    ranged = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    # The id counts a partition's rows, in their order, in its lower 33 bits.
    numbered = ranged.withColumns({"page_ranges": F.spark_partition_id(), "page_range": F.monotonically_increasing_id()})
    place, block = F.col("page_range").bitwiseAND((1 << 33) - 1), F.shiftleft(F.col("page_ranges").cast("bigint"), 33)
    split = numbered.withColumn("page_range", block + F.floor(place / F.lit(rows)))
    split.write.partitionBy("page_ranges").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    counts = stored.groupBy(F.col(tenant).alias("tenant"), "page_ranges", "page_range").agg(F.count("*").alias("n"))
    # At most one row for each range and tenant that has rows in it.
    before = F.sum("n").over(Window.partitionBy("tenant").orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1))
    counts.withColumn("first", F.coalesce(before, _zero())).write.parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, tenant: str, column: str, tie: str, limit: int, offset: int = 0, one: str | None = None) -> DataFrame:
    """The same page of every tenant, or of ``one``, with each row's ``rank``: only the blocks that hold it are read, only its ranges sorted."""
    directory = spark.read.parquet(f"{path}/directory").where((F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset))
    rows = spark.read.parquet(f"{path}/rows")
    if one is not None:
        directory = directory.where(F.col("tenant") == one)
        held_in = directory.select("page_ranges", "page_range").distinct().collect()  # those of one page
        rows = rows.where((F.col(tenant) == one) & F.col("page_ranges").isin([r[0] for r in held_in]) & F.col("page_range").isin([r[1] for r in held_in]))
    marks = directory.select(*[F.col(c).alias(f"__{c}") for c in ("tenant", "page_ranges", "page_range", "first")])
    same = F.col(tenant).eqNullSafe(F.col("__tenant")) & (F.col("page_ranges") == F.col("__page_ranges")) & (F.col("page_range") == F.col("__page_range"))
    held = rows.join(marks, same)
    within = Window.partitionBy("page_range", tenant).orderBy(F.desc(column), F.asc(tie))
    ranked = held.withColumn("rank", (F.col("__first") + F.row_number().over(within)).cast("int"))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop(*marks.columns, "page_ranges", "page_range")


def newest_first(df: DataFrame, column: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of a list, newest first with the id as tie-break."""
    return df.orderBy(F.desc(column), F.asc(tie)).offset(offset).limit(limit)


def page_per_tenant(
    df: DataFrame, tenant: str, column: str, tie: str, limit: int, offset: int = 0
) -> DataFrame:
    """The same page for every tenant at once."""
    ranked = _top_per_key(df, [tenant], [F.desc(column), F.asc(tie)], offset + limit)
    return ranked.where(F.col("rank") > offset)


def rollup_totals(clients: DataFrame) -> DataFrame:
    """Grand totals over the client list."""
    return clients.groupBy("ca_gstin").agg(
        F.count("*").alias("clients"),
        F.sum("invoice_count").alias("invoice_count"),
        F.sum("total_spend_minor").alias("total_spend_minor"),
        F.sum("open_flags").alias("open_flags"),
    )


def inbox_list(
    inbox: DataFrame, sources: DataFrame, invoices: DataFrame, status: str | None = None
) -> DataFrame:
    """Inbox rows with source kind, invoice and failure text.

    A message with several invoices yields several rows, as in the table view.
    """
    rows = inbox if status is None else inbox.where(F.col("status") == status)
    kinds = sources.select(F.col("id").alias("source_id"), "kind")
    bills = invoices.select(
        F.col("inbox_message_id").alias("id"), F.col("id").alias("invoice_id"), "vendor_name",
        "total_amount_minor", "currency",
    )
    return (
        rows.join(kinds, "source_id", "left")
        .join(bills, "id", "left")
        .select(
            "workspace_id", "id", "invoice_id",
            F.coalesce("kind", F.lit("upload")).alias("source_kind"),
            "sender", "subject", "received_at", "content_type", "status", "vendor_name",
            "total_amount_minor", F.coalesce("currency", F.lit("INR")).alias("currency"),
            failure_message(F.col("status"), F.col("ignored_reason")).alias("failure_message"),
        )
    )


def inbox_counts(inbox: DataFrame) -> DataFrame:
    """Messages per tenant, whatever their status."""
    return inbox.groupBy("workspace_id").agg(F.count("*").alias("messages"))


def lookup(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Many point lookups at once: rows of ``table`` that match a requested key."""
    return table.join(keys.select(*on).distinct(), on, "left_semi")


def invoice_summaries(
    invoices: DataFrame, inbox: DataFrame, sources: DataFrame, findings: DataFrame
) -> DataFrame:
    """Invoice header with its message, source kind and finding counts by outcome."""
    outcome = F.col("outcome")
    counts = findings.groupBy("workspace_id", "invoice_id").agg(
        F.count_if(outcome == "PASS").alias("pass_count"),
        F.count_if(outcome == "FAIL").alias("fail_count"),
        F.count_if(outcome == "NOT_APPLICABLE").alias("not_applicable_count"),
    )
    messages = inbox.select(
        "workspace_id", F.col("id").alias("inbox_message_id"), "source_id", "received_at",
        F.col("status").alias("extraction_status"),
    )
    kinds = sources.select(F.col("id").alias("source_id"), "kind")
    return (
        invoices.withColumnRenamed("id", "invoice_id")
        .join(messages, ["workspace_id", "inbox_message_id"])
        .join(kinds, "source_id", "left")
        .join(counts, ["workspace_id", "invoice_id"], "left")
        .select(
            "workspace_id", "invoice_id", "status", "vendor_name", "invoice_no", "invoice_date",
            "total_amount_minor", "currency",
            F.coalesce("kind", F.lit("upload")).alias("source_kind"),
            "received_at", "extraction_status",
            *[F.coalesce(c, _zero()).alias(c)
              for c in ("pass_count", "fail_count", "not_applicable_count")],
            F.concat(F.lit("/api/invoices/"), "invoice_id", F.lit("/image")).alias("image_url"),
        )
    )


def business_flags(findings: DataFrame) -> DataFrame:
    """Failing findings with their plain-language texts, one row each."""
    return with_rule_texts(findings.where("outcome = 'FAIL'"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, in all its columns.

    The winners are found among keys and order alone, with a combine before the shuffle;
    what else a row has is read for the winners afterwards, so long texts never pass
    through the aggregate. The order's columns together tell the rows of a key apart;
    rows equal in all of them come out as one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order)).alias("newest")
    winners = df.select(*keys, *order).groupBy(*keys).agg(newest).select(*keys, *[F.col(f"newest.{c}").alias(c) for c in order])
    if not rest:
        return winners.select(*df.columns)
    marks = winners.select(*[F.col(c).alias(f"won_{c}") for c in (*keys, *order)])
    same = F.lit(True)
    for c in (*keys, *order):
        same = same & F.col(c).eqNullSafe(F.col(f"won_{c}"))
    return df.join(marks, same, "left_semi").dropDuplicates([*keys, *order])


def accountant_details(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Summary plus the stage outputs of the latest run; unreadable JSON is null."""
    latest = latest_per_key(
        runs.select(
            "workspace_id", "invoice_id", "created_at", "id", "pipeline_version", "total_ms",
            "ocr_result_json", "extraction_result_json", "tables_result_json",
            "validation_result_json",
        ),
        ["workspace_id", "invoice_id"], ["created_at", "id"],
    ).drop("created_at", "id")
    docs = [c for c in latest.columns if c.endswith("_json")]
    for c in docs:
        # try_parse_json checks the text; get_json_object('$') would accept fragments.
        latest = latest.withColumn(c, F.to_json(F.try_parse_json(c)))
    return summaries.join(latest, ["workspace_id", "invoice_id"], "left")


def invoice_per_message(invoices: DataFrame) -> DataFrame:
    """The most recent invoice of every message, within the tenant."""
    return invoices.groupBy("workspace_id", "inbox_message_id").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("invoice_id")
    )


def connected_mailboxes(sources: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Connected mailbox sources with the tenant's owner."""
    owners = workspaces.select(F.col("id").alias("workspace_id"), "owner_user_id")
    return sources.where("kind = 'gmail' and status = 'connected'").join(owners, "workspace_id").select(
        F.col("id").alias("source_id"), "workspace_id", "owner_user_id", "last_polled_at"
    )


def corpus_meta(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents and already processed documents per split."""
    marked = docs.join(
        stored.select("doc_id").distinct().withColumn("cached", F.lit(True)), "doc_id", "left"
    )
    return marked.groupBy("split").agg(
        F.count("*").alias("documents"), F.count("cached").alias("cached_documents")
    )


def corpus_list(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents with a processed flag; processed ones first, then by index."""
    marked = docs.join(
        stored.select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left"
    )
    return marked.select(
        "doc_id", "split", "index", F.coalesce("hit", F.lit(False)).alias("cached")
    ).orderBy(F.desc("cached"), "index")
