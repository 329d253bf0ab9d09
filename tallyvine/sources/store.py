"""Processed-document store (JSON lines), stage outputs, audit rows, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.functions.text import strip
from tallyvine.operators.dashboards import latest_per_key
from tallyvine.session import materialise

# --- JSON-lines store ----------------------------------------------------------


def parse_records(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(id, data)`` of every usable line.

    Blank lines, lines that are no JSON and records without id or data are
    skipped. ``data`` stays JSON text. Further columns are kept.
    """
    others = [c for c in lines.columns if c != text]
    usable = lines.where((strip(F.col(text)) != "") & F.try_parse_json(text).isNotNull())
    return usable.select(
        *others,
        F.get_json_object(text, "$.id").alias("id"),
        F.get_json_object(text, "$.data").alias("data"),
    ).where("id is not null and data is not null")


def last_records(records: DataFrame, order: list[str]) -> DataFrame:
    """The record that came last wins, per id."""
    return latest_per_key(records, ["id"], order).select("id", "data")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, value``: the lines of text files with their order, read by many tasks.

    A file is read in splits, and a split gives its lines in order; rows of a split stay
    together and in order in a task. ``block`` is where the split starts in the file, ``line`` counts
    within it, so (file, block, line) is the order of lines in the file, however large it is.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # Grows with the rows of a task, which is all that is compared: rows of one split are in one task.
    return lines.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def read_foreign_store(spark: SparkSession, path: str) -> DataFrame:
    """A store written by another program: the line order decides, the last record of an id wins.

    Large files are read by many tasks (``numbered_lines``). For our own stores use ``read_store``.
    """
    return last_records(parse_records(numbered_lines(spark, path)), ["file", "block", "line"])


def append_store(results: DataFrame, path: str, seq: int | Column) -> None:
    """Append ``(id, data)`` records; ``seq`` orders the appends."""
    number = F.lit(seq) if isinstance(seq, int) else seq
    results.select("id", "data", number.cast("bigint").alias("seq")).write.mode("append").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Our own store: splittable, ordered by the ``seq`` column."""
    lines = spark.read.text(path)
    records = parse_records(lines.withColumn(
        "seq", F.get_json_object("value", "$.seq").try_cast("bigint")
    ))
    return last_records(records, ["seq", "data"])


def not_yet_stored(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents without a stored result."""
    return docs.join(stored.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


# --- stage outputs -----------------------------------------------------------


def stage_json(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Pack columns into one JSON column; nulls are kept."""
    return df.withColumn(
        name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    )


def read_json(text: Column, schema: str) -> Column:
    """Parsed stage output, null when the text is no JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


# --- audit rows ----------------------------------------------------------------


def metadata_json(entries: Column) -> Column:
    """Map to JSON text; an empty or missing map gives null."""
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, F.to_json(entries))


def append_events(events: DataFrame, path: str) -> None:
    """Append audit rows; nothing is ever rewritten."""
    events.write.mode("append").parquet(path)


def tagged_tenants(events: DataFrame, tag: str) -> DataFrame:
    """Tenants created under a seed tag."""
    return events.where(
        F.col("workspace_id").isNotNull() & (F.get_json_object("metadata_json", "$.seed") == tag)
    ).select("workspace_id").distinct()


def without_tenants(table: DataFrame, tenants: DataFrame, column: str = "workspace_id") -> DataFrame:
    """All rows of a table that do not belong to the given tenants."""
    return table.join(tenants.select(F.col("workspace_id").alias(column)), column, "left_anti").select(
        *table.columns
    )


# Which column of a table names the row of the table that it goes with. In this order: parents first.
CASCADE: tuple[tuple[str, str, str], ...] = (
    ("sources", "workspace_id", "workspaces"),
    ("inbox_messages", "workspace_id", "workspaces"),
    ("invoices", "inbox_message_id", "inbox_messages"),
    ("invoices", "workspace_id", "workspaces"),
    ("pipeline_runs", "invoice_id", "invoices"),
    ("validation_findings", "invoice_id", "invoices"),
    ("jobs", "inbox_message_id", "inbox_messages"),
)


def tombstones(tables: dict[str, DataFrame], tenants: DataFrame, events: DataFrame, tag: str) -> dict[str, DataFrame]:
    """``id`` of the rows that go with the tenants, by table: what hangs on them in key order, their owners, and the tagged events.

    A row goes with any of its parents, so a child that lies in another tenant goes too.
    Events that only mention a tenant stay: they are a log. Each table's ids are written once, as the next tables hang on them.
    """
    gone = {"workspaces": materialise(tables["workspaces"].join(tenants.select(F.col("workspace_id").alias("id")), "id", "left_semi").select("id"), "gone-workspaces")}
    for table in dict.fromkeys(t for t, _, _ in CASCADE):
        parts = []
        for _, column, parent in (c for c in CASCADE if c[0] == table and c[2] in gone):
            parts.append(tables[table].join(gone[parent].select(F.col("id").alias(column)), column, "left_semi").select("id"))
        ids = parts[0]
        for more in parts[1:]:
            ids = ids.unionByName(more)
        gone[table] = materialise(ids.distinct(), f"gone-{table}")
    owners = tables["workspaces"].join(gone["workspaces"], "id", "left_semi").select(F.col("owner_user_id").alias("id")).distinct()
    gone["users"] = tables["users"].join(owners, "id", "left_semi").select("id")
    gone["events"] = events.where(F.get_json_object("metadata_json", "$.seed") == tag).select("id")
    return gone


def wiped(tables: dict[str, DataFrame], gone: dict[str, DataFrame], again: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables without the rows that are gone, and with those put in ``again``; a row put in again replaces one of its id."""
    out = {}
    for name, table in tables.items():
        kept = table.join(gone[name], "id", "left_anti").select(*table.columns) if name in gone else table
        fresh = (again or {}).get(name)
        if fresh is not None:
            kept = kept.join(fresh.select("id"), "id", "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))
        out[name] = kept
    return out


# --- stored files --------------------------------------------------------------


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with content, recursively."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length", "modificationTime", "content")
    )


def list_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Path below ``root`` and size of every file; the content is never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    marker = root.rstrip("/") + "/"
    return listing.select(
        F.element_at(F.split("path", F.lit(marker), 2), -1).alias("file_storage_key"), "length"
    )


def write_blobs(rows: DataFrame, path: str) -> None:
    """Rows with content, laid out by tenant and first hash digits."""
    rows.withColumn("sha_prefix", F.substring("file_sha256", 1, 2)).write.mode("append").partitionBy(
        "workspace_id", "sha_prefix"
    ).parquet(path)
