"""Flat CSV export: header values repeated per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.evaluate import EVALUATED_FIELDS, ITEM_FIELDS

HEADER_COLUMNS = EVALUATED_FIELDS
ITEM_COLUMNS = ("item_index",) + ITEM_FIELDS
ALL_COLUMNS = HEADER_COLUMNS + ITEM_COLUMNS


def csv_rows(header: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item, or one row with blank item columns for a document without items.

    All 14 columns are text and null becomes the empty string. ``doc_id`` is kept
    for ordering and dropped by ``write_csv``.
    """
    texts = items.withColumn("item_index", F.col("item_index").cast("string"))
    return header.join(texts, "doc_id", "left").select(
        "doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ALL_COLUMNS]
    )


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header line, quotes only where needed, quotes doubled inside.

    Rows are range-partitioned by document and item, so the part files read in
    name order give the documents in order without one sorting task.
    """
    kept = list(columns or ALL_COLUMNS)
    # A column the rows do not have is written blank.
    chosen = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in kept]
    keys = [c for c in ("doc_id", "item_index") if c in rows.columns]
    if keys:
        order = [F.col("item_index").try_cast("int") if k == "item_index" else F.col(k) for k in keys]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(*chosen).write.mode("errorifexists").option("header", True).option(
        "quote", '"'
    ).option("escape", '"').option("emptyValue", "").option("quoteAll", False).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
