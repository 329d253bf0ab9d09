"""Synthetic demo tenants and invoices, derived row by row from ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.functions.periods import month_bounds

# One accountant, four businesses, five to seven invoices each.
BUSINESSES = 4
FEWEST, MOST = 5, 7


def _pick(modulus: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(modulus)).cast("int")


def demo_workspaces(spark: SparkSession, tag: str) -> DataFrame:
    ids = spark.range(BUSINESSES + 1)
    is_ca = F.col("id") == 0
    gstin = F.concat(F.lpad(F.col("id").cast("string"), 2, "0"), F.lit("AAAAA0000A1Z5"))
    return ids.select(
        F.concat(F.lit(f"{tag}-ws-"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit(f"{tag}-user-"), F.col("id").cast("string")).alias("owner_user_id"),
        F.when(is_ca, "Demo Accountant").otherwise(
            F.concat(F.lit("Demo Business "), F.col("id").cast("string"))
        ).alias("name"),
        gstin.alias("gstin"),
        F.when(~is_ca, F.lit("00AAAAA0000A1Z5")).alias("ca_gstin"),
    )


def demo_invoices(spark: SparkSession, tag: str, year: int, month: int) -> DataFrame:
    """Five to seven invoices per business over this and the previous month, one or two failing."""
    this_month, _ = month_bounds(year, month)
    last_month, _ = month_bounds(*((year - 1, 12) if month == 1 else (year, month - 1)))
    b, n = F.col("business"), F.col("n")
    count = F.lit(FEWEST) + _pick(MOST - FEWEST + 1, b, F.lit("count"))
    failing = F.lit(1) + _pick(2, b, F.lit("failing"))
    rows = spark.range(1, BUSINESSES + 1).select(F.col("id").alias("business")).select(
        "business", F.explode(F.sequence(F.lit(0), count - 1)).alias("n")
    )
    start = F.when(n * 2 >= count, F.lit(this_month)).otherwise(F.lit(last_month))
    return rows.select(
        F.concat_ws("-", F.lit(f"{tag}-inv"), b.cast("string"), n.cast("string")).alias("id"),
        F.concat(F.lit(f"{tag}-ws-"), b.cast("string")).alias("workspace_id"),
        F.concat(F.lit("Vendor "), _pick(5, b, n).cast("string")).alias("vendor_name"),
        (F.lit(10_000) + _pick(1_000_000, b, n, F.lit("amount"))).cast("bigint")
        .alias("total_amount_minor"),
        (start + _pick(27, b, n, F.lit("day")).cast("bigint") * 86_400_000).alias("created_at"),
        F.when(n < failing, "flagged").otherwise("under_review").alias("status"),
        (n < failing).alias("failing"),
    )
