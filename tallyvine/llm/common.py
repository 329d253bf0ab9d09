"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvine.session import discard, materialise, prepare

#: Tables counted to have at most this many rows may be broadcast.
FEW_ROWS = 50_000

SPACES = r"[\x20\x09-\x0D]+"


#: Rows and bytes that a Python worker is handed at once. Documents may be long.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators need."""
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, outlives executors."""
    return materialise(df, f"llm-{label}")


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """Broadcast hint for a staged table, given only after its rows are counted."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def words(text: Column) -> Column:
    """Maximal runs outside U+0020 and U+0009..U+000D; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def hash60(*parts: Column, seed: str) -> Column:
    """Uniform 60-bit number of a row's key, the same in any SQL engine with MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def positions(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Number rows 0, 1, ... in a global order; no task sees more than one range of them."""
    ranged = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per range partition, so at most spark.sql.shuffle.partitions rows.
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return (
        ranged.withColumn("__row", within).join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__part", "__row", "__start")
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """``u > v`` of ``edges(a, b)``, each once."""
    both = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; root is the smallest node of its component.

    Alternating large-star and small-star steps. Neighbour minima come from a partial
    aggregate that is joined back, so a node with very many neighbours is never collected.
    """
    current = staged(_oriented(edges), label)
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen or state[0] == 0:
            break
        seen, before = state, current
        current = staged(_small_star(_large_star(before)), label)
        discard(before)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def drawn_together(edges: DataFrame, label: str) -> DataFrame:
    """``(a, b)``, ``a > b``: edges that join the same nodes after one large-star and one small-star step, most of them to a node near the root."""
    step = _small_star(_large_star(_oriented(edges)))
    return staged(step.select(F.col("u").alias("a"), F.col("v").alias("b")), label)


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()
