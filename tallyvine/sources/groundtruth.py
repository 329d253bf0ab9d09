"""Labelled documents: reading, ground-truth parsing, header and item access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.operators.evaluate import EVALUATED_FIELDS, ITEM_FIELDS
from tallyvine.schemas import GROUND_TRUTH

_HEADER = "struct<" + ", ".join(f"{n}: string" for n in EVALUATED_FIELDS) + ">"
_ITEMS = "array<struct<" + ", ".join(f"{n}: string" for n in ITEM_FIELDS) + ">>"
TRUTH_SCHEMA = (
    f"gt_parse struct<header: {_HEADER}, items: {_ITEMS}>, header {_HEADER}, items {_ITEMS}"
)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled documents, optionally one split (pruned at the scan)."""
    docs = spark.read.schema(GROUND_TRUTH).parquet(path)
    return docs if split is None else docs.where(F.col("split") == split)


def document_id(split: Column, index: Column, corpus: str = "katanaml") -> Column:
    """``{corpus}-{split}-{index, five digits}``."""
    return F.format_string(f"{corpus}-%s-%05d", split, index)


def split_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("split").agg(F.count("*").alias("documents"))


def parse_truth(docs: DataFrame, column: str = "ground_truth") -> DataFrame:
    """Add ``gt`` (parsed, all null when unreadable) and ``raw`` (the text that failed).

    Null gives an empty record, bytes are decoded, text that is no JSON object is
    kept in ``raw``.
    """
    text = F.col(column).cast("string")
    parsed = F.from_json(text, TRUTH_SCHEMA, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json(text).isNotNull()
    return docs.withColumn("gt", F.when(readable, parsed)).withColumn(
        "raw", F.when(text.isNotNull() & ~readable, text)
    )


def header_of(parsed: DataFrame) -> DataFrame:
    """Header values in long form; the ``gt_parse`` wrapper is optional."""
    header = F.coalesce("gt.gt_parse.header", "gt.header")
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"h.{n}").alias("value")) for n in EVALUATED_FIELDS
    ])
    return parsed.select("doc_id", header.alias("h")).select("doc_id", F.inline(rows))


def items_of(parsed: DataFrame) -> DataFrame:
    """Item rows; the ``gt_parse`` wrapper is optional."""
    items = F.coalesce("gt.gt_parse.items", "gt.items")
    return parsed.select("doc_id", F.posexplode(items).alias("item_index", "i")).select(
        "doc_id", "item_index", "i.*"
    )
