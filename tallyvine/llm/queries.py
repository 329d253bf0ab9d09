"""One query per operator over its whole table, and its DuckDB text where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.llm import chat, collocations, imatch, metric_join, mixing, neardup, passages, pii, quality, spm, url_reputation, variants, warc
from tallyvine.llm.common import ready, table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(ready(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    turns = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"),
    )
    return chat.digests(chat.windows(turns.unionByName(more)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(ready(spark), sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(ready(spark), table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: a page is bad if the row of ``labels`` with its id has quality 0."""
    pages, labels = table(ready(spark), sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judged(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.linked(table(ready(spark), sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.scored(docs, quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(ready(spark), table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of what they decode to."""
    found = spm.encoded(table(ready(spark), sf_dir, "documents"))
    text = spm.decoded(spark, F.col("ids"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(text.cast("binary"), 256).alias("decoded_sha256"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(ready(spark), sf_dir, "documents")).select("doc_id", "text", "n_private")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(ready(spark), sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.without_repeats(table(ready(spark), sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(ready(spark), sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix, "op2_chat": op2_chat, "op3_near_duplicates": op3_near_duplicates, "op5_imatch": op5_imatch, "op4_url_reputation": op4_url_reputation, "op6_embeddings": op6_embeddings,
    "op7_quality": op7_quality, "op8_warc": op8_warc, "op9_sentencepiece": op9_sentencepiece,
    "op10_pseudonyms": op10_pseudonyms, "op11_collocations": op11_collocations,
    "op12_passages": op12_passages, "op13_variants": op13_variants,
}
ORACLES = {"op1_mix": mixing.SQL, "op4_url_reputation": url_reputation.SQL, "op6_embeddings": metric_join.SQL, "op8_warc": warc.SQL, "op11_collocations": collocations.SQL, "op12_passages": passages.SQL}
