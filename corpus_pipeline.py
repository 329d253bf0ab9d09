"""Corpus pipeline: quality, near-duplicates, personal data, mixture, tokens. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyvine.llm import mixing, neardup, pii, quality, spm
from tallyvine.llm.common import ready, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject. It is trained on the labelled documents of the corpus.

    Null and empty texts are judged as the empty text is; repeated rows stay or go together; without labels all stay.
    """
    net = quality.train(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, net).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: 100 * shared >= 80 * all 5-word shingles.

    Null, empty and blank texts are near nothing and all stay; of repeated rows one stays.
    """
    ready(spark)
    return neardup.deduplicated(docs, tuple(COLUMNS), percent=80)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; lengths stay, as pseudonyms but of IP addresses have the same form.

    Null texts stay null, with n_chars null; no row is added or lost.
    """
    return pii.pseudonymised(docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) AS n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents dropped, kept or repeated, always whole.

    A null source is a source of its own; null and empty texts have size 0 and come as often as their source is repeated.
    """
    ready(spark)
    return mixing.mixed_documents(docs).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``, one row for every document or repeat that is left; null and empty texts have no ids."""
    ready(spark)
    return spm.encoded(docs)


STAGES = [
    ("quality", keep_good), ("near_duplicates", keep_one_of_each), ("personal_data", hide_personal),
    ("mixture", mix_sources), ("tokens", to_tokens),
]

#: A network's scores and a vocabulary's ids cannot be said in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; no documents, no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
