"""Accuracy evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.functions.text import blank_to_null, squeeze
from tallyvine.operators.fields import FIELD_ORDER

# Report order of the header fields, item fields, and the gates.
EVALUATED_FIELDS: tuple[str, ...] = (
    "invoice_no", "invoice_date", "seller", "client", "seller_tax_id", "client_tax_id", "iban",
)
NUMERIC_ITEM_FIELDS: tuple[str, ...] = (
    "item_qty", "item_net_price", "item_net_worth", "item_vat", "item_gross_worth",
)
ITEM_FIELDS: tuple[str, ...] = ("item_desc",) + NUMERIC_ITEM_FIELDS
HEADER_GATE = 0.90
ITEM_GATE = 0.85
OUTCOMES: tuple[str, ...] = ("correct", "wrong", "missed", "spurious", "both_none")

assert set(EVALUATED_FIELDS) == set(FIELD_ORDER)


def normalise(value: Column) -> Column:
    return blank_to_null(value)


def normalise_item(field: Column, value: Column) -> Column:
    """As ``normalise``; numeric fields also lose inner white space."""
    trimmed = blank_to_null(value)
    return F.when(field.isin(*NUMERIC_ITEM_FIELDS), squeeze(trimmed)).otherwise(trimmed)


def outcome(pred: Column, gold: Column) -> Column:
    """Five-way comparison of two normalised values."""
    return (
        F.when(pred.isNull() & gold.isNull(), "both_none")
        .when(pred.isNull(), "missed")
        .when(gold.isNull(), "spurious")
        .when(pred == gold, "correct")
        .otherwise("wrong")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from the outcome counts of a row; 0 where undefined."""
    tp = F.col("correct")
    precision = _ratio(tp, tp + F.col("wrong") + F.col("spurious"))
    recall = _ratio(tp, tp + F.col("missed") + F.col("wrong"))
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            _ratio(
                F.lit(2.0) * F.col("precision") * F.col("recall"),
                F.col("precision") + F.col("recall"),
            ),
        )
    )


def outcome_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def header_outcomes(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """Outcome of every header field of every document; values are normalised."""
    pred = fields.select("doc_id", F.col("name").alias("field"), normalise(F.col("value")).alias("pred"))
    gold = truth.select("doc_id", F.col("name").alias("field"), normalise(F.col("value")).alias("gold"))
    return pred.join(gold, ["doc_id", "field"], "left").select(
        "doc_id", "field", "pred", "gold", outcome(F.col("pred"), F.col("gold")).alias("outcome")
    )


def macro_f1(scored: DataFrame, gate: float = HEADER_GATE) -> DataFrame:
    return scored.agg(F.avg("f1").alias("macro_f1")).withColumn(
        "gate_passed", F.col("macro_f1") >= F.lit(gate)
    )


def sample_summary(outcomes: DataFrame) -> DataFrame:
    return outcome_counts(outcomes, "doc_id").select(
        "doc_id", "correct", "wrong", "missed", "spurious"
    )


def first_header_failures(outcomes: DataFrame, limit: int = 30) -> DataFrame:
    """The first wrong or missed fields in document and report order."""
    position = F.array_position(F.array(*[F.lit(f) for f in EVALUATED_FIELDS]), F.col("field"))
    return (
        outcomes.where(F.col("outcome").isin("wrong", "missed"))
        .withColumn("position", position)
        .orderBy("doc_id", "position")
        .limit(limit)
        .select("doc_id", "field", "outcome", "pred", "gold")
    )


def align_items(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Items side by side by position; a missing side is null."""
    p = predicted.select("doc_id", "item_index", *[F.col(f).alias(f"pred_{f}") for f in ITEM_FIELDS])
    g = gold.select("doc_id", "item_index", *[F.col(f).alias(f"gold_{f}") for f in ITEM_FIELDS])
    return p.join(g, ["doc_id", "item_index"], "full")


def item_outcomes(aligned: DataFrame) -> DataFrame:
    """Outcome of every item field of every item position."""
    rows = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            normalise_item(F.lit(f), F.col(f"pred_{f}")).alias("pred"),
            normalise_item(F.lit(f), F.col(f"gold_{f}")).alias("gold"),
        )
        for f in ITEM_FIELDS
    ])
    long = aligned.select("doc_id", "item_index", F.inline(rows))
    return long.withColumn("outcome", outcome(F.col("pred"), F.col("gold")))


def item_counts(predicted: DataFrame, gold: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Items per document on both sides; documents without items count 0.

    With ``docs`` every listed document gets a row, also one without any item.
    """
    p = predicted.groupBy("doc_id").agg(F.count("*").alias("pred_items"))
    g = gold.groupBy("doc_id").agg(F.count("*").alias("gold_items"))
    zero = F.lit(0).cast("bigint")
    both = p.join(g, "doc_id", "full")
    if docs is not None:
        both = docs.select("doc_id").join(both, "doc_id", "left")
    return both.select(
        "doc_id",
        F.coalesce("pred_items", zero).alias("pred_items"),
        F.coalesce("gold_items", zero).alias("gold_items"),
    )


def item_count_accuracy(counts: DataFrame) -> DataFrame:
    same = F.count_if(F.col("pred_items") == F.col("gold_items"))
    return counts.agg(
        same.alias("matching_docs"), F.count("*").alias("docs"),
    ).withColumn("accuracy", _ratio(F.col("matching_docs"), F.col("docs")))


def failing_items(outcomes: DataFrame, counts: DataFrame, limit: int = 20) -> DataFrame:
    """The first documents with a bad item field or a wrong item count.

    A document fails when any outcome is not ``correct``; the listed fields leave
    out ``both_none``, as the report does.
    """
    order = F.array_position(F.array(*[F.lit(f) for f in ITEM_FIELDS]), F.col("field"))
    bad = ~F.col("outcome").isin("correct", "both_none")
    per_doc = outcomes.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") != "correct").alias("imperfect"),
        F.count_if(bad).alias("bad_fields"),
        F.min(F.when(bad, F.struct("item_index", order.alias("o"), "field"))).alias("first_bad"),
    )
    return (
        counts.join(per_doc, "doc_id", "left")
        .where("coalesce(imperfect, 0) > 0 or pred_items <> gold_items")
        .orderBy("doc_id")
        .limit(limit)
        .select(
            "doc_id", "pred_items", "gold_items",
            F.coalesce("bad_fields", F.lit(0).cast("bigint")).alias("bad_fields"),
            F.col("first_bad.item_index").alias("first_bad_item"),
            F.col("first_bad.field").alias("first_bad_field"),
        )
    )


def rule_rates(findings: DataFrame) -> DataFrame:
    """Outcome counts per rule and the pass rate among decided findings."""
    out = F.col("outcome")
    return (
        findings.groupBy("rule_name")
        .agg(
            F.count_if(out == "pass").alias("pass_count"),
            F.count_if(out == "fail").alias("fail_count"),
            F.count_if(out == "not_applicable").alias("na_count"),
        )
        .withColumn(
            "pass_rate", _ratio(F.col("pass_count"), F.col("pass_count") + F.col("fail_count"))
        )
        .orderBy("rule_name")
    )


def clean_rate(summary: DataFrame) -> DataFrame:
    """Share of documents in which nothing failed; 0 for an empty corpus."""
    return summary.agg(
        F.count_if("all_checks_pass").alias("clean_docs"), F.count("*").alias("docs")
    ).withColumn("clean_rate", _ratio(F.col("clean_docs"), F.col("docs")))


def first_rule_failures(findings: DataFrame, limit: int = 25) -> DataFrame:
    """The first failing findings in document and rule order."""
    return (
        findings.where("outcome = 'fail'")
        .orderBy("doc_id", "ord", "target")
        .limit(limit)
        .select("doc_id", "rule_name", "target", "reason", "expected", "observed")
    )
