"""Accuracy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvine.operators import evaluate as E
from tallyvine.operators import rules as R
from verification.registry import query
from verification.scalar_queries import BATCH, SUMMARY

FG = ("field", "field_gt")
OUTCOME = """CASE WHEN pred IS NULL AND gold IS NULL THEN 'both_none' WHEN pred IS NULL THEN 'missed'
  WHEN gold IS NULL THEN 'spurious' WHEN pred = gold THEN 'correct' ELSE 'wrong' END"""
HEADER = f"""normal AS (SELECT doc_id, name AS field, nullif(trim(f.value), '') AS pred, nullif(trim(g.value), '') AS gold
  FROM field f LEFT JOIN field_gt g USING (doc_id, name)),
result AS (SELECT *, {OUTCOME} AS outcome FROM normal)"""
COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in E.OUTCOMES)
SCORES = """SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT *, CASE WHEN correct + wrong + spurious > 0 THEN correct / (correct + wrong + spurious) ELSE 0.0 END AS precision,
  CASE WHEN correct + missed + wrong > 0 THEN correct / (correct + missed + wrong) ELSE 0.0 END AS recall
FROM ({0}))"""


def outcomes(g):
    return E.header_outcomes(g.field, g.field_gt)


@query("e01_normalised_values", "SELECT doc_id, field, pred, gold FROM normal", FG, HEADER)
def _(g):
    return outcomes(g).drop("outcome")


@query("e02_header_outcomes", "SELECT doc_id, field, outcome FROM result", FG, HEADER)
def _(g):
    return outcomes(g).select("doc_id", "field", "outcome")


PER_FIELD = f"SELECT field, {COUNTS} FROM result GROUP BY 1"


@query("e03_field_scores", SCORES.format(PER_FIELD), FG, HEADER)
def _(g):
    return E.scores(E.outcome_counts(outcomes(g), "field"))


@query("e04_field_outcomes", PER_FIELD, FG, HEADER)
def _(g):
    return E.outcome_counts(outcomes(g), "field")


@query("e05_macro_f1", f"SELECT avg(f1) AS macro_f1, avg(f1) >= 0.9 AS gate_passed FROM ({SCORES.format(PER_FIELD)})",
       FG, HEADER)
def _(g):
    return E.macro_f1(E.scores(E.outcome_counts(outcomes(g), "field")))


@query("e06_sample_summary", f"SELECT * EXCLUDE (both_none) FROM (SELECT doc_id, {COUNTS} FROM result GROUP BY 1)",
       FG, HEADER)
def _(g):
    return E.sample_summary(outcomes(g))


@query(
    "e06_first_failures",
    f"""SELECT doc_id, field, outcome, pred, gold FROM result WHERE outcome IN ('wrong', 'missed')
    ORDER BY doc_id, list_position({list(E.EVALUATED_FIELDS)}, field) LIMIT 30""", FG, HEADER,
)
def _(g):
    return E.first_header_failures(outcomes(g))


# The item table read from the page is compared with the generating values.
IG = ("item", "item_gt")
ALIGNED = "aligned AS (SELECT doc_id, item_index, " + ", ".join(
    f"p.{f} AS pred_{f}, g.{f} AS gold_{f}" for f in E.ITEM_FIELDS
) + " FROM item p FULL JOIN item_gt g USING (doc_id, item_index))"
ITEM_LONG = " UNION ALL ".join(
    f"SELECT doc_id, item_index, '{f}' AS field, "
    + (
        f"nullif(regexp_replace(trim(pred_{f}), '\\s+', '', 'g'), '') AS pred, "
        f"nullif(regexp_replace(trim(gold_{f}), '\\s+', '', 'g'), '') AS gold"
        if f in E.NUMERIC_ITEM_FIELDS
        else f"nullif(trim(pred_{f}), '') AS pred, nullif(trim(gold_{f}), '') AS gold"
    )
    + " FROM aligned"
    for f in E.ITEM_FIELDS
)
ITEM = f"{ALIGNED}, normal AS ({ITEM_LONG}), result AS (SELECT *, {OUTCOME} AS outcome FROM normal)"
ITEM_COUNTS = """counts AS (SELECT doc_id, coalesce(p.n, 0) AS pred_items, coalesce(g.n, 0) AS gold_items
  FROM (SELECT doc_id, count(*) AS n FROM item GROUP BY 1) p
  FULL JOIN (SELECT doc_id, count(*) AS n FROM item_gt GROUP BY 1) g USING (doc_id))"""


@query("e07_normalised_items", "SELECT doc_id, item_index, field, pred, gold FROM normal", IG, ITEM)
def _(g):
    return item_outcomes(g).drop("outcome")


def item_outcomes(g):
    return E.item_outcomes(E.align_items(g.item, g.item_gt))


@query("e08_aligned_items", "SELECT * FROM aligned", IG, ALIGNED)
def _(g):
    return E.align_items(g.item, g.item_gt)


@query(
    "e09_item_count_accuracy",
    """SELECT count(*) FILTER (pred_items = gold_items) AS matching_docs, count(*) AS docs,
    count(*) FILTER (pred_items = gold_items) / count(*) AS accuracy FROM counts""", IG, ITEM_COUNTS,
)
def _(g):
    return E.item_count_accuracy(E.item_counts(g.item, g.item_gt))


@query("e10_item_scores", SCORES.format(PER_FIELD), IG, ITEM)
def _(g):
    return E.scores(E.outcome_counts(item_outcomes(g), "field"))


@query("e10_item_macro_f1", f"SELECT avg(f1) AS macro_f1, avg(f1) >= 0.85 AS gate_passed FROM ({SCORES.format(PER_FIELD)})",
       IG, ITEM)
def _(g):
    return E.macro_f1(E.scores(E.outcome_counts(item_outcomes(g), "field")), E.ITEM_GATE)


POSITION = f"list_position({list(E.ITEM_FIELDS)}, field)"


@query(
    "e11_failing_documents",
    f"""SELECT doc_id, pred_items, gold_items, coalesce(bad, 0) AS bad_fields, first_bad_item, first_bad_field
    FROM counts LEFT JOIN (SELECT doc_id, count(*) FILTER (outcome <> 'correct') AS imperfect,
        count(*) FILTER (outcome NOT IN ('correct', 'both_none')) AS bad,
        arg_min(item_index, item_index * 10 + {POSITION}) FILTER (outcome NOT IN ('correct', 'both_none')) AS first_bad_item,
        arg_min(field, item_index * 10 + {POSITION}) FILTER (outcome NOT IN ('correct', 'both_none')) AS first_bad_field
      FROM result GROUP BY 1) b USING (doc_id)
    WHERE coalesce(imperfect, 0) > 0 OR pred_items <> gold_items ORDER BY doc_id LIMIT 20""",
    IG, f"{ITEM}, {ITEM_COUNTS}",
)
def _(g):
    return E.failing_items(item_outcomes(g), E.item_counts(g.item, g.item_gt))


HI = ("header", "item")


@query(
    "e12_rule_rates",
    """SELECT *, CASE WHEN pass_count + fail_count > 0 THEN pass_count / (pass_count + fail_count) ELSE 0.0 END AS pass_rate
    FROM (SELECT rule_name, count(*) FILTER (outcome = 'pass') AS pass_count, count(*) FILTER (outcome = 'fail') AS fail_count,
      count(*) FILTER (outcome = 'not_applicable') AS na_count FROM batch GROUP BY 1)""", HI, BATCH,
)
def _(g):
    return E.rule_rates(R.validate_batch(g.header, g.item))


@query(
    "e13_clean_rate",
    f"""SELECT count(*) FILTER (all_checks_pass) AS clean_docs, count(*) AS docs,
    count(*) FILTER (all_checks_pass) / count(*) AS clean_rate FROM ({SUMMARY})""", HI, BATCH,
)
def _(g):
    return E.clean_rate(R.outcome_summary(R.validate_batch(g.header, g.item)))


@query(
    "e14_first_rule_failures",
    """SELECT doc_id, rule_name, target, reason, expected, observed FROM batch WHERE outcome = 'fail'
    ORDER BY doc_id, CASE rule_name WHEN 'invoice_no_format' THEN 0 WHEN 'invoice_date_format' THEN 1
      WHEN 'tax_id_format' THEN CASE target WHEN 'seller_tax_id' THEN 2 ELSE 3 END WHEN 'iban_shape' THEN 4
      WHEN 'iban_checksum' THEN 5 WHEN 'batch_duplicate' THEN 1000000
      ELSE 6 + 2 * cast(regexp_extract(target, '\\[(\\d+)', 1) as int)
        + CASE rule_name WHEN 'item_gross_worth_consistency' THEN 1 ELSE 0 END END LIMIT 25""", HI, BATCH,
)
def _(g):
    return E.first_rule_failures(R.validate_batch(g.header, g.item))
