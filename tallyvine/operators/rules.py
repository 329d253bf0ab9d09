"""Three-state validation rules: ``pass``, ``fail``, ``not_applicable``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.functions import patterns as P
from tallyvine.functions.numbers import (
    UNSCALED,
    at_scale,
    digits_of,
    exact_number,
    iban_is_valid,
    magnitude,
    percent_text,
    power_of_ten,
)
from tallyvine.functions.text import canon
from tallyvine.operators.fields import FIELD_ORDER, header_wide

PASS, FAIL, NA = "pass", "fail", "not_applicable"


def _text(value: Column | str | None) -> Column:
    if isinstance(value, Column):
        return value.cast("string")
    return F.lit(value).cast("string")


def finding(
    rule: str | Column,
    target: str | Column,
    outcome: Column,
    reason: Column,
    expected: Column | str | None = None,
    observed: Column | str | None = None,
    order: int | Column = 0,
) -> Column:
    """One finding as a struct; details are kept only where they apply."""
    return F.struct(
        (F.lit(order) if isinstance(order, int) else order).alias("ord"),
        _text(rule).alias("rule_name"),
        _text(target).alias("target"),
        outcome.alias("outcome"),
        reason.alias("reason"),
        _text(expected).alias("expected"),
        _text(observed).alias("observed"),
    )


def field_rule(
    rule: str, target: str, value: Column, ok: Column, fail_reason: str, order: int = 0
) -> Column:
    """A rule on one header value: missing is not applicable, else pass or fail."""
    good = F.coalesce(ok, F.lit(False))
    outcome = F.when(value.isNull(), NA).when(good, PASS).otherwise(FAIL)
    reason = F.when(value.isNull(), "field not extracted").when(~good, fail_reason)
    return finding(
        rule, target, outcome, reason,
        observed=F.when(value.isNotNull() & ~good, value), order=order,
    )


# The reason texts. ``ok``: the check where it is already worked out.
def invoice_no_rule(value: Column, order: int = 0, ok: Column | None = None) -> Column:
    return field_rule("invoice_no_format", "invoice_no", value,
                      invoice_no_ok(value) if ok is None else ok, "must be 6-10 digits", order)


def invoice_date_rule(value: Column, order: int = 0, ok: Column | None = None) -> Column:
    return field_rule("invoice_date_format", "invoice_date", value,
                      invoice_date_ok(value) if ok is None else ok, "does not parse as %m/%d/%Y", order)


def tax_id_rule(target: str, value: Column, order: int = 0, ok: Column | None = None) -> Column:
    return field_rule("tax_id_format", target, value,
                      tax_id_ok(value) if ok is None else ok, "must match XXX-XX-XXXX", order)


def iban_shape_rule(value: Column, order: int = 0, ok: Column | None = None) -> Column:
    return field_rule("iban_shape", "iban", value, iban_shape_ok(value) if ok is None else ok,
                      "must match country-prefix + 2 check digits + 11-30 alphanumerics", order)


def iban_checksum_rule(value: Column, order: int = 0, ok: Column | None = None) -> Column:
    return field_rule("iban_checksum", "iban", value, iban_is_valid(value) if ok is None else ok,
                      "mod-97 check failed (OCR corruption or invalid IBAN)", order)


def invoice_no_ok(value: Column) -> Column:
    return value.rlike(P.INVOICE_NO_SHAPE)


def invoice_date_ok(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("M/d/yyyy")).isNotNull()


def tax_id_ok(value: Column) -> Column:
    return value.rlike(P.TAX_ID_SHAPE)


def iban_shape_ok(value: Column) -> Column:
    return F.upper(F.replace(value, F.lit(" "), F.lit(""))).rlike(P.IBAN_SHAPE)


HEADER_VALUES = ("invoice_no", "invoice_date", "seller_tax_id", "client_tax_id", "iban")


def header_checks() -> dict[str, Column]:
    """The check of each header rule, as a column of its own: a rule uses it three times."""
    c = F.col
    return {
        "invoice_no_ok": invoice_no_ok(c("invoice_no")), "invoice_date_ok": invoice_date_ok(c("invoice_date")),
        "seller_tax_id_ok": tax_id_ok(c("seller_tax_id")), "client_tax_id_ok": tax_id_ok(c("client_tax_id")),
        "iban_shape_ok": iban_shape_ok(c("iban")), "iban_checksum_ok": iban_is_valid(c("iban")),
    }


def header_rules(checks: dict[str, Column] | None = None) -> list[Column]:
    """The six header rules over a wide header row, in their fixed order."""
    c, ok = F.col, checks or {}
    return [
        invoice_no_rule(c("invoice_no"), 0, ok.get("invoice_no_ok")),
        invoice_date_rule(c("invoice_date"), 1, ok.get("invoice_date_ok")),
        tax_id_rule("seller_tax_id", c("seller_tax_id"), 2, ok.get("seller_tax_id_ok")),
        tax_id_rule("client_tax_id", c("client_tax_id"), 3, ok.get("client_tax_id_ok")),
        iban_shape_rule(c("iban"), 4, ok.get("iban_shape_ok")),
        iban_checksum_rule(c("iban"), 5, ok.get("iban_checksum_ok")),
    ]


def _one_row_each(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """One row per finding. The findings are columns before the generator puts them together:
    Spark compiles a projection of any size, but interprets a generator that is too large."""
    names = [f"finding_{i}" for i in range(len(rules))]
    named = rows.select("doc_id", *[rule.alias(n) for n, rule in zip(names, rules)])
    return named.select("doc_id", F.inline(F.array(*names)))


def header_findings(header: DataFrame) -> DataFrame:
    """Six findings per document from the wide header."""
    checks = header_checks()
    checked = header.select("doc_id", *HEADER_VALUES, *[ok.alias(n) for n, ok in checks.items()])
    return _one_row_each(checked, header_rules({n: F.col(n) for n in checks}))


def within_tolerance(expected: Column, observed: Column) -> Column:
    """Difference of at most 1, or 1 % of the expected amount, bounds included."""
    # Absolute and relative tolerance.
    allowed = F.greatest(
        F.lit("1.0").cast("decimal(38,8)"),
        (F.abs(expected) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,8)"),
    )
    return F.abs(expected - observed).cast("decimal(38,8)") <= allowed


BEYOND = "amount beyond 38 digits"


def compared(amounts: DataFrame, expected: str, observed: str) -> DataFrame:
    """Two unscaled amounts (``<name>_u`` at scale ``<name>_s``) brought to one scale and compared.

    ``<expected>_apart`` and ``<expected>_allowed``: their distance, and at most 1 or 1 % of
    the expected amount; all a hundredfold, so that nothing is divided. Null where 38 digits do
    not hold them. One projection a step, so that each part is worked out once a row.
    """
    c, n = F.col, lambda name: f"{expected}_{name}"
    lifted = lambda name: F.try_multiply(c(f"{name}_u"), power_of_ten(c(n("scale")) - c(f"{name}_s")))
    at_one_scale = amounts.withColumn(n("scale"), F.greatest(c(f"{expected}_s"), c(f"{observed}_s"))).withColumns({
        n("lifted"): lifted(expected), n("other"): lifted(observed), n("one"): power_of_ten(c(n("scale")) + 2),
    })
    at_one_scale = at_one_scale.withColumn(n("gap"), F.try_subtract(c(n("lifted")), c(n("other"))))
    held = c(n("lifted")).isNotNull() & c(n("one")).isNotNull()
    apart = F.try_multiply(magnitude(c(n("gap"))), F.lit(100).cast(UNSCALED))
    return at_one_scale.withColumns({
        n("apart"): F.when(held, apart), n("allowed"): F.greatest(c(n("one")), magnitude(c(n("lifted")))),
    }).drop(n("scale"), n("lifted"), n("other"), n("one"), n("gap"))


def _item_rule(
    rule: str, label: str, inputs: list[str], expected: str, observed: str,
    missing: str, failing: str, order: Column,
) -> Column:
    """The finding on two ``compared`` amounts, shown with ``<name>_d`` decimals."""
    absent = F.lit(False)
    for name in inputs:
        absent = absent | ~F.col(f"{name}_ok")
    c = F.col
    beyond = ~absent & c(f"{expected}_apart").isNull()
    good = c(f"{expected}_apart") <= c(f"{expected}_allowed")
    failed = ~absent & ~beyond & ~good
    outcome = F.when(absent | beyond, NA).when(good, PASS).otherwise(FAIL)
    return finding(
        rule,
        F.concat(F.lit("item["), F.col("item_index").cast("string"), F.lit(f"].{label}")),
        outcome,
        F.when(absent, missing).when(beyond, BEYOND).when(failed, failing),
        expected=F.when(failed, at_scale(c(f"{expected}_u"), c(f"{expected}_s"), c(f"{expected}_d"))),
        observed=F.when(failed, at_scale(c(f"{observed}_u"), c(f"{observed}_s"), c(f"{observed}_s"))),
        order=order,
    )


AMOUNTS = ("item_qty", "item_net_price", "item_net_worth", "item_gross_worth")


def parsed_items(items: DataFrame) -> DataFrame:
    """Item amounts as whole numbers (``*_u``) with their number of decimals (``*_s``) and
    whether the text is a number (``*_ok``). A step of its own, so that each text is parsed once."""
    columns = [F.col("doc_id"), F.col("item_index")]
    texts = {name: F.col(name) for name in AMOUNTS} | {"item_vat": percent_text(F.col("item_vat"))}
    for name, text in texts.items():
        ok, unscaled, scale = exact_number(text)
        columns += [ok.alias(f"{name}_ok"), unscaled.alias(f"{name}_u"), scale.alias(f"{name}_s")]
    return items.select(*columns)


def expected_amounts(parsed: DataFrame) -> DataFrame:
    """Add the expected net and gross amounts; null where 38 digits do not hold them.

    An exact product has the decimals of both factors added up. The share ``vat / 100``
    is shown without trailing zeros, but with no fewer decimals than the text has.
    """
    c = F.col
    one = F.try_multiply(F.lit(100).cast(UNSCALED), power_of_ten(c("item_vat_s")))
    zeros = F.length(F.regexp_extract(digits_of(c("item_vat_u")), "(0*)$", 1))
    share = F.when(c("item_vat_u") == 0, F.lit(0)).otherwise(F.greatest(c("item_vat_s") + 2 - zeros, F.lit(0)))
    return parsed.select(
        "*",
        F.try_multiply(c("item_qty_u"), c("item_net_price_u")).cast(UNSCALED).alias("net_u"),
        (c("item_qty_s") + c("item_net_price_s")).alias("net_s"),
        (c("item_qty_s") + c("item_net_price_s")).alias("net_d"),
        F.try_multiply(c("item_net_worth_u"), F.try_add(one, c("item_vat_u")).cast(UNSCALED)).cast(UNSCALED).alias("gross_u"),
        (c("item_net_worth_s") + c("item_vat_s") + 2).alias("gross_s"),
        (c("item_net_worth_s") + F.greatest(share, c("item_vat_s"))).alias("gross_d"),
    )


def item_rules() -> list[Column]:
    """Quantity x price = net, and net x (1 + VAT) = gross, over ``expected_amounts``."""
    base = F.col("item_index").cast("int") * 2 + 6
    return [
        _item_rule(
            "item_net_worth_consistency", "net_worth", ["item_qty", "item_net_price", "item_net_worth"],
            "net", "item_net_worth", "missing or unparseable qty / net_price / net_worth",
            "net_worth != qty * net_price beyond tolerance", base,
        ),
        _item_rule(
            "item_gross_worth_consistency", "gross_worth", ["item_net_worth", "item_vat", "item_gross_worth"],
            "gross", "item_gross_worth", "missing or unparseable net_worth / vat / gross_worth",
            "gross_worth != net_worth * (1 + VAT/100) beyond tolerance", base + 1,
        ),
    ]


def item_findings(items: DataFrame) -> DataFrame:
    """Two findings per item, net before gross."""
    amounts = compared(compared(expected_amounts(parsed_items(items)), "net", "item_net_worth"), "gross", "item_gross_worth")
    return _one_row_each(amounts, item_rules())


DUPLICATE_KEY = ("invoice_no", "seller_tax_id", "invoice_date")
# Order value that sorts the duplicate finding after all others of its document.
DUPLICATE_ORDER = 2**31 - 1


def _duplicate_groups(header: DataFrame) -> DataFrame:
    """Keys that occur more than once. Counting combines before the shuffle."""
    complete = header.dropna(subset=list(DUPLICATE_KEY))
    return complete.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("members")).where("members > 1")


def duplicate_members(header: DataFrame) -> DataFrame:
    """Row form of the duplicate groups: one row per member, any group size."""
    return header.join(_duplicate_groups(header), list(DUPLICATE_KEY)).select(
        *DUPLICATE_KEY, "members", "batch_index", "doc_id"
    )


def duplicate_findings(header: DataFrame) -> DataFrame:
    """Exact duplicates in a batch; every member of a group is flagged.

    ``header`` has ``doc_id``, ``batch_index`` and the key columns. The size of a group
    is counted with map-side combine and joined back (the adaptive join splits a key
    that holds many rows). The reason names the number of other members, at every size;
    the members themselves are the rows of ``duplicate_members``.
    """
    key = list(DUPLICATE_KEY)
    rows = header.select("doc_id", "batch_index", *key).join(_duplicate_groups(header), key, "left")
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    repeated = F.col("members").isNotNull()
    others = F.concat(
        F.lit("duplicate (invoice_no, seller_tax_id, invoice_date) with "),
        (F.col("members") - 1).cast("string"), F.lit(" other record(s)"),
    )
    row = finding(
        "batch_duplicate", "record",
        F.when(missing, NA).when(repeated, FAIL).otherwise(PASS),
        F.when(missing, "missing invoice_no / seller_tax_id / invoice_date").when(repeated, others),
        observed=F.when(repeated, F.concat_ws(" / ", *key)),
        order=DUPLICATE_ORDER,
    )
    return rows.select("doc_id", F.inline(F.array(row)))


def other_members(header: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``doc_id, other_index, other_doc_id``: the other members of the groups of the documents a caller names."""
    members = duplicate_members(header)
    named = members.join(doc_ids.select("doc_id").distinct(), "doc_id").select("doc_id", "batch_index", *DUPLICATE_KEY)
    others = members.select(*DUPLICATE_KEY, F.col("batch_index").alias("other_index"), F.col("doc_id").alias("other_doc_id"))
    return named.join(others, list(DUPLICATE_KEY)).where("other_index <> batch_index").select("doc_id", "other_index", "other_doc_id")


def validate(header: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Header rules, then item rules when items are given; ``ord`` keeps the order."""
    found = header_findings(header)
    return found if items is None else found.unionByName(item_findings(items))


def validate_batch(header: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``validate`` plus the batch duplicates."""
    return validate(header, items).unionByName(duplicate_findings(header))


def validate_fields(fields: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``validate`` from the long field table."""
    return validate(header_wide(fields), items)


def outcome_summary(findings: DataFrame) -> DataFrame:
    """Counts per document and whether nothing failed."""
    return findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"{n}_count")
          for o, n in ((PASS, "pass"), (FAIL, "fail"), (NA, "not_applicable"))],
        F.bool_and(F.col("outcome") != FAIL).alias("all_checks_pass"),
    )


def failures(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("outcome") == FAIL)


def accuracy_findings(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """Header values against ground truth, compared in canonical form.

    Both sides are long tables ``(doc_id, name, value)``; a document or field
    that only one side has still gets its finding.
    """
    pred = fields.where(F.col("name").isin(*FIELD_ORDER)).select(
        "doc_id", "name", F.col("value").alias("pred")
    )
    gold = truth.where(F.col("name").isin(*FIELD_ORDER)).select(
        "doc_id", "name", F.col("value").alias("gold")
    )
    p, g = F.col("pred"), F.col("gold")
    equal = canon(p) == canon(g)
    row = finding(
        "accuracy_vs_gt", F.col("name"),
        F.when(g.isNull(), NA).when(p.isNull(), FAIL).when(equal, PASS).otherwise(FAIL),
        F.when(g.isNull() & p.isNull(), "no ground truth and no extraction")
        .when(g.isNull(), "ground truth missing")
        .when(p.isNull(), "field not extracted")
        .when(~equal, "value differs from ground truth"),
        expected=g,
        observed=F.when(g.isNull() | p.isNotNull(), p),
    )
    joined = pred.join(gold, ["doc_id", "name"], "full")
    return joined.select("doc_id", F.inline(F.array(row)))


def accurate_counts(accuracy: DataFrame) -> DataFrame:
    """Fields that agree with, and fields that have, ground truth, per document."""
    return accuracy.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == PASS).alias("accurate"),
        F.count_if(F.col("expected").isNotNull()).alias("with_truth"),
    )


def findings_by_outcome(findings: DataFrame) -> DataFrame:
    """Number of findings per document and outcome."""
    return findings.groupBy("doc_id", "outcome").agg(F.count("*").alias("findings"))
