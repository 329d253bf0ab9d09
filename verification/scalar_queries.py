"""Scalar functions and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvine.functions import numbers as N
from tallyvine.functions import patterns as P
from tallyvine.functions import text as T
from tallyvine.functions.files import decode_base64url
from tallyvine.functions.periods import month_start, next_month_start, period_bounds
from tallyvine.operators import rules as R
from tallyvine.operators.dashboards import in_period
from tallyvine.operators.fields import header_wide
from verification.registry import query

TIGHT = r"regexp_replace({0}, '\s+', '', 'g')"


def duck_plain(c: str) -> str:
    t = TIGHT.format(c)
    return f"CASE WHEN contains({t}, ',') THEN replace(replace({t}, '.', ''), ',', '.') ELSE {t} END"


def duck_decimal(c: str) -> str:
    return f"try_cast({duck_plain(c)} as decimal(38, 10))"


def duck_percent(c: str) -> str:
    return duck_decimal(f"rtrim(trim({c}), '%')")


@query(
    "f12_european_decimals",
    f"""SELECT doc_id, item_index, cast({duck_decimal('item_qty')} as double) AS qty,
    cast({duck_decimal('item_net_worth')} as double) AS net, cast({duck_decimal('item_gross_worth')} as double) AS gross
    FROM item""", ("item",),
)
def _(g):
    value = lambda c: N.european_decimal(F.col(c)).cast("double")
    return g.item.select(
        "doc_id", "item_index", value("item_qty").alias("qty"), value("item_net_worth").alias("net"),
        value("item_gross_worth").alias("gross"),
    )


@query("f13_percents", f"SELECT doc_id, item_index, cast({duck_percent('item_vat')} as double) AS vat FROM item",
       ("item",))
def _(g):
    return g.item.select("doc_id", "item_index", N.percent(F.col("item_vat")).cast("double").alias("vat"))


# Money texts in several notations, from order amounts.
MONEY_ROWS = """SELECT o_orderkey, cast(round(o_totalprice * 100) as bigint) AS c, o_orderpriority AS pr FROM {0}"""
MONEY_TEXT = """CASE pr WHEN '1-URGENT' THEN concat('$ ', cast({0} as string), '.', lpad(cast(c % 100 as string), 2, '0'))
  WHEN '2-HIGH' THEN concat('-', cast({0} as string), ',', cast(c % 10 as string))
  WHEN '3-MEDIUM' THEN concat('Rs ', cast({0} as string)) WHEN '4-NOT SPECIFIED' THEN 'n/a'
  ELSE concat('1.', lpad(cast({0} % 1000 as string), 3, '0'), ',', lpad(cast(c % 1000 as string), 3, '0')) END"""
KEPT = "regexp_replace(t, '[^0-9.,-]', '', 'g')"


@query(
    "f14_money_minor",
    f"""SELECT o_orderkey, CASE pr WHEN '1-URGENT' THEN c WHEN '2-HIGH' THEN 0 - ((c // 100) * 100 + (c % 10) * 10)
      WHEN '3-MEDIUM' THEN (c // 100) * 100 WHEN '4-NOT SPECIFIED' THEN NULL
      ELSE (1000 + (c // 100) % 1000) * 100 + (c % 1000) // 10 END AS minor
    FROM ({MONEY_ROWS.format('orders')})""",
)
def _(g):
    rows = g.spark.sql(
        f"SELECT o_orderkey, {MONEY_TEXT.format('(c div 100)')} AS t "
        f"FROM ({MONEY_ROWS.format(g.dialect.table('orders'))})"
    )
    return rows.select("o_orderkey", N.money_to_minor(F.col("t")).alias("minor"))


# Oracle: the number is read piece by piece, so no step exceeds 64 bits.
IBAN_SQL = r"""(regexp_matches({0}, '^[A-Z]{{2}}\d{{2}}[A-Z0-9]+$') AND list_reduce(
  list_transform(string_split(substr({0}, 5) || substr({0}, 1, 4), ''),
    lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN cast(ascii(ch) - 48 as bigint) ELSE cast(ascii(ch) - 55 as bigint) END),
  lambda acc, d: CASE WHEN d < 10 THEN (acc * 10 + d) % 97 ELSE (acc * 100 + d) % 97 END, 0::bigint) = 1)"""
IBAN_CODE = "upper(replace(trim(iban), ' ', ''))"


@query(
    "f15_iban_mod97",
    f"SELECT doc_id, coalesce({IBAN_SQL.format(IBAN_CODE)}, false) AS valid FROM header", ("header",),
)
def _(g):
    return g.header.select("doc_id", N.iban_is_valid(F.col("iban")).alias("valid"))


@query(
    "f16_shapes",
    r"""SELECT w.id, regexp_matches(gstin, '^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]$') AS gstin_ok,
    regexp_matches(phone, '^\+?[1-9]\d{7,14}$') AS phone_ok, regexp_matches(right(phone, 6), '^\d{6}$') AS otp_ok,
    length(trim(name)) BETWEEN 1 AND 120 AS name_ok FROM workspaces w JOIN users u ON u.id = w.owner_user_id""",
    ("workspaces", "users"),
)
def _(g):
    users = g.users.select(F.col("id").alias("owner_user_id"), "phone")
    return g.workspaces.join(users, "owner_user_id").select(
        "id", P.is_gstin(F.col("gstin")).alias("gstin_ok"), P.is_phone(F.col("phone")).alias("phone_ok"),
        P.is_otp(F.right("phone", F.lit(6))).alias("otp_ok"),
        P.is_display_name(F.col("name")).alias("name_ok"),
    )


@query("f17_canonical_text", f"SELECT doc_id, lower({TIGHT.format('text')}) AS canon FROM documents")
def _(g):
    return g.documents.select("doc_id", T.canon(F.col("text")).alias("canon"))


@query(
    "f19_display_amounts",
    """SELECT id, CASE WHEN total_amount_minor IS NULL THEN '—' ELSE
      CASE WHEN currency = 'INR' THEN '₹' ELSE currency || ' ' END || format('{:,.2f}', total_amount_minor / 100.0) END
    AS amount FROM invoices""", ("invoices",),
)
def _(g):
    amount = N.format_amount(F.col("total_amount_minor"), F.col("currency"))
    return g.invoices.select("id", amount.alias("amount"))


@query(
    "f20_markdown_cells",
    r"SELECT doc_id, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell FROM documents",
)
def _(g):
    return g.documents.select("doc_id", T.markdown_cell(F.col("text")).alias("cell"))


@query("f21_base64url", "SELECT doc_id, text AS decoded, octet_length(encode(text)) AS bytes FROM documents")
def _(g):
    coded = F.translate(F.base64(F.col("text").cast("binary")), "+/", "-_")
    raw = decode_base64url(coded)
    return g.documents.select(
        "doc_id", raw.cast("string").alias("decoded"), F.octet_length(raw).cast("bigint").alias("bytes")
    )


@query(
    "f22_month_bounds",
    """SELECT id, epoch_ms(date_trunc('month', make_timestamp(created_at * 1000))) AS start_ms,
    epoch_ms(date_trunc('month', make_timestamp(created_at * 1000)) + INTERVAL 1 MONTH) AS end_ms FROM invoices""",
    ("invoices",),
)
def _(g):
    at = F.col("created_at")
    return g.invoices.select("id", month_start(at).alias("start_ms"), next_month_start(at).alias("end_ms"))


NOW = 889617600000  # 11 March 1998


@query(
    "f23_previous_month",
    """SELECT id, created_at FROM invoices WHERE created_at >= epoch_ms(TIMESTAMP '1998-02-01')
    AND created_at < epoch_ms(TIMESTAMP '1998-03-01')""", ("invoices",),
)
def _(g):
    return in_period(g.invoices, *period_bounds("last_month", NOW)).select("id", "created_at")


@query(
    "f24_stringified",
    """SELECT doc_id, cast(n_chars as varchar) AS number, '{"lang":"' || lang || '","source":"' || source || '"}' AS nested
    FROM documents""",
)
def _(g):
    return g.documents.select(
        "doc_id", T.as_text(F.col("n_chars")).alias("number"),
        T.as_text(F.struct("lang", "source"), is_scalar=False).alias("nested"),
    )


# --- rules ----------------------------------------------------------------------


def rule_sql(rule: str, target: str, value: str, ok: str, reason: str) -> str:
    return f"""SELECT doc_id, '{rule}' AS rule_name, '{target}' AS target,
      CASE WHEN {value} IS NULL THEN 'not_applicable' WHEN {ok} THEN 'pass' ELSE 'fail' END AS outcome,
      CASE WHEN {value} IS NULL THEN 'field not extracted' WHEN NOT coalesce({ok}, false) THEN '{reason}' END AS reason,
      cast(NULL as varchar) AS expected,
      CASE WHEN NOT coalesce({ok}, false) THEN {value} END AS observed FROM header"""


RULES = {
    "v01_invoice_no_format": (
        R.invoice_no_rule, ("invoice_no",),
        rule_sql("invoice_no_format", "invoice_no", "invoice_no",
                 r"regexp_matches(invoice_no, '^\d{6,10}$')", "must be 6-10 digits"),
    ),
    "v02_invoice_date_format": (
        R.invoice_date_rule, ("invoice_date",),
        rule_sql("invoice_date_format", "invoice_date", "invoice_date",
                 "try_strptime(invoice_date, '%m/%d/%Y') IS NOT NULL", "does not parse as %m/%d/%Y"),
    ),
    "v03_seller_tax_id_format": (
        lambda c: R.tax_id_rule("seller_tax_id", c), ("seller_tax_id",),
        rule_sql("tax_id_format", "seller_tax_id", "seller_tax_id",
                 r"regexp_matches(seller_tax_id, '^\d{3}-\d{2}-\d{4}$')", "must match XXX-XX-XXXX"),
    ),
    "v04_client_tax_id_format": (
        lambda c: R.tax_id_rule("client_tax_id", c), ("client_tax_id",),
        rule_sql("tax_id_format", "client_tax_id", "client_tax_id",
                 r"regexp_matches(client_tax_id, '^\d{3}-\d{2}-\d{4}$')", "must match XXX-XX-XXXX"),
    ),
    "v05_iban_shape": (
        R.iban_shape_rule, ("iban",),
        rule_sql("iban_shape", "iban", "iban",
                 r"regexp_matches(upper(replace(iban, ' ', '')), '^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$')",
                 "must match country-prefix + 2 check digits + 11-30 alphanumerics"),
    ),
    "v07_iban_checksum": (
        R.iban_checksum_rule, ("iban",),
        rule_sql("iban_checksum", "iban", "iban", IBAN_SQL.format(IBAN_CODE),
                 "mod-97 check failed (OCR corruption or invalid IBAN)"),
    ),
}
COLUMNS = ("doc_id", "rule_name", "target", "outcome", "reason", "expected", "observed")
for _name, (_rule, _inputs, _sql) in RULES.items():

    @query(_name, _sql, ("header",))
    def _(g, rule=_rule, inputs=_inputs):
        row = rule(*[F.col(c) for c in inputs])
        return g.header.select("doc_id", F.inline(F.array(row))).drop("ord")


HEADER_SQL = " UNION ALL ".join(sql for _, _, sql in RULES.values())


@query("v06_header_findings", HEADER_SQL, ("header",))
def _(g):
    return R.header_findings(g.header).select(*COLUMNS)


def trimmed_scale(pct: str) -> str:
    """Decimals of ``pct / 100`` without trailing zeros (whole percents)."""
    return f"CASE WHEN ({pct}) % 100 = 0 THEN 0 WHEN ({pct}) % 10 = 0 THEN 1 ELSE 2 END"


# Item amounts as exact whole numbers of cents. Expected values keep the decimals
# that exact decimal arithmetic writes.
ITEM_RULES = f"""parsed AS (SELECT doc_id, item_index,
    cast(round(cast({duck_decimal('item_qty')} as double) * 100) as bigint) AS q,
    cast(round(cast({duck_decimal('item_net_price')} as double) * 100) as bigint) AS p,
    cast(round(cast({duck_decimal('item_net_worth')} as double) * 100) as bigint) AS n,
    cast({duck_percent('item_vat')} as bigint) AS v,
    cast(round(cast({duck_decimal('item_gross_worth')} as double) * 100) as bigint) AS g
  FROM item),
judged AS (SELECT *, abs(q * p - n * 100) <= greatest(10000, q * p / 100.0) AS net_ok,
    abs(n * (100 + v) - g * 100) <= greatest(10000, abs(n * (100 + v)) / 100.0) AS gross_ok FROM parsed),
item_finding AS (
  SELECT doc_id, 'item_net_worth_consistency' AS rule_name, 'item[' || item_index || '].net_worth' AS target,
    CASE WHEN net_ok IS NULL THEN 'not_applicable' WHEN net_ok THEN 'pass' ELSE 'fail' END AS outcome,
    CASE WHEN net_ok IS NULL THEN 'missing or unparseable qty / net_price / net_worth'
      WHEN NOT net_ok THEN 'net_worth != qty * net_price beyond tolerance' END AS reason,
    CASE WHEN NOT net_ok THEN (q * p) // 10000 || '.' || lpad(cast((q * p) % 10000 as varchar), 4, '0') END AS expected,
    CASE WHEN NOT net_ok THEN n // 100 || '.' || lpad(cast(n % 100 as varchar), 2, '0') END AS observed
  FROM judged UNION ALL
  SELECT doc_id, 'item_gross_worth_consistency', 'item[' || item_index || '].gross_worth',
    CASE WHEN gross_ok IS NULL THEN 'not_applicable' WHEN gross_ok THEN 'pass' ELSE 'fail' END,
    CASE WHEN gross_ok IS NULL THEN 'missing or unparseable net_worth / vat / gross_worth'
      WHEN NOT gross_ok THEN 'gross_worth != net_worth * (1 + VAT/100) beyond tolerance' END,
    CASE WHEN NOT gross_ok THEN left((n * (100 + v)) // 10000 || '.' || lpad(cast((n * (100 + v)) % 10000 as varchar), 4, '0'),
      cast(length(cast((n * (100 + v)) // 10000 as varchar)) + 3 + {trimmed_scale('v')} as int)) END,
    CASE WHEN NOT gross_ok THEN g // 100 || '.' || lpad(cast(g % 100 as varchar), 2, '0') END FROM judged)"""
IT = ("item",)


@query("v08_item_net_worth", "SELECT * FROM item_finding WHERE rule_name = 'item_net_worth_consistency'", IT, ITEM_RULES)
def _(g):
    return R.item_findings(g.item).where("rule_name = 'item_net_worth_consistency'").select(*COLUMNS)


@query("v09_item_gross_worth", "SELECT * FROM item_finding WHERE rule_name = 'item_gross_worth_consistency'", IT, ITEM_RULES)
def _(g):
    return R.item_findings(g.item).where("rule_name = 'item_gross_worth_consistency'").select(*COLUMNS)


@query(
    "v10_tolerance",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      abs(e - o) <= greatest(100, abs(e) / 100.0) AS ok FROM
    (SELECT *, cast(round(l_extendedprice * 100) as bigint) AS e,
      cast(round(l_extendedprice * (100 + l_discount * 20)) as bigint) AS o FROM lineitem)""",
)
def _(g):
    cents = lambda c: F.round(c).cast("bigint")
    e = cents(F.col("l_extendedprice") * 100)
    o = cents(F.col("l_extendedprice") * (F.lit(100) + F.col("l_discount") * 20))
    amount = lambda c: (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,8)")
    return g.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        R.within_tolerance(amount(e), amount(o)).alias("ok"),
    )


@query("v11_item_findings", "SELECT * FROM item_finding", IT, ITEM_RULES)
def _(g):
    return R.item_findings(g.item).select(*COLUMNS)


DUPLICATES = """dup_group AS (SELECT invoice_no, seller_tax_id, invoice_date, count(*) AS n FROM header
    WHERE invoice_no IS NOT NULL AND seller_tax_id IS NOT NULL AND invoice_date IS NOT NULL GROUP BY 1, 2, 3),
dup AS (SELECT doc_id, 'batch_duplicate' AS rule_name, 'record' AS target,
    CASE WHEN n IS NULL THEN 'not_applicable' WHEN n > 1 THEN 'fail' ELSE 'pass' END AS outcome,
    CASE WHEN n IS NULL THEN 'missing invoice_no / seller_tax_id / invoice_date' WHEN n > 1 THEN
      'duplicate (invoice_no, seller_tax_id, invoice_date) with ' || (n - 1) || ' other record(s)' END AS reason,
    cast(NULL as varchar) AS expected,
    CASE WHEN n > 1 THEN h.invoice_no || ' / ' || h.seller_tax_id || ' / ' || h.invoice_date END AS observed
  FROM header h LEFT JOIN dup_group d USING (invoice_no, seller_tax_id, invoice_date))"""


@query("v12_batch_duplicates", "SELECT * FROM dup", ("header",), DUPLICATES)
def _(g):
    return R.duplicate_findings(g.header).select(*COLUMNS)


@query(
    "v12_duplicate_members",
    """SELECT d.invoice_no, d.seller_tax_id, d.invoice_date, n AS members, batch_index, doc_id
    FROM header JOIN dup_group d USING (invoice_no, seller_tax_id, invoice_date) WHERE n > 1""",
    ("header",), DUPLICATES,
)
def _(g):
    return R.duplicate_members(g.header)


@query(
    "v12_other_members",
    """SELECT a.doc_id, b.batch_index AS other_index, b.doc_id AS other_doc_id FROM header a JOIN header b
    USING (invoice_no, seller_tax_id, invoice_date) WHERE a.batch_index <> b.batch_index""", ("header",),
)
def _(g):
    return R.other_members(g.header, g.header.select("doc_id"))


SINGLE = f"{ITEM_RULES}, single AS ({HEADER_SQL} UNION ALL SELECT * FROM item_finding)"


@query("v13_document_findings", "SELECT * FROM single", ("header", "item"), SINGLE)
def _(g):
    return R.validate(g.header, g.item).select(*COLUMNS)


BATCH = f"{SINGLE}, {DUPLICATES}, batch AS (SELECT * FROM single UNION ALL SELECT * FROM dup)"


@query("v14_batch_findings", "SELECT * FROM batch", ("header", "item"), BATCH)
def _(g):
    return R.validate_batch(g.header, g.item).select(*COLUMNS)


SUMMARY = """SELECT doc_id, count(*) FILTER (outcome = 'pass') AS pass_count, count(*) FILTER (outcome = 'fail') AS fail_count,
  count(*) FILTER (outcome = 'not_applicable') AS not_applicable_count,
  count(*) FILTER (outcome = 'fail') = 0 AS all_checks_pass FROM batch GROUP BY 1"""


@query("v15_outcome_summary", SUMMARY, ("header", "item"), BATCH)
def _(g):
    return R.outcome_summary(R.validate_batch(g.header, g.item))


@query("v15_failures", "SELECT * FROM batch WHERE outcome = 'fail'", ("header", "item"), BATCH)
def _(g):
    return R.failures(R.validate_batch(g.header, g.item)).select(*COLUMNS)


CANON = r"lower(regexp_replace({0}, '\s+', '', 'g'))"
ACCURACY = f"""accuracy AS (SELECT doc_id, 'accuracy_vs_gt' AS rule_name, name AS target,
    CASE WHEN g.value IS NULL THEN 'not_applicable' WHEN f.value IS NULL THEN 'fail'
      WHEN {CANON.format('f.value')} = {CANON.format('g.value')} THEN 'pass' ELSE 'fail' END AS outcome,
    CASE WHEN g.value IS NULL AND f.value IS NULL THEN 'no ground truth and no extraction'
      WHEN g.value IS NULL THEN 'ground truth missing' WHEN f.value IS NULL THEN 'field not extracted'
      WHEN {CANON.format('f.value')} <> {CANON.format('g.value')} THEN 'value differs from ground truth' END AS reason,
    g.value AS expected, f.value AS observed
  FROM field f FULL JOIN field_gt g USING (doc_id, name))"""
FG = ("field", "field_gt")


@query("v16_accuracy_findings", "SELECT * FROM accuracy", FG, ACCURACY)
def _(g):
    return R.accuracy_findings(g.field, g.field_gt).select(*COLUMNS)


@query(
    "v17_accurate_counts",
    """SELECT doc_id, count(*) FILTER (outcome = 'pass') AS accurate, count(expected) AS with_truth
    FROM accuracy GROUP BY 1""", FG, ACCURACY,
)
def _(g):
    return R.accurate_counts(R.accuracy_findings(g.field, g.field_gt))


@query("v17_findings_by_outcome", "SELECT doc_id, outcome, count(*) AS findings FROM single GROUP BY 1, 2",
       ("header", "item"), SINGLE)
def _(g):
    return R.findings_by_outcome(R.validate(header_wide(g.field), g.item))
