"""Golden vectors of the scalar functions, and fuzzy matching against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvine.functions import files, labels, numbers, patterns, periods, text
from tallyvine.operators.fields import ANCHOR_KEYS
from tallyvine.sources.config import mailbox_config


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v")).alias("r")).collect())]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    def best(p, q):
        m = len(p)
        return max(
            ratio(p, q[max(s, 0): s + m]) for s in range(1 - m, len(q)) if q[max(s, 0): s + m]
        )
    score = best(short, long_)
    return max(score, best(long_, short)) if len(a) == len(b) else score


def sample_lines():
    rng = random.Random(7)
    base = [v for vs in labels.LABELS.values() for v in vs]
    out = ["", "  ", "no", "ban 1", "x iba", "tax", "Invoicen0:12345", "Bradley-Andrade", " Seller: ", "Taxld:985-73-8194"]
    for v in base:
        for _ in range(6):
            chars = list(v)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(chars))
                if rng.random() < 0.5 and chars:
                    chars.pop(min(at, len(chars) - 1))
                else:
                    chars.insert(at, rng.choice("aeilno: 10t"))
            pad = rng.choice(["", "", "ab ", "12 "])
            out.append(pad + "".join(chars) + rng.choice(["", " 77", "x"]))
    return out


def test_line_is_label_equals_brute_force(spark):
    lines = sample_lines()
    for key, variants in labels.LABELS.items():
        want = [
            any(
                len(t.strip()) <= len(v) + 4 and ratio(t.strip().lower(), v.lower()) >= 85
                for v in variants
            )
            for t in lines
        ]
        assert column(spark, lines, lambda c: labels.is_label(c, key)) == want


def test_line_contains_label_equals_brute_force(spark):
    lines = sample_lines()
    for key in ("invoice_no", "date", "tax_id", "iban"):
        want = [any(partial(t.strip().lower(), v.lower()) >= 85 for v in labels.LABELS[key]) for t in lines]
        assert column(spark, lines, lambda c: labels.contains_label(c, key)) == want
        may = column(spark, lines, lambda c: labels.may_contain_label(c, key))
        assert all(m for m, w in zip(may, want) if w)


def test_gate_of_whole_line_labels(spark):
    """Every line that is a label passes the gate; few lines without a piece of one do."""
    lines = sample_lines()
    for keys in (tuple(labels.LABELS), ANCHOR_KEYS):
        want = [
            any(len(t.strip()) <= len(v) + 4 and ratio(t.strip().lower(), v.lower()) >= 85 for k in keys for v in labels.LABELS[k])
            for t in lines
        ]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
        may = {r.i: r.m for r in df.select("i", labels.may_be_label("t", keys).alias("m")).collect()}
        assert all(may[i] for i, w in enumerate(want) if w)
    df = spark.createDataFrame([(t,) for t in ("each", "pcs", "Qty", "1 319,97", "Article7", "Total")], "t string")
    passed = {r.t for r in df.where(labels.may_be_label("t", ANCHOR_KEYS)).collect()}
    assert "Total" in passed and not passed & {"each", "pcs", "Qty", "1 319,97"}


def test_exact_spellings_keep_the_first_group(spark):
    """A spelling that another group's variant is like is decided by score, so the first group still wins."""
    groups = {"a": ["summary"], "b": ["summary:", "seller"]}
    assert text._exact_keys(groups, 85) == {"seller": "b"}
    assert column(spark, ["Summary:", " SELLER ", "sel1er", "", None], lambda c: text.which_matches(c, groups)) == ["a", "b", None, None, None]


def test_structural_labels_exclude_each_other():
    """No line can be within reach of two labels: their distance is too large."""
    for a in ANCHOR_KEYS:
        for b in ANCHOR_KEYS:
            if a < b:
                for u in {v.lower() for v in labels.LABELS[a]}:
                    for w in {v.lower() for v in labels.LABELS[b]}:
                        distance = len(u) + len(w) - 2 * lcs(u, w)
                        # Largest total distance of a line to both.
                        n = min(len(u), len(w)) + 4
                        assert distance > 0.15 * (2 * n + len(u) + len(w)), (u, w)


def test_unknown_label_matches_nothing(spark):
    assert column(spark, ["x"], lambda c: labels.is_label(c, "nope")) == [False]


def test_respacing(spark):
    given = ["9879ElizabethCommon", "Unit9678Box9664", "DPOAP69387", "Lake Jonathan,Rl 12335", "Stacy VilleApt.488", "", None]
    want = ["9879 Elizabeth Common", "Unit 9678 Box 9664", "DPOAP69387", "Lake Jonathan, Rl 12335", "Stacy Ville Apt. 488", "", None]
    assert column(spark, given, text.respace) == want


def test_strip_knows_unicode_white_space(spark):
    assert column(spark, ["  a　", "b", " "], text.strip) == ["a", "b", ""]
    assert column(spark, ["  a　", "b", " ", "é "], text.quick_strip) == ["a", "b", "", "é"]


def test_patterns(spark):
    find = lambda p: (lambda c: patterns.find(c, p))
    assert column(spark, ["Invoicen0:97159829", "Invoice no. 12222347", "invoiceno:"], find(patterns.INVOICE_NO)) == ["97159829", "12222347", None]
    assert column(spark, ["  12345678  ", "1234", "no 12345678"], find(patterns.INVOICE_NO_BARE)) == ["12345678", None, None]
    assert column(spark, ["Taxld:985-73-8194", "x 1-2"], find(patterns.TAX_ID_ANCHORED)) == ["985-73-8194", None]


def test_numbers(spark):
    given = ["1 319,97", "1.319,97", "1 319.50,97", "10.00", "-5,25", "12,,5", "abc,def", " ", None]
    want = [1319.97, 1319.97, 131950.97, 10.0, -5.25, None, None, None, None]
    got = column(spark, given, numbers.european_decimal)
    assert [None if g is None else float(g) for g in got] == want
    got = column(spark, ["10 %", "10,5%", "10", "bogus", "10 % %"], numbers.percent)
    assert [None if g is None else float(g) for g in got] == [10.0, 10.5, 10.0, None, None]


def test_money(spark):
    given = ["$ 1,234.56", "1.234,56", "₹1234.5", "-5,2", "5", "", "-", "abc", "1 234,567", "--5,10", "5-3", ".5", "5.", None]
    want = [123456, 123456, 123450, -520, 500, None, None, None, 123456, -510, None, 50, 500, None]
    assert column(spark, given, numbers.money_to_minor) == want


def test_iban(spark):
    given = ["GB82WEST12345698765432", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "NL91ABNA0417164300",
             "GB83WEST12345698765432", "GB10YCPS61791374226282", "GB", "", None]
    assert column(spark, given, numbers.iban_is_valid) == [True, True, True, True, False, True, False, False, False]


def test_itc_rounds_down(spark):
    assert column(spark, [35000, -35000, 0], numbers.itc_estimate, "bigint") == [5338, -5339, 0]


def test_periods():
    assert periods.month_bounds(2024, 12) == (1733011200000, 1735689600000)
    assert periods.period_bounds("last_month", 1704153600000) == periods.month_bounds(2023, 12)
    assert periods.period_bounds("whatever", 1704153600000) == periods.month_bounds(2024, 1)
    with pytest.raises(ValueError):
        periods.month_bounds(2024, 13)


def test_files(spark):
    given = [b"\x89PNG\r\n\x1a\nx", b"\xff\xd8\xff\xee1", b"%PDF-1", b"MM\x00*", b"RIFF1234WEBP", b"RIFF1234WAVE", b"PK", b""]
    want = ["image/png", "image/jpeg", "application/pdf", "image/tiff", "image/webp", None, None, None]
    assert column(spark, given, files.sniff_content_type, "binary") == want


def test_config():
    assert mailbox_config({"email_ingestion": {}}).backfill_days == 30
    for bad in ({"backfill_days": 0}, {"backfill_days": True}, {"subject_keywords": "x"}, {"max_messages_per_poll": 1001}):
        with pytest.raises(ValueError):
            mailbox_config({"email_ingestion": bad})
    with pytest.raises(ValueError):
        mailbox_config("{}")
