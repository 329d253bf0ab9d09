"""Layout fixtures: detections, header fields, line items, rules."""

from pyspark.sql import functions as F

from tallyvine.operators import ocr, rules, upkeep
from tallyvine.operators.fields import extract_fields, field_diagnostics, header_wide
from tallyvine.operators.items import extract_items, item_diagnostics
from tallyvine.plans.extraction import batch_findings, document_report, extract_documents
from tallyvine.schemas import FIELD, ITEM


def page(spark, docs, width=800, height=1000):
    rows = [
        (doc, i, t, float(x0), float(y0), float(x1), float(y1), width, height)
        for doc, lines in docs.items() for i, (t, x0, y0, x1, y1) in enumerate(lines)
    ]
    return spark.createDataFrame(
        rows, "doc_id string, line_no int, text string, x0 double, y0 double, x1 double, y1 double, "
        "page_width int, page_height int"
    )


HEADER = [
    ("Invoiceno:97159829", 20, 10, 200, 30), ("Date of issue:", 400, 10, 520, 30), ("09/18/2015", 530, 10, 620, 30),
    ("Seller:", 20, 100, 80, 120), ("Client:", 420, 100, 480, 120),
    ("Bradley-Andrade", 20, 130, 160, 150), ("Castro PLC", 420, 130, 520, 150),
    ("9879ElizabethCommon", 20, 160, 200, 180), ("Unit9678Box9664", 420, 160, 560, 180),
    ("Taxld:985-73-8194", 20, 190, 180, 210), ("Tax Id: 994-72-1270", 420, 190, 580, 210),
    ("IBAN:GB81LZWO32519172531418", 20, 220, 300, 240), ("ITEMS", 20, 300, 80, 320),
]


def test_header_fields(spark):
    lines = page(spark, {"a": HEADER, "b": [("nothing here", 0, 0, 10, 10)]})
    got = {(r.doc_id, r.name): (r.value, r.confidence, r.source) for r in extract_fields(lines).collect()}
    assert got["a", "invoice_no"] == ("97159829", 0.95, "regex")
    assert got["a", "invoice_date"] == ("09/18/2015", 0.70, "regex")
    assert got["a", "seller_tax_id"] == ("985-73-8194", 0.90, "regex")
    assert got["a", "client_tax_id"] == ("994-72-1270", 0.90, "regex")
    assert got["a", "iban"][0] == "GB81LZWO32519172531418"
    assert got["a", "seller"] == ("Bradley-Andrade 9879 Elizabeth Common", 0.75, "column_heuristic")
    assert got["a", "client"][0] == "Castro PLC Unit 9678 Box 9664"
    assert len(got) == 14
    assert got["b", "iban"] == (None, 0.0, "none")
    diag = {r.doc_id: r for r in field_diagnostics(lines).collect()}
    assert diag["a"].column_split_x == 250.0 and diag["b"].column_split_x == 400.0
    assert (diag["a"].left_line_count, diag["a"].right_line_count) == (4, 3)


def item_row(n, y, values, desc):
    xs = (400, 480, 560, 720)
    return [(f"{n}.", 20, y, 40, y + 20), (desc, 60, y + 1, 300, y + 21)] + [
        (v, x, y, x + 60, y + 20) for v, x in zip(values, xs)
    ] + [("each", 450, y, 470, y + 20), ("10%", 660, y, 690, y + 20)]


ONE = [("ITEMS", 20, 100, 80, 120)] + item_row(1, 200, ("2,00", "444,60", "889,20", "978,12"), "Marble Coffee") + [
    ("TableTop", 60, 230, 200, 250), ("Handmade,old", 62, 260, 200, 280), ("far right", 500, 230, 560, 250),
    ("SUMMARY", 20, 400, 120, 420), ("Total", 20, 440, 80, 460),
]
THREE = [("ITEMS", 20, 100, 80, 120)] + item_row(1, 200, ("1,00", "65,00", "65,00", "71,50"), "One") + item_row(
    2, 260, ("3,00", "399,99", "1 199,97", "1 319,97"), "Two") + item_row(3, 320, ("1,00", "34,00", "34,00", "37,40"), "Three")


def test_line_items(spark):
    lines = page(spark, {"one": ONE, "three": THREE, "none": [("1.", 20, 200, 40, 220)], "empty": ONE[:1]}, 900, 1200)
    rows = {(r.doc_id, r.item_index): r for r in extract_items(lines).collect()}
    first = rows["one", 0]
    assert first.item_desc == "Marble Coffee Table Top Handmade, old"
    assert (first.item_qty, first.item_net_price, first.item_net_worth) == ("2,00", "444,60", "889,20")
    assert (first.item_vat, first.item_gross_worth) == ("10%", "978,12")
    assert [rows["three", i].item_gross_worth for i in range(3)] == ["71,50", "1 319,97", "37,40"]
    assert len(rows) == 4
    reasons = {r.doc_id: (r.reason, r.anchor_count) for r in item_diagnostics(lines).collect()}
    assert reasons == {"one": (None, 1), "three": (None, 3), "none": ("no ITEMS anchor", None), "empty": ("no item anchors", 0)}


def test_whole_extraction(spark):
    lines = page(spark, {"a": HEADER + [(t, x0, y0 + 300, x1, y1 + 300) for t, x0, y0, x1, y1 in ONE[1:]]}, 900, 1500)
    result = extract_documents(lines)
    report = document_report(result).collect()
    assert len(report) == 1 and report[0].total_amount_minor == 97812 and report[0].item_count == 1
    # The sample IBAN is not valid; everything else passes.
    assert report[0].fail_count == 0 or report[0].all_checks_pass is False
    index = lines.select("doc_id").distinct().withColumn("batch_index", F.lit(0))
    names = [r.rule_name for r in batch_findings(result, index).orderBy("ord").collect()]
    assert names[-1] == "batch_duplicate" and len(names) == 9


def test_detections(spark):
    pages = spark.createDataFrame(
        [("d", 100, 100, [([[0.0, 0.0], [40.0, 0.0], [40.0, 9.0], [0.0, 9.0]], "ab  cde", "1.7"),
                          ([[0.0, 0.0]], "", "0.5"), ([[1.0, 2.0], [3.0, 1.0]], "x", "NaN")])],
        "doc_id string, page_width int, page_height int, "
        "detections array<struct<polygon: array<array<double>>, text: string, score: string>>",
    )
    lines = ocr.shape_lines(ocr.explode_pages(pages))
    got = [(r.line_no, r.text, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in lines.orderBy("line_no").collect()]
    assert got == [(0, "ab  cde", 0.0, 0.0, 40.0, 9.0, 1.0), (1, "x", 1.0, 1.0, 3.0, 2.0, 0.0)]
    tokens = [(r.text, r.x0, r.x1) for r in ocr.split_tokens(lines).orderBy("line_no", "token_no").collect()]
    assert tokens == [("ab", 0.0, 2 / 6 * 40), ("cde", 3 / 6 * 40, 40.0), ("x", 1.0, 3.0)]


def test_rules(spark):
    fields = spark.createDataFrame(
        [("d", n, v, 0.9, "regex", None) for n, v in (
            ("invoice_no", "12345"), ("invoice_date", "9/8/2015"), ("seller_tax_id", "123-45-6789"),
            ("client_tax_id", None), ("iban", "GB83WEST12345698765432"))], FIELD)
    items = spark.createDataFrame(
        [("d", 0, "x", "2,00", "10,00", "20,00", "10%", "22,00"), ("d", 1, "x", "2,00", "10,00", "21,01", "7 %", "x"),
         ("d", 2, "x", "3,00", "100,00", "303,00", "7%", "400,00")], ITEM)
    got = {(r.rule_name, r.target): (r.outcome, r.expected, r.observed) for r in rules.validate_fields(fields, items).collect()}
    assert got["invoice_no_format", "invoice_no"] == ("fail", None, "12345")
    assert got["invoice_date_format", "invoice_date"][0] == "pass"
    assert got["tax_id_format", "client_tax_id"][0] == "not_applicable"
    assert got["iban_shape", "iban"][0] == "pass" and got["iban_checksum", "iban"][0] == "fail"
    assert got["item_net_worth_consistency", "item[0].net_worth"][0] == "pass"
    assert got["item_net_worth_consistency", "item[1].net_worth"] == ("fail", "20.0000", "21.01")
    assert got["item_net_worth_consistency", "item[2].net_worth"][0] == "pass"
    assert got["item_gross_worth_consistency", "item[1].gross_worth"][0] == "not_applicable"
    assert got["item_gross_worth_consistency", "item[2].gross_worth"] == ("fail", "324.2100", "400.00")


def test_amounts_are_exact_and_never_stop_the_job(spark):
    big = "9" * 20
    items = spark.createDataFrame(
        [("d", 0, "x", "1000000", "0,00001", "10,00", "7 %", "10,70"), ("d", 1, "x", "1", "1,00", "99,123456", "0 %", "x"),
         ("d", 2, "x", big, "1,00", f"{big},00", "5 %", "1"), ("d", 3, "x", big, big, "1", "7 %", "1"),
         ("d", 4, "x", "-2", "1,5", "-3", "100 %", "-5,00")], ITEM)
    got = {(r.rule_name[5:8], r.target[5]): r for r in rules.item_findings(items).collect()}
    tell = lambda r: (r.outcome, r.expected, r.observed)
    assert got["net", "0"].outcome == "pass" and got["gro", "0"].outcome == "pass"
    assert tell(got["net", "1"]) == ("fail", "1.00", "99.123456")
    assert got["net", "2"].outcome == "pass"
    assert tell(got["gro", "2"]) == ("fail", "104999999999999999998.9500", "1")
    assert got["net", "3"].outcome == "not_applicable" and got["net", "3"].reason == "amount beyond 38 digits"
    assert tell(got["net", "4"]) == ("pass", None, None)
    assert tell(got["gro", "4"]) == ("pass", None, None)
    totals = spark.createDataFrame([("a", "99999999999999999,99"), ("a", "1,00"), ("b", "2,50")], "doc_id string, item_gross_worth string")
    assert {r.doc_id: r.total_amount_minor for r in upkeep.invoice_totals(totals).collect()} == {"a": 100, "b": 250}


def test_duplicate_groups_have_one_form_at_every_size(spark):
    rows = [(f"d{i}", i, "1", "2", "3") for i in range(5000)] + [(f"p{i}", 6000 + i, "4", "2", "3") for i in range(2)]
    rows += [("e", 7000, "9", "2", "3"), ("f", 7001, None, "2", "3")]
    header = spark.createDataFrame(rows, "doc_id string, batch_index int, invoice_no string, seller_tax_id string, invoice_date string")
    got = {r.doc_id: r for r in rules.duplicate_findings(header).collect()}
    text = "duplicate (invoice_no, seller_tax_id, invoice_date) with {} other record(s)"
    assert all(got[f"d{i}"].reason == text.format(4999) and got[f"d{i}"].outcome == "fail" for i in range(5000))
    assert got["p0"].reason == text.format(1) and got["p0"].observed == "4 / 2 / 3"
    assert got["e"].outcome == "pass" and got["f"].outcome == "not_applicable"
    assert rules.duplicate_members(header).count() == 5002
    others = rules.other_members(header, spark.createDataFrame([("p0",), ("e",)], "doc_id string")).collect()
    assert [(r.doc_id, r.other_index, r.other_doc_id) for r in others] == [("p0", 6001, "p1")]
