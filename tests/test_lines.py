"""Page lines derived from orders and order lines, and how queries read them."""

import re
from datetime import datetime

from tallyvine.operators.fields import field_diagnostics, label_lines, line_candidates
from tallyvine.operators.items import classify, item_diagnostics
from tallyvine.session import materialise
from verification import views
from verification.document_queries import banded
from verification.views import Given


class Ranked(views.SparkDialect):
    """The SQL that DuckDB runs, in Spark's spelling."""

    name = "duckdb"


def tables(spark, path):
    day = datetime(1996, 1, 2)
    statuses, priorities = "FOP", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    orders = [(k, 1 + k % 3, statuses[k % 3], 100.0 + k, day, priorities[k % 5]) for k in range(1, 16)]
    orders += orders[3:5] + [(None, 1, "F", 5.0, day, "2-HIGH"), (7, 2, "O", 9.0, day, "5-LOW"), (99, 1, None, 1.0, day, None)]
    items = [
        (k, 10 + i, 20 + i, i + 1, 1.0 + i, 10.0 * k + i, (i % 11) / 100, 0.05, "NAR"[i % 3], "OF"[i % 2], day)
        for k in range(1, 15) for i in range(k % 6)
    ]
    items += items[:3] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day), (9, None, None, 9, 2.0, 5.0, 0.01, 0.0, None, None, day)]
    spark.createDataFrame([(i, f"Customer{i}", i) for i in (1, 2, 3)], "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")


def test_lines_numbered_by_counting_are_those_numbered_by_rank(spark, tmp_path):
    tables(spark, tmp_path)
    given = Given(spark, str(tmp_path))
    ranked = spark.sql(f"WITH {views.ctes(Ranked(str(tmp_path)), 'ocr_line')} SELECT * FROM ocr_line")
    # Two orders share key 7 and their lines their slots: which comes first is open, so numbers and texts are compared apart.
    for drop in ("line_no", "text"):
        rows = [sorted(df.drop(drop, "y0", "y1").collect(), key=repr) for df in (given.ocr_line, ranked)]
        assert rows[0] == rows[1] and len(rows[0]) > 300
    own = "doc_id not in ('doc-7')"
    rows = [sorted(df.where(own).collect(), key=repr) for df in (given.ocr_line, ranked)]
    assert rows[0] == rows[1]


def test_lines_of_own_keys_are_not_ranked(spark, tmp_path):
    tables(spark, tmp_path)
    plan = Given(spark, str(tmp_path)).ocr_line._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith("Union") or "Union" in plan.split("Window")[0]


def test_queries_that_read_the_lines_twice_build_them_once(spark, tmp_path):
    tables(spark, tmp_path)
    plan = banded(Given(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_large_generated_methods_are_split(spark, tmp_path):
    Given(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def generators(df) -> list[str]:
    """The generators of a frame's plan, by which arrays become rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Generate " in line]


def test_patterns_of_a_line_are_worked_out_before_the_generator(spark, tmp_path):
    tables(spark, tmp_path)
    found = generators(line_candidates(materialise(Given(spark, str(tmp_path)).ocr_line, "lines")))
    assert found and not any("regexp_extract" in g or "lambda" in g for g in found[1:])


def test_diagnostics_work_out_the_layout_once(spark, tmp_path):
    tables(spark, tmp_path)
    lines = materialise(Given(spark, str(tmp_path)).ocr_line, "lines")
    for diagnostics in (item_diagnostics, field_diagnostics):
        plan = diagnostics(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert "max_by" not in plan.lower() and "items_start_y" in plan
        assert diagnostics(lines).count() == lines.select("doc_id").distinct().count()


def test_texts_without_numbers_need_no_ranks(spark, tmp_path):
    tables(spark, tmp_path)
    given = Given(spark, str(tmp_path))
    texts = given.line_text
    assert sorted(texts.collect()) == sorted(given.ocr_line.select("text").collect())
    assert "Union" not in texts._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1]


def test_only_orders_without_a_key_of_their_own_are_ranked(spark, tmp_path):
    tables(spark, tmp_path)
    given = Given(spark, str(tmp_path))
    odd = {r["odd"] for r in given.view("odd_order").collect()}
    ranked = {r["k"] for r in given.view("odd_page_lines").where("not exact").select("k").distinct().collect()}
    assert odd == ranked == {None, 4, 5, 7}


def test_line_form_is_a_column_of_its_own_before_the_label(spark):
    rows = [("d", i, t, 1.0, 2.0, 3.0, 900, 800) for i, t in enumerate([" SELLER: ", "Sel1er:", "1 234,50", "12%", None, "", "Total", "C­lient", "Kunde"])]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string, x0 double, y0 double, x1 double, page_width int, page_height int")
    labelled = label_lines(lines)
    assert labelled.columns == [*lines.columns, "label"]
    assert [r["label"] for r in labelled.orderBy("line_no").collect()] == ["seller", "seller", None, None, None, None, "summary_start", "client", None]
    project = next(p for p in labelled._jdf.queryExecution().optimizedPlan().toString().splitlines() if "label" in p)
    assert "btrim" not in project


def test_item_patterns_are_tried_only_where_they_may_match(spark):
    rows = [("d", 0, i, i, 10.0, t, "band", 0.0) for i, t in enumerate([" 1.234,50 ", "19 %", " each\n", "PCS", "Article,12", "5", "Unit", "each one"])]
    pairs = spark.createDataFrame(rows, "doc_id string, item_index int, line_no int, anchor_line_no int, x0 double, text string, part string, anchor_x1 double")
    out = classify(pairs)
    assert [r["kind"] for r in out.orderBy("line_no").collect()] == ["decimal", "vat", "unit", "unit", "text", "text", "unit", "text"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(text") == 2


def moved_columns(df):
    """Columns of each exchange in the plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    steps = df._jdf.queryExecution().explainString(mode).split("\n\n")
    return [re.findall(r"(\w+)#", s.split("Arguments")[0]) for s in steps if re.match(r"\(\d+\) Exchange", s)]


def test_lines_move_given_columns_and_not_what_is_made_of_them(spark, tmp_path):
    tables(spark, tmp_path)
    moved = moved_columns(Given(spark, str(tmp_path)).ocr_line)
    wide = [c for c in moved if "c_name" in c or "l_linenumber" in c]
    made = {"good_iban", "bad_iban", "invoice_no", "seller_tax_id", "shown_net", "price_c", "flag"}
    assert wide and not [c for c in wide if made & set(c)]


def test_ranked_lines_share_the_order_lines_moved_for_the_counted_ones(spark, tmp_path):
    tables(spark, tmp_path)
    lines = Given(spark, str(tmp_path)).ocr_line
    assert "LeftSemi" not in lines._jdf.queryExecution().optimizedPlan().toString()
    wide = [c for c in moved_columns(lines) if "l_linenumber" in c]
    assert len(wide) == 2 and wide[0] == wide[1]


def test_written_tables_are_packed_with_zstandard(spark):
    written = materialise(spark.range(5), "packed")
    assert sorted(r.id for r in written.collect()) == [0, 1, 2, 3, 4]
    assert all(f.endswith(".zstd.parquet") for f in written.inputFiles())
