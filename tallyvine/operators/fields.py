"""Header fields from positioned lines.

Every step groups or joins on ``doc_id`` plus, where rows meet rows, a second
key, so no step needs a whole document in one task. "First line that ..." is a
``min_by`` over ``line_no``, which combines before the shuffle. ``line_no`` is
dense within a document (see ``explode_pages``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.functions import patterns as P
from tallyvine.functions.labels import contains_label, may_contain_label, structural_label
from tallyvine.functions.text import line_form, respace, strip
from tallyvine.session import materialise

# The seven fields in order, and the confidence of each way to find one.
FIELD_ORDER: tuple[str, ...] = (
    "invoice_no", "invoice_date", "iban", "seller_tax_id", "client_tax_id", "seller", "client",
)
CONFIDENCE = {"anchored": 0.95, "column": 0.90, "bare": 0.70, "aggregate": 0.75, "none": 0.0}
ANCHOR_KEYS: tuple[str, ...] = ("seller", "client", "items_start", "summary_start")


def center_x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2.0


def label_lines(lines: DataFrame) -> DataFrame:
    """Add ``label``: which structural label the line is, null for none."""
    # The form compared is a column of its own, so that it is worked out once a line and not in every test.
    formed = lines.withColumn("__low", line_form(F.col("text")))
    return formed.withColumn("label", structural_label(F.col("text"), ANCHOR_KEYS, F.col("__low"))).drop("__low")


def find_anchors(labelled: DataFrame) -> DataFrame:
    """Per document: where its labels are, the centre of the party labels, the page size.

    The anchor row of a label is the y0 of its first line; its centre comes from
    the last line with that y0. Lines are first reduced per (document, label,
    y0), which leaves a handful of rows per document, and those per document.
    Both steps combine before the shuffle. Documents without labels keep a row.
    """
    per_row = labelled.groupBy(
        "doc_id", "label", F.when(F.col("label").isNotNull(), F.col("y0")).alias("y")
    ).agg(
        F.min("line_no").alias("first_no"),
        F.max_by(center_x(), F.col("line_no")).alias("cx"),
        F.max("page_width").alias("page_width"),
        F.max("page_height").alias("page_height"),
    )

    def of(key: str, column: str) -> Column:
        mine = F.col("label") == key
        return F.min_by(F.when(mine, F.col(column)), F.when(mine, F.col("first_no")))

    return per_row.groupBy("doc_id").agg(
        *[of(k, "y").alias(f"{k}_y") for k in ANCHOR_KEYS],
        *[of(k, "cx").alias(f"{k}_cx") for k in ("seller", "client")],
        F.max("page_width").alias("page_width"),
        F.max("page_height").alias("page_height"),
    )


def choose_split(anchors: DataFrame) -> DataFrame:
    """Add ``split_x``: midway between the two party labels, else half the page."""
    midway = (F.col("seller_cx") + F.col("client_cx")) / 2.0
    return anchors.withColumn("split_x", F.coalesce(midway, F.col("page_width") / 2.0))


def party_lines(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines of the party block with their side; the anchor lines have no text.

    The block is cut out by position first; only its lines are tested for labels.
    Anchor lines stay as rows without text: a filter on the label would make Spark
    compute it again below the projection.
    """
    joined = lines.select("doc_id", "line_no", "text", "x0", "x1", "y0").join(
        layout.select(
            "doc_id", "seller_y", "client_y",
            F.least("seller_y", "client_y").alias("block_top"), "items_start_y", "split_x",
        ).where("block_top is not null"),
        "doc_id",
    )
    in_block = (F.col("y0") >= F.col("block_top")) & (
        F.col("items_start_y").isNull() | (F.col("y0") < F.col("items_start_y"))
    )
    party_label = structural_label(F.col("text"), ("seller", "client"))
    block = joined.where(in_block).select(
        "doc_id", "line_no", "text", "y0", "seller_y", "client_y",
        F.when(center_x() < F.col("split_x"), "left").otherwise("right").alias("side"),
        party_label.alias("label"),
    )
    own_label = ((F.col("label") == "seller") & (F.col("y0") == F.col("seller_y"))) | (
        (F.col("label") == "client") & (F.col("y0") == F.col("client_y"))
    )
    text = F.when(~F.coalesce(own_label, F.lit(False)), F.col("text"))
    return block.select("doc_id", "line_no", text.alias("text"), "label", "side")


def _candidate(
    name: str | Column, value: Column, tier: int | Column, confidence: Column | float,
    detail: str | Column, source: str = "regex", line_no: Column | None = None,
) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(name).alias("name"),
        lit(tier).alias("tier"),
        (F.col("line_no") if line_no is None else line_no).alias("line_no"),
        value.alias("value"),
        lit(confidence).alias("confidence"),
        lit(source).alias("source"),
        lit(detail).alias("source_detail"),
    )


def _explode_candidates(df: DataFrame, options: list[Column]) -> DataFrame:
    kept = F.filter(F.array(*options), lambda s: s["value"].isNotNull())
    return df.select("doc_id", F.inline(kept))


def line_candidates(lines: DataFrame) -> DataFrame:
    """Values found by a pattern on a line, and bare ones on the line after a fitting label.

    One pass over the lines. A line counts for itself (its pattern values, and its text
    where it may be a label) and, with its bare number and date, for the line before.
    What is left of a document is a few rows; the two kinds meet in an aggregate on
    document and line number, so a very long document spreads over many tasks. The
    exact fuzzy test runs on the pairs only.
    """
    text = F.col("text")
    kept = ("invoice_no", "invoice_date", "iban", "iban_bare", "label_text")
    following = ("number", "date")
    names = (*kept[:4], "text", *following)
    # Columns of their own, each worked out once a row: what stands in the generator is only put together there.
    valued = lines.select(
        "doc_id", "line_no",
        P.find(text, P.INVOICE_NO).alias("invoice_no"), P.find(text, P.DATE_ANCHORED).alias("invoice_date"),
        F.upper(P.find(text, P.IBAN_ANCHORED)).alias("iban"), F.upper(P.find(text, P.IBAN_BARE)).alias("iban_bare"),
        F.when(may_contain_label(text, "invoice_no") | may_contain_label(text, "date"), text).alias("label_text"),
        P.find(text, P.INVOICE_NO_BARE).alias("number"), P.find(text, P.DATE_BARE).alias("date"),
    )
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("line_no").alias("line_no"), *[F.col(k).alias(n) for k, n in zip(kept, names)], *[none.alias(n) for n in following]
    )
    before = F.struct(
        (F.col("line_no") - 1).alias("line_no"), *[none.alias(n) for n in names[:5]], *[F.col(n).alias(n) for n in following]
    )
    some, next_some = F.coalesce(*kept).isNotNull(), F.coalesce(*following).isNotNull()
    rows = F.when(some & next_some, F.array(own, before)).when(some, F.array(own)).when(next_some, F.array(before))
    found = valued.select("doc_id", F.inline(rows))
    met = found.groupBy("doc_id", "line_no").agg(*[F.max(n).alias(n) for n in names])
    sure, bare = CONFIDENCE["anchored"], CONFIDENCE["bare"]
    number, date = F.col("number"), F.col("date")
    options = [
        _candidate("invoice_no", F.col("invoice_no"), 0, sure, "invoice_no anchor"),
        _candidate("invoice_date", F.col("invoice_date"), 0, sure, "date anchored"),
        _candidate("iban", F.col("iban"), 0, sure, "IBAN anchored"),
        _candidate("iban", F.col("iban_bare"), 1, bare, "IBAN bare"),
        _candidate(
            "invoice_no", F.when(number.isNotNull() & contains_label(text, "invoice_no"), number),
            1, bare, "invoice_no bare (following anchor)",
        ),
        _candidate(
            "invoice_date", F.when(date.isNotNull() & contains_label(text, "date"), date),
            1, bare, "date bare (following anchor)",
        ),
    ]
    return _explode_candidates(met, options)


def is_tax_id_line(text: Column) -> Column:
    """The line is mainly a tax id: labelled, or hardly longer than the id."""
    bare = P.find(text, P.TAX_ID_BARE)
    return (
        (P.may_hold(text, P.TAX_ID_ANCHORED) & text.rlike(P.TAX_ID_ANCHORED))
        | F.coalesce(F.length(strip(text)) <= F.length(bare) + 4, F.lit(False))
        | contains_label(text, "tax_id")
    )


def is_iban_line(text: Column) -> Column:
    return (P.may_hold(text, P.IBAN_ANCHORED) & text.rlike(P.IBAN_ANCHORED)) | contains_label(text, "iban")


def party_values(block: DataFrame) -> DataFrame:
    """Tax id and address of either party, from one pass over its column.

    Per line: a tax id, labelled or bare, and whether the line is address text.
    Address text is what remains without blank lines, party labels, tax-id and
    bank lines; it is joined in line order.
    """
    text = F.col("text")
    anchored, bare = P.find(text, P.TAX_ID_ANCHORED), P.find(text, P.TAX_ID_BARE)
    is_party_label = F.coalesce(F.col("label").isin("seller", "client"), F.lit(False))
    address = ~is_party_label & (strip(text) != "") & ~is_tax_id_line(text) & ~is_iban_line(text)
    per_line = block.select(
        "doc_id", "side", "line_no",
        F.coalesce(anchored, bare).alias("tax_id"),
        F.when(anchored.isNotNull(), 0).otherwise(1).alias("tier"),
        F.when(address, strip(text)).alias("part"),
    )
    best = F.min_by(
        F.struct("tax_id", "tier", "line_no"),
        F.when(F.col("tax_id").isNotNull(), F.struct("tier", "line_no")),
    )
    return per_line.groupBy("doc_id", "side").agg(
        best.alias("tax"),
        F.expr("listagg(part, ' ') within group (order by line_no)").alias("joined"),
    )


def _address() -> Column:
    return _candidate(
        F.when(F.col("side") == "left", "seller").otherwise("client"),
        respace(F.col("joined")), 0, CONFIDENCE["aggregate"],
        "column-aggregated address + space-normalised", source="column_heuristic",
        line_no=F.lit(0),
    )


def party_candidates(parties: DataFrame) -> DataFrame:
    """Tax ids and addresses as candidates, from one read of the parties."""
    tier = F.col("tax.tier")
    anchored = tier == 0
    left = F.col("side") == "left"
    tax = _candidate(
        F.when(left, "seller_tax_id").otherwise("client_tax_id"), F.col("tax.tax_id"), tier,
        F.when(anchored, CONFIDENCE["column"]).otherwise(CONFIDENCE["bare"]),
        F.when(anchored, "tax_id anchored in column").otherwise("tax_id bare in column"),
        line_no=F.col("tax.line_no"),
    )
    return _explode_candidates(parties, [tax, _address()])


def first_candidate(candidates: DataFrame) -> DataFrame:
    """Best candidate per document and field: lowest tier, then first line."""
    best = F.min_by(
        F.struct("value", "confidence", "source", "source_detail"), F.struct("tier", "line_no")
    ).alias("best")
    return candidates.groupBy("doc_id", "name").agg(best).select("doc_id", "name", "best.*")


def assemble_fields(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seven rows per document; a field that was not found has source ``none``.

    Candidates and documents meet in one aggregate per document.
    """
    rows = docs.select("doc_id").unionByName(candidates, allowMissingColumns=True)
    best = [
        F.min_by(
            F.struct("value", "confidence", "source", "source_detail"),
            F.when(F.col("name") == n, F.struct("tier", "line_no")),
        ).alias(n)
        for n in FIELD_ORDER
    ]
    full = F.array(*[
        F.struct(
            F.lit(n).alias("name"),
            F.col(f"{n}.value").alias("value"),
            F.coalesce(F.col(f"{n}.confidence"), F.lit(CONFIDENCE["none"])).alias("confidence"),
            F.coalesce(F.col(f"{n}.source"), F.lit("none")).alias("source"),
            F.col(f"{n}.source_detail").alias("source_detail"),
        )
        for n in FIELD_ORDER
    ])
    return rows.groupBy("doc_id").agg(*best).select("doc_id", F.inline(full))


def document_layout(lines: DataFrame) -> DataFrame:
    """One row per document: anchors of its labels, page size, split of the columns."""
    return choose_split(find_anchors(label_lines(lines)))


def extract_fields(lines: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """All header fields of all documents; ``layout`` where it is already there, else it is worked out once and written."""
    layout = materialise(document_layout(lines), "layout") if layout is None else layout
    parties = party_values(party_lines(lines, layout))
    return assemble_fields(layout, line_candidates(lines).unionByName(party_candidates(parties)))


def field_diagnostics(lines: DataFrame) -> DataFrame:
    """One row per document: split, anchors, line counts of the two columns. The layout, read twice, is worked out once and written."""
    layout = materialise(document_layout(lines), "layout")
    counts = party_lines(lines, layout).where("text is not null").groupBy("doc_id").agg(
        F.count_if(F.col("side") == "left").alias("left_count"),
        F.count_if(F.col("side") == "right").alias("right_count"),
    )
    zero = F.lit(0).cast("bigint")
    return layout.join(counts, "doc_id", "left").select(
        "doc_id",
        F.col("split_x").alias("column_split_x"),
        F.col("seller_y").alias("seller_anchor_y"),
        F.col("client_y").alias("client_anchor_y"),
        "items_start_y",
        F.coalesce("left_count", zero).alias("left_line_count"),
        F.coalesce("right_count", zero).alias("right_line_count"),
    )


def header_wide(fields: DataFrame) -> DataFrame:
    """One row per document with a column per field (one partial aggregate)."""
    return fields.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in FIELD_ORDER]
    )
