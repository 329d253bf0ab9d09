"""Detection shaping, labels, header fields and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvine.functions import labels as L
from tallyvine.functions import patterns as P
from tallyvine.functions import text as T
from tallyvine.operators import fields as X
from tallyvine.operators import items as I
from tallyvine.operators import ocr as O
from tallyvine.session import materialise
from verification.registry import query

def written_lines(g):
    """The page lines, built once and written, for queries that read them more than once."""
    return materialise(g.ocr_line, "lines")


# --- detections ------------------------------------------------------------------


def detections(g):
    """Document lines as recogniser output: a corner polygon and a text score."""
    left, right, top, bottom = (F.col(c) for c in ("left_x", "right_x", "top_y", "bottom_y"))
    corners = F.array(
        F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom)
    )
    return g.text_line.select(
        "doc_id", "line_no", "text", "score", corners.alias("polygon"),
        F.lit(900).alias("page_width"), F.lit(1200).alias("page_height"),
    )


TL = ("text_line",)
CONF = "CASE WHEN try_cast(score as double) IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, try_cast(score as double))) END"


@query(
    "o01_kept_detections",
    """SELECT doc_id, line_no, text, coalesce(try_cast(score as double), 0.0) AS score
    FROM text_line WHERE length(text) > 0""", TL,
)
def _(g):
    return O.drop_empty_detections(detections(g)).select("doc_id", "line_no", "text", "score")


@query(
    "o01_page_records",
    """SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 as int) AS line_no, text
    FROM text_line WHERE length(text) > 0""", TL,
)
def _(g):
    corner = F.array(F.lit(0.0), F.lit(0.0))
    pages = g.documents.select(
        F.concat(F.lit("txt-"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.lit(900).alias("page_width"), F.lit(1200).alias("page_height"),
        F.transform(
            F.split("text", "\n"),
            lambda t: F.struct(
                F.array(corner).alias("polygon"), t.alias("text"), F.lit("0.9").alias("score")
            ),
        ).alias("detections"),
    )
    return O.explode_pages(pages).select("doc_id", "line_no", "text")


@query(
    "o02_bounding_boxes",
    """SELECT doc_id, line_no, left_x AS x0, top_y AS y0, right_x AS x1, bottom_y AS y1
    FROM text_line WHERE length(text) > 0""", TL,
)
def _(g):
    return O.shape_lines(detections(g)).select("doc_id", "line_no", "x0", "y0", "x1", "y1")


@query("o03_confidence", f"SELECT doc_id, line_no, {CONF} AS confidence FROM text_line WHERE length(text) > 0", TL)
def _(g):
    return O.shape_lines(detections(g)).select("doc_id", "line_no", "confidence")


TOKENS = f"""words AS (SELECT doc_id, line_no, left_x, right_x, top_y, bottom_y, {CONF} AS confidence,
    list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws
  FROM text_line WHERE length(text) > 0),
word AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM words),
token AS (SELECT doc_id, line_no, cast(k - 1 as int) AS token_no, ws[k] AS text,
    left_x + (cast(start as double) / total) * (right_x - left_x) AS x0, top_y AS y0,
    left_x + (cast(start + length(ws[k]) as double) / total) * (right_x - left_x) AS x1,
    bottom_y AS y1, confidence
  FROM (SELECT *, length(list_aggregate(ws[1:k], 'string_agg', ' ')) - length(ws[k]) AS start,
      length(list_aggregate(ws, 'string_agg', ' ')) AS total FROM word))"""


@query("o04_tokens", "SELECT * FROM token", TL, TOKENS)
def _(g):
    return O.split_tokens(O.shape_lines(detections(g))).drop("polygon")


@query(
    "o05_box_sizes",
    """SELECT doc_id, line_no, right_x - left_x AS width, bottom_y - top_y AS height,
    right_x >= left_x AND bottom_y >= top_y AS ordered FROM text_line WHERE length(text) > 0""", TL,
)
def _(g):
    return O.with_box_size(O.shape_lines(detections(g))).select(
        "doc_id", "line_no", "width", "height", O.box_is_ordered().alias("ordered")
    )


@query(
    "o06_input_contract",
    """SELECT doc_id, CASE WHEN invoice_id = '' THEN 'empty id' WHEN inline IS NOT NULL AND uri IS NOT NULL
      THEN 'both inline bytes and uri' WHEN inline IS NULL AND uri IS NULL THEN 'neither inline bytes nor uri'
      WHEN mime NOT IN ('application/pdf', 'image/png', 'image/jpeg', 'image/tiff', 'image/webp')
      THEN 'content type not allowed' END AS defect
    FROM (SELECT doc_id, CASE WHEN source = 'src9' THEN '' ELSE source END AS invoice_id,
      CASE WHEN lang <> 'de' THEN text END AS inline, CASE WHEN lang IN ('de', 'es') AND n_chars > 500 THEN source END AS uri,
      CASE WHEN source = 'src3' THEN 'text/html' ELSE 'image/png' END AS mime FROM documents)""",
)
def _(g):
    rows = g.documents.select(
        "doc_id",
        F.when(F.col("source") == "src9", "").otherwise(F.col("source")).alias("invoice_id"),
        F.when(F.col("lang") != "de", F.col("text")).alias("inline"),
        F.when(F.col("lang").isin("de", "es") & (F.col("n_chars") > 500), F.col("source")).alias("uri"),
        F.when(F.col("source") == "src3", "text/html").otherwise("image/png").alias("mime"),
    )
    defect = O.input_defect(F.col("invoice_id"), F.col("inline"), F.col("uri"), F.col("mime"))
    return rows.select("doc_id", defect.alias("defect"))


STATS = f"""SELECT doc_id, count(*) AS line_count,
  cast(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) as bigint) AS token_count,
  avg({CONF}) AS avg_confidence FROM text_line WHERE length(text) > 0 GROUP BY 1"""


def stats(g):
    lines = O.shape_lines(detections(g))
    return O.document_stats(lines, O.split_tokens(lines))


@query("o07_document_stats", STATS, TL)
def _(g):
    return stats(g)


@query(
    "o07_corpus_stats",
    f"""SELECT count(*) AS doc_count, cast(sum(line_count) as bigint) AS line_count,
    cast(sum(token_count) as bigint) AS token_count, avg(line_count) AS avg_lines FROM ({STATS})""", TL,
)
def _(g):
    return O.corpus_stats(stats(g))


@query("o07_index_range", "SELECT doc_id, lang FROM documents WHERE doc_id >= 100 AND doc_id < 300")
def _(g):
    # The sampling range is the operator's own feature.
    return O.index_range(g.documents, "doc_id", 100, 200).select("doc_id", "lang")


# --- labels and patterns ------------------------------------------------------------

# Longest common subsequence of pairs(a, b), one row of the table per step.
LCS = """dp(a, b, i, r) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM pairs
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(
    range(1, j + 1), lambda k: CASE WHEN k > 1 AND substr(b, k - 1, 1) = substr(a, i + 1, 1)
      THEN r[k - 1] + 1 ELSE r[k] END)))
  FROM dp WHERE i < length(a)),
lcs AS (SELECT a, b, r[length(b) + 1] AS n FROM dp WHERE i = length(a))"""


def variants(*keys: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k in keys for v in dict.fromkeys(x.lower() for x in L.LABELS[k]))
    return f"variant(key, v) AS (VALUES {rows})"


def label_ctes(keys=("seller", "client", "items_start", "summary_start")) -> str:
    """hit(text, key): lines that are just the label. Labels consist of letters,
    so a text without any letter cannot reach the threshold."""
    return f"""{variants(*keys)},
    short AS (SELECT DISTINCT text, lower(trim(text)) AS low FROM ocr_line
      WHERE length(trim(text)) <= 14 AND regexp_matches(lower(text), '[a-z]')),
    pairs AS (SELECT DISTINCT low AS a, v AS b FROM short JOIN variant ON length(low) <= length(v) + 4),
    {LCS},
    hit AS (SELECT DISTINCT text, key FROM short JOIN variant ON length(low) <= length(v) + 4
      JOIN lcs ON a = low AND b = v WHERE 200 * n >= 85 * (length(a) + length(b)))"""


def contain_ctes(source: str, keys: tuple[str, ...], prefix: str = "c_") -> str:
    """{prefix}hit(text, key): lines of ``source`` that contain the label. The shorter
    string is laid over every stretch of the longer one, cut off at its ends too."""
    p = prefix
    lcs = LCS.replace("dp(", f"{p}dp(").replace("FROM dp", f"FROM {p}dp").replace(
        "FROM pairs", f"FROM {p}pairs").replace("lcs AS", f"{p}lcs AS")
    return f"""{variants(*keys).replace('variant(', p + 'variant(')},
    {p}text AS (SELECT DISTINCT text, lower(trim(text)) AS low FROM ({source}) WHERE trim(text) <> ''),
    {p}side AS (SELECT text, key, low AS q, v AS p FROM {p}text, {p}variant WHERE length(low) >= length(v)
      UNION ALL SELECT text, key, v AS q, low AS p FROM {p}text, {p}variant WHERE length(low) <= length(v)),
    {p}start AS (SELECT *, unnest(range(2 - length(p), length(q) + 1)) AS s FROM {p}side),
    {p}part AS (SELECT text, key, p, substr(q, greatest(s, 1), least(s + length(p) - 1, length(q)) - greatest(s, 1) + 1)
      AS w FROM {p}start),
    {p}fit AS (SELECT * FROM {p}part WHERE 200 * least(length(w), length(p)) >= 85 * (length(w) + length(p))),
    {p}pairs AS (SELECT DISTINCT w AS a, p AS b FROM {p}fit),
    {lcs},
    {p}hit AS (SELECT DISTINCT text, key FROM {p}fit JOIN {p}lcs ON a = w AND b = p
      WHERE 200 * n >= 85 * (length(a) + length(b)))"""


OL = ("ocr_line",)
FLAGS = ", ".join(
    f"text IN (SELECT text FROM hit WHERE key = '{k}') AS is_{k}" for k in X.ANCHOR_KEYS
)


@query("f01_label_lines", f"SELECT doc_id, line_no, {FLAGS} FROM ocr_line", OL, label_ctes())
def _(g):
    return g.ocr_line.select(
        "doc_id", "line_no", *[L.is_label(F.col("text"), k).alias(f"is_{k}") for k in X.ANCHOR_KEYS]
    )


@query(
    "f02_contained_labels",
    """SELECT DISTINCT l.text, l.text IN (SELECT text FROM c_hit WHERE key = 'iban') AS has_iban,
      l.text IN (SELECT text FROM c_hit WHERE key = 'date') AS has_date FROM ocr_line l""",
    OL, contain_ctes("SELECT text FROM ocr_line WHERE regexp_matches(lower(text), '[a-z]')", ("iban", "date")),
)
def _(g):
    texts = g.line_text.distinct()
    text = F.col("text")
    return texts.select(
        "text", L.contains_label(text, "iban").alias("has_iban"),
        L.contains_label(text, "date").alias("has_date"),
    )


@query(
    "f03_label_dictionary",
    "SELECT text, key, count(*) AS lines FROM ocr_line JOIN hit USING (text) GROUP BY 1, 2",
    OL, label_ctes(tuple(L.LABELS)),
)
def _(g):
    texts = g.ocr_line.where(L.may_be_label("text", tuple(L.LABELS))).groupBy("text").agg(F.count("*").alias("lines"))
    keys = F.array(*[F.when(L.is_label(F.col("text"), k), F.lit(k)) for k in L.LABELS])
    return texts.select("text", F.explode(keys).alias("key"), "lines").where("key is not null")


RESPACE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g'), '([,.;])([^\s])', '\1 \2', 'g'), ' {{2,}}', ' ', 'g'))"""


@query(
    "f04_respaced_lines",
    f"SELECT doc_id, line_no, {RESPACE.format('text')} AS respaced FROM ocr_line", OL,
)
def _(g):
    return g.ocr_line.select("doc_id", "line_no", T.respace(F.col("text")).alias("respaced"))


def _pattern_query(name: str, pattern: str, upper: bool = False):
    value = f"nullif(regexp_extract(text, '{pattern}', 1), '')"
    value = f"upper({value})" if upper else value
    # The page lines, and every line of the documents.
    sql = f"""SELECT doc_id, line_no, {value} AS value FROM
      (SELECT doc_id, line_no, text FROM ocr_line UNION ALL SELECT doc_id, line_no, text FROM text_line)"""

    @query(name, sql, ("ocr_line", "text_line"))
    def _(g):
        lines = g.ocr_line.select("doc_id", "line_no", "text").unionByName(
            g.text_line.select("doc_id", "line_no", "text")
        )
        found = P.find(F.col("text"), pattern)
        return lines.select("doc_id", "line_no", (F.upper(found) if upper else found).alias("value"))


_pattern_query("f05_invoice_no", P.INVOICE_NO)
_pattern_query("f06_invoice_no_bare", P.INVOICE_NO_BARE)
_pattern_query("f07_date_anchored", P.DATE_ANCHORED)
_pattern_query("f08_date_bare", P.DATE_BARE)
_pattern_query("f09_tax_id_anchored", P.TAX_ID_ANCHORED)
_pattern_query("f10_tax_id_bare", P.TAX_ID_BARE)
_pattern_query("f11_iban_anchored", P.IBAN_ANCHORED, upper=True)
_pattern_query("f11_iban_bare", P.IBAN_BARE, upper=True)


# --- header fields ------------------------------------------------------------------

ANCHORS = ", ".join(f"arg_min(y0, line_no) FILTER (WHERE is_{k}) AS {k}_y" for k in X.ANCHOR_KEYS)
LAYOUT = f"""{label_ctes()},
flagged AS MATERIALIZED (SELECT *, {FLAGS} FROM ocr_line),
anchor AS MATERIALIZED (SELECT doc_id, {ANCHORS}, max(page_width) AS page_width, max(page_height) AS page_height
  FROM flagged GROUP BY 1),
centre AS (SELECT f.doc_id,
    arg_max((x0 + x1) / 2, line_no) FILTER (WHERE is_seller AND y0 = seller_y) AS s_cx,
    arg_max((x0 + x1) / 2, line_no) FILTER (WHERE is_client AND y0 = client_y) AS c_cx
  FROM flagged f JOIN anchor a USING (doc_id) GROUP BY 1),
layout AS (SELECT a.*, coalesce((s_cx + c_cx) / 2, page_width / 2.0) AS split_x
  FROM anchor a LEFT JOIN centre USING (doc_id)),
block AS (SELECT f.doc_id, line_no, text, is_seller, is_client,
    CASE WHEN (x0 + x1) / 2 < split_x THEN 'left' ELSE 'right' END AS side
  FROM flagged f JOIN layout USING (doc_id)
  WHERE coalesce(least(seller_y, client_y)) IS NOT NULL AND y0 >= least(seller_y, client_y)
    AND (items_start_y IS NULL OR y0 < items_start_y)
    AND NOT coalesce(is_seller AND y0 = seller_y, false) AND NOT coalesce(is_client AND y0 = client_y, false))"""


@query("x01_anchor_rows", "SELECT * FROM anchor", OL, LAYOUT)
def _(g):
    return X.find_anchors(X.label_lines(g.ocr_line)).drop("seller_cx", "client_cx")


def layout(g):
    lines = written_lines(g)
    return lines, X.document_layout(lines)


@query("x02_column_split", "SELECT doc_id, split_x FROM layout", OL, LAYOUT)
def _(g):
    return X.document_layout(g.ocr_line).select("doc_id", "split_x")


@query("x03_party_lines", "SELECT doc_id, line_no, side FROM block", OL, LAYOUT)
def _(g):
    return X.party_lines(*layout(g)).where("text is not null").select("doc_id", "line_no", "side")


def found(expr_pattern: str, upper: bool = False) -> str:
    value = f"nullif(regexp_extract(text, '{expr_pattern}', 1), '')"
    return f"upper({value})" if upper else value


NEXT = f"""nxt AS (SELECT doc_id, line_no, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_text
  FROM ocr_line),
bare AS (SELECT doc_id, line_no, text, nullif(regexp_extract(next_text, '{P.INVOICE_NO_BARE}', 1), '') AS number,
    nullif(regexp_extract(next_text, '{P.DATE_BARE}', 1), '') AS date FROM nxt),
before AS (SELECT * FROM bare WHERE number IS NOT NULL OR date IS NOT NULL),
{contain_ctes("SELECT text FROM before", ("invoice_no", "date"), "n_")},
cand AS (
  SELECT doc_id, line_no, 'invoice_no' AS name, 0 AS tier, {found(P.INVOICE_NO)} AS value, 0.95 AS confidence,
    'invoice_no anchor' AS source_detail FROM ocr_line
  UNION ALL SELECT doc_id, line_no, 'invoice_date', 0, {found(P.DATE_ANCHORED)}, 0.95, 'date anchored' FROM ocr_line
  UNION ALL SELECT doc_id, line_no, 'iban', 0, {found(P.IBAN_ANCHORED, True)}, 0.95, 'IBAN anchored' FROM ocr_line
  UNION ALL SELECT doc_id, line_no, 'iban', 1, {found(P.IBAN_BARE, True)}, 0.7, 'IBAN bare' FROM ocr_line
  UNION ALL SELECT doc_id, line_no, 'invoice_no', 1, number, 0.7, 'invoice_no bare (following anchor)' FROM before
    WHERE text IN (SELECT text FROM n_hit WHERE key = 'invoice_no')
  UNION ALL SELECT doc_id, line_no, 'invoice_date', 1, date, 0.7, 'date bare (following anchor)' FROM before
    WHERE text IN (SELECT text FROM n_hit WHERE key = 'date'))"""
BEST = """SELECT doc_id, name, value, cast(confidence as double) AS confidence, 'regex' AS source, source_detail
FROM cand WHERE value IS NOT NULL {0}
QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY tier, line_no) = 1"""


def page_candidates(g):
    return X.line_candidates(g.ocr_line)


for _name, _field in (("x04_invoice_no", "invoice_no"), ("x05_invoice_date", "invoice_date"), ("x06_iban", "iban")):

    @query(_name, BEST.format(f"AND name = '{_field}'"), OL, NEXT)
    def _(g, field=_field):
        return X.first_candidate(page_candidates(g).where(F.col("name") == field))


def parties(g):
    return X.party_candidates(X.party_values(X.party_lines(*layout(g))))


TAX = f"""tax AS (SELECT doc_id, line_no, CASE side WHEN 'left' THEN 'seller_tax_id' ELSE 'client_tax_id' END AS name,
    0 AS tier, {found(P.TAX_ID_ANCHORED)} AS value, 0.9 AS confidence, 'tax_id anchored in column' AS source_detail
  FROM block UNION ALL
  SELECT doc_id, line_no, CASE side WHEN 'left' THEN 'seller_tax_id' ELSE 'client_tax_id' END, 1,
    {found(P.TAX_ID_BARE)}, 0.7, 'tax_id bare in column' FROM block)"""


@query("x07_column_tax_ids", BEST.format("").replace("cand", "tax"), OL, f"{LAYOUT}, {TAX}")
def _(g):
    found = X.first_candidate(parties(g))
    return found.where("name in ('seller_tax_id', 'client_tax_id')")


PARTY = f"""{contain_ctes("SELECT text FROM block", ("tax_id", "iban"), "p_")},
party AS (SELECT *, regexp_matches(text, '{P.TAX_ID_ANCHORED}')
      OR coalesce(length(trim(text)) <= length({found(P.TAX_ID_BARE)}) + 4, false)
      OR text IN (SELECT text FROM p_hit WHERE key = 'tax_id') AS tax_line,
    regexp_matches(text, '{P.IBAN_ANCHORED}') OR text IN (SELECT text FROM p_hit WHERE key = 'iban') AS iban_line
  FROM block),
address AS (SELECT doc_id, CASE side WHEN 'left' THEN 'seller' ELSE 'client' END AS name,
    {RESPACE.format("string_agg(trim(text), ' ' ORDER BY line_no)")} AS value, 0.75 AS confidence,
    'column_heuristic' AS source, 'column-aggregated address + space-normalised' AS source_detail
  FROM party WHERE trim(text) <> '' AND NOT is_seller AND NOT is_client AND NOT tax_line AND NOT iban_line
  GROUP BY doc_id, side)"""


@query("x08_addresses", "SELECT * REPLACE (cast(confidence as double) AS confidence) FROM address", OL,
       f"{LAYOUT}, {PARTY}")
def _(g):
    return X.first_candidate(parties(g)).where("name in ('seller', 'client')")


@query("x09_id_lines", "SELECT doc_id, line_no, tax_line, iban_line FROM party", OL, f"{LAYOUT}, {PARTY}")
def _(g):
    return X.party_lines(*layout(g)).where("text is not null").select(
        "doc_id", "line_no", X.is_tax_id_line(F.col("text")).alias("tax_line"),
        X.is_iban_line(F.col("text")).alias("iban_line"),
    )


FOUND = f"""found AS ({BEST.format("")} UNION ALL {BEST.format("").replace("cand", "tax")}
  UNION ALL SELECT doc_id, name, value, confidence, source, source_detail FROM address),
fields AS (SELECT d.doc_id, n.name, value, coalesce(confidence, 0.0) AS confidence,
    coalesce(source, 'none') AS source, source_detail
  FROM anchor d CROSS JOIN (SELECT unnest({list(X.FIELD_ORDER)}) AS name) n
  LEFT JOIN found f ON f.doc_id = d.doc_id AND f.name = n.name)"""
ALL_FIELDS = f"{LAYOUT}, {TAX}, {PARTY}, {NEXT}, {FOUND}"


@query("x10_fields", "SELECT * REPLACE (cast(confidence as double) AS confidence) FROM fields", OL, ALL_FIELDS)
def _(g):
    return X.extract_fields(written_lines(g))


@query(
    "x10_diagnostics",
    """SELECT l.doc_id, split_x AS column_split_x, seller_y AS seller_anchor_y, client_y AS client_anchor_y, items_start_y,
    (SELECT count(*) FROM block b WHERE b.doc_id = l.doc_id AND side = 'left') AS left_line_count,
    (SELECT count(*) FROM block b WHERE b.doc_id = l.doc_id AND side = 'right') AS right_line_count FROM layout l""",
    OL, LAYOUT,
)
def _(g):
    return X.field_diagnostics(written_lines(g))


WIDE = ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {n}" for n in X.FIELD_ORDER)


@query("x11_wide_header", f"SELECT doc_id, {WIDE} FROM fields GROUP BY 1", OL, ALL_FIELDS)
def _(g):
    return X.header_wide(X.extract_fields(written_lines(g)))


@query(
    "f18_value_provenance",
    r"""SELECT f.doc_id, f.name, l.line_no FROM
    (SELECT doc_id, name, lower(regexp_replace(value, '\s+', '', 'g')) AS v FROM field WHERE value IS NOT NULL) f
    JOIN (SELECT doc_id, line_no, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM ocr_line) l
    ON f.doc_id = l.doc_id AND v <> '' AND t <> '' AND (contains(t, v) OR contains(v, t))""",
    ("ocr_line", "field"),
)
def _(g):
    return value_lines(g.field, g.ocr_line)


def value_lines(fields, lines):
    from tallyvine.operators.lookup import source_lines

    return source_lines(fields, lines).select("doc_id", "name", "line_no")


# --- line items -----------------------------------------------------------------------

ITEMS = rf"""{label_ctes()},
flagged AS MATERIALIZED (SELECT *, {FLAGS} FROM ocr_line),
anchor AS MATERIALIZED (SELECT doc_id, {ANCHORS}, max(page_width) AS page_width, max(page_height) AS page_height
  FROM flagged GROUP BY 1),
region AS MATERIALIZED (SELECT doc_id, items_start_y AS region_top, coalesce(summary_start_y, page_height) AS region_bottom,
  page_width FROM anchor WHERE items_start_y IS NOT NULL),
inside AS MATERIALIZED (SELECT l.*, region_top, region_bottom FROM ocr_line l JOIN region r USING (doc_id)
  WHERE y0 > region_top AND y0 < region_bottom),
numbers AS MATERIALIZED (SELECT doc_id, line_no AS anchor_line_no, x1 AS anchor_x1, y0 AS anchor_y0,
    greatest(4.0, greatest(1.0, y1 - y0) * 0.4) AS tol, region_bottom, page_width
  FROM inside WHERE regexp_matches(text, '{P.ITEM_NUMBER}')),
item_anchor AS MATERIALIZED (SELECT doc_id, anchor_line_no,
    cast(row_number() OVER w as int) - 1 AS item_index, anchor_x1, anchor_y0, anchor_y0 - tol AS band_top,
    anchor_y0 + tol AS band_bottom, coalesce(lead(anchor_y0 - tol) OVER w, region_bottom) AS limit_y, page_width
  FROM numbers WINDOW w AS (PARTITION BY doc_id ORDER BY anchor_y0, anchor_line_no)),
band AS MATERIALIZED (SELECT a.doc_id, item_index, line_no, trim(text) AS text, x0, anchor_x1,
    CASE WHEN regexp_matches(trim(text), '{P.DECIMAL_COMMA}') THEN 'decimal'
      WHEN regexp_matches(trim(text), '{P.VAT_PERCENT}') THEN 'vat'
      WHEN regexp_matches(trim(text), '{P.UNIT_OF_MEASURE}') THEN 'unit'
      WHEN x0 >= anchor_x1 THEN 'text' ELSE 'other' END AS kind
  FROM item_anchor a JOIN inside l ON l.doc_id = a.doc_id AND line_no <> anchor_line_no
    AND y0 BETWEEN band_top AND band_bottom),
vals AS (SELECT doc_id, item_index,
    list(text ORDER BY x0, line_no) FILTER (WHERE kind = 'decimal') AS decimals,
    min(x0) FILTER (WHERE kind = 'decimal') AS first_x,
    replace(arg_min(text, line_no) FILTER (WHERE kind = 'vat'), ' ', '') AS vat,
    list(text ORDER BY x0, line_no) FILTER (WHERE kind = 'text') AS words,
    min(x0) FILTER (WHERE kind = 'text') AS word_x
  FROM band GROUP BY 1, 2),
cols AS MATERIALIZED (SELECT a.*, decimals, vat, words[1] AS line_one, coalesce(word_x, anchor_x1 + 10) AS desc_left,
    coalesce(first_x - 10, page_width / 3.0) AS desc_right
  FROM item_anchor a LEFT JOIN vals v USING (doc_id, item_index)),
reach AS MATERIALIZED (SELECT *, unnest(range(cast(floor(band_bottom / 128) as int), cast(floor(limit_y / 128) as int) + 1)) AS slice FROM cols),
placed AS MATERIALIZED (SELECT doc_id, line_no, text, x0, y0, cast(floor(y0 / 128) as int) AS slice FROM inside),
below AS MATERIALIZED (SELECT c.doc_id, c.item_index, line_no, trim(text) AS text FROM reach c JOIN placed l
  ON l.doc_id = c.doc_id AND l.slice = c.slice AND line_no <> anchor_line_no AND y0 > band_bottom AND y0 < limit_y
    AND x0 >= desc_left - 20 AND x0 < desc_right),
tail AS (SELECT doc_id, item_index, string_agg(text, ' ' ORDER BY line_no) AS tail FROM below WHERE text <> '' GROUP BY 1, 2),
items AS (SELECT doc_id, item_index,
    CASE WHEN line_one IS NOT NULL OR tail IS NOT NULL THEN {RESPACE.format("concat_ws(' ', line_one, tail)")} END AS item_desc,
    decimals[1] AS item_qty, decimals[2] AS item_net_price, decimals[3] AS item_net_worth, vat AS item_vat,
    decimals[4] AS item_gross_worth
  FROM cols LEFT JOIN tail USING (doc_id, item_index))"""


def anchors(lines):
    return I.anchored_lines(lines)[1]


def banded(g):
    lines = written_lines(g)
    return I.item_lines(lines, anchors(lines))


@query("t01_item_regions", "SELECT doc_id, region_top, cast(region_bottom as double) AS region_bottom, page_width FROM region",
       OL, ITEMS)
def _(g):
    return I.item_regions(X.find_anchors(X.label_lines(g.ocr_line)))


@query("t02_item_numbers", "SELECT doc_id, anchor_line_no, item_index, anchor_y0 FROM item_anchor", OL, ITEMS)
def _(g):
    return anchors(written_lines(g)).select("doc_id", "anchor_line_no", "item_index", "anchor_y0")


@query("t03_item_limits", "SELECT doc_id, item_index, cast(limit_y as double) AS limit_y FROM item_anchor", OL, ITEMS)
def _(g):
    return anchors(written_lines(g)).select("doc_id", "item_index", "limit_y")


@query("t04_band_lines", "SELECT doc_id, item_index, line_no FROM band", OL, ITEMS)
def _(g):
    return banded(g).where("part = 'band'").select("doc_id", "item_index", "line_no")


@query("t05_line_kinds", "SELECT doc_id, item_index, line_no, kind, text FROM band", OL, ITEMS)
def _(g):
    return I.classify(banded(g)).where("kind <> 'below'").select("doc_id", "item_index", "line_no", "kind", "text")


@query(
    "t06_item_values",
    """SELECT doc_id, item_index, decimals[1] AS item_qty, decimals[2] AS item_net_price, decimals[3] AS item_net_worth,
    decimals[4] AS item_gross_worth, vat AS item_vat FROM cols""", OL, ITEMS,
)
def _(g):
    return I.assemble_items(described(g)).drop("item_desc")


def described(g):
    lines = written_lines(g)
    return I.item_details(lines, anchors(lines))


@query("t07_continuation_lines", "SELECT * FROM below", OL, ITEMS)
def _(g):
    return described(g).select("doc_id", "item_index", F.inline("continuation")).drop("x0")


@query("t08_items", "SELECT * FROM items", OL, ITEMS)
def _(g):
    return I.extract_items(written_lines(g))


@query(
    "t09_item_diagnostics",
    """SELECT doc_id, CASE WHEN items_start_y IS NULL THEN 'no ITEMS anchor' WHEN coalesce(n, 0) = 0 THEN 'no item anchors' END
      AS reason, items_start_y AS items_top_y, CASE WHEN items_start_y IS NOT NULL THEN summary_start_y END AS summary_top_y,
      CASE WHEN items_start_y IS NOT NULL THEN coalesce(n, 0) END AS anchor_count
    FROM anchor LEFT JOIN (SELECT doc_id, count(*) AS n FROM item_anchor GROUP BY 1) c USING (doc_id)""", OL, ITEMS,
)
def _(g):
    return I.item_diagnostics(written_lines(g))
