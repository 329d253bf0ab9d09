"""Invoice-domain tables derived from the given tables, in SQL both engines run.

Each view is one SELECT written once. The dialect object supplies the few
constructs that are spelled differently. Every row of the given tables is used;
the special cases (missing labels, misspellings, wrong amounts) follow from
ordinary columns of the row.
"""

from __future__ import annotations

from collections.abc import Iterable

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class DuckDialect:
    name = "duckdb"

    def table(self, name: str) -> str:
        return name

    def ms(self, ts: str) -> str:
        return f"(epoch_us({ts}) // 1000)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def date(self, ts: str, fmt: str) -> str:
        duck = {"MM/dd/yyyy": "%m/%d/%Y", "dd-MM-yyyy": "%d-%m-%Y", "yyyy": "%Y"}[fmt]
        return f"strftime({ts}, '{duck}')"

    def sha(self, data: str) -> str:
        return f"sha256({data})"

    def blob(self, prefix_hex: str, text: str) -> str:
        return f"(from_hex('{prefix_hex}') || encode({text}))"

    def rows(self, keys: str, source: str, names: Iterable[str], rows: list[tuple]) -> str:
        items = ", ".join(
            "{" + ", ".join(f"'{n}': {e}" for n, e in zip(names, r)) + "}" for r in rows
        )
        return f"SELECT {keys}, unnest([{items}], recursive := true) FROM {source}"

    def split_lines(self, keys: str, text: str, source: str) -> str:
        parts = f"string_split({text}, chr(10))"
        return (
            f"SELECT {keys}, cast(i - 1 as int) AS line_no, {parts}[i] AS line "
            f"FROM (SELECT *, unnest(range(1, len({parts}) + 1)) AS i FROM {source})"
        )


class SparkDialect:
    name = "spark"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def ms(self, ts: str) -> str:
        return f"unix_millis(cast({ts} as timestamp))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def date(self, ts: str, fmt: str) -> str:
        return f"date_format({ts}, '{fmt}')"

    def sha(self, data: str) -> str:
        return f"sha2({data}, 256)"

    def blob(self, prefix_hex: str, text: str) -> str:
        return f"concat(unhex('{prefix_hex}'), cast({text} as binary))"

    def rows(self, keys: str, source: str, names: Iterable[str], rows: list[tuple]) -> str:
        items = ", ".join(
            "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in zip(names, r)) + ")" for r in rows
        )
        return f"SELECT {keys}, inline(array({items})) FROM {source}"

    def split_lines(self, keys: str, text: str, source: str) -> str:
        return (
            f"SELECT {keys}, posexplode(split({text}, '\\n')) AS (line_no, line) FROM {source}"
        )


def digits(value: str, width: int) -> str:
    return f"lpad(cast({value} as string), {width}, '0')"


def european(d, cents: str, sep: str = " ") -> str:
    """Cents as ``1 319,97``."""
    whole = d.idiv(cents, "100")
    return (
        f"concat(case when {whole} >= 1000 then concat(cast({d.idiv(whole, '1000')} as string), "
        f"'{sep}', {digits(f'({whole}) % 1000', 3)}) else cast({whole} as string) end, ',', "
        f"{digits(f'({cents}) % 100', 2)})"
    )


LI_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_returnflag AS flag, l_linestatus AS ls, l_shipdate,
      cast(l_quantity as bigint) AS qty,
      cast(round(l_extendedprice * 100) as bigint) AS net_c,
      cast(round(l_discount * 100) as int) AS disc,
      cast(round(l_tax * 100) as int) AS vat"""
LI_GIVEN = "l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax"
LI_ORDER = """partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"""


def _li(d):
    return f"""
    SELECT {LI_COLUMNS},
      cast(row_number() over ({LI_ORDER})
        as int) - 1 AS item_index
    FROM {d.table('lineitem')}"""


def _shown(d):
    """Net amount is 20 % off for some returned lines, gross is doubled for some others."""
    return f"""{d.idiv('net_c', 'qty')} AS price_c,
      case when disc = 10 and flag = 'R' then net_c + {d.idiv('net_c', '5')} else net_c end AS shown_net,
      case when disc = 0 and flag = 'A' then 2 * {d.idiv('net_c * (100 + vat)', '100')}
           else {d.idiv('net_c * (100 + vat)', '100')} end AS shown_gross"""


def _item_amounts(d):
    return f"""
    SELECT l_orderkey, item_index, l_partkey, l_suppkey, flag, ls, qty, vat, disc, net_c,
      {_shown(d)}
    FROM li"""


def _item(d):
    return f"""
    SELECT concat('doc-', cast(l_orderkey as string)) AS doc_id, item_index,
      concat('Article ', cast(l_partkey as string), ' grade ', flag) AS item_desc,
      {european(d, 'qty * 100')} AS item_qty,
      {european(d, 'price_c')} AS item_net_price,
      {european(d, 'shown_net')} AS item_net_worth,
      case when disc = 1 and ls = 'O' then null
           when disc = 2 then concat(cast(vat as string), ' %')
           else concat(cast(vat as string), '%') end AS item_vat,
      case when disc = 3 and ls = 'F' then 'n/a'
           else {european(d, 'shown_gross')} end AS item_gross_worth
    FROM item_amounts"""


def _hdr(d, source: str = "", also: str = ""):
    """Orders with customer, and the header values an ideal reader would find.

    ``source`` stands for the joined tables where it is given; ``also`` names more of its columns.
    """
    source = source or f"{d.table('orders')} JOIN {d.table('customer')} ON o_custkey = c_custkey"
    acct = "cast(o_custkey as bigint)"
    # Check digits: the account number as a number, taken modulo 97 piece by piece.
    rem = f"((21353224 % 97) * 27 + {acct} % 97) % 97"
    check = f"98 - ((({rem}) * 27 + 161100) % 97)"
    return f"""
    SELECT o_orderkey, o_custkey, st, pr, nat, c_name, total_c, created_at, invoice_no,
      invoice_date, seller_tax_id, client_tax_id,
      concat('GB', {digits('chk', 2)}, 'LZWO', {digits('o_custkey', 14)}) AS good_iban,
      concat('GB', {digits('case when chk > 50 then chk - 10 else chk + 10 end', 2)}, 'LZWO',
        {digits('o_custkey', 14)}) AS bad_iban{also}
    FROM (
      SELECT o_orderkey, o_custkey, o_orderstatus AS st, o_orderpriority AS pr, c_nationkey AS nat,
        c_name, cast(round(o_totalprice * 100) as bigint) AS total_c,
        {d.ms('o_orderdate')} AS created_at,
        case when o_orderpriority = '4-NOT SPECIFIED' then cast(20000000 + o_custkey as string)
             else cast(10000000 + o_orderkey as string) end AS invoice_no,
        case when o_orderpriority = '4-NOT SPECIFIED'
             then concat('01/01/', {d.date('o_orderdate', 'yyyy')})
             else {d.date('o_orderdate', 'MM/dd/yyyy')} end AS invoice_date,
        concat({digits('100 + c_nationkey', 3)}, '-', {digits('c_nationkey', 2)}, '-',
               {digits('1000 + 37 * c_nationkey', 4)}) AS seller_tax_id,
        concat({digits('o_custkey % 1000', 3)}, '-', {digits(d.idiv('o_custkey', '1000') + ' % 100', 2)},
               '-', {digits('o_custkey % 9973', 4)}) AS client_tax_id,
        {check} AS chk,
        o_orderdate{also}
      FROM {source}
    ) x"""


FIELD_ROWS = [
    ("invoice_no", "case when pr = '5-LOW' and st = 'P' then concat('INV-', invoice_no) else invoice_no end"),
    ("invoice_date", "case when pr = '2-HIGH' and st = 'P' then null "
                     "when pr = '3-MEDIUM' and st = 'P' then replace(invoice_date, '/', '.') else invoice_date end"),
    ("iban", "case when pr = '1-URGENT' and st = 'P' then null "
             "when pr = '2-HIGH' and st = 'O' then concat(substr(good_iban, 1, 4), ' ', substr(good_iban, 5)) "
             "when pr = '5-LOW' and st = 'F' then bad_iban "
             "when pr = '3-MEDIUM' and st = 'F' then concat(good_iban, '-') else good_iban end"),
    ("seller_tax_id", "case when pr = '1-URGENT' and st = 'P' then replace(seller_tax_id, '-', '') else seller_tax_id end"),
    ("client_tax_id", "case when pr = '2-HIGH' and st = 'F' then null else client_tax_id end"),
    ("seller", "concat('Supplier ', cast(nat as string), ' Main Street')"),
    ("client", "case when pr = '5-LOW' and st = 'O' then '  ' else c_name end"),
]


def _field(d):
    keys = "concat('doc-', cast(o_orderkey as string)) AS doc_id"
    return d.rows(keys, "hdr", ("name", "value"), [(f"'{n}'", e) for n, e in FIELD_ROWS])


def _field_gt(d):
    """Ground truth: the undamaged values; one field in some documents is unlabelled."""
    keys = "concat('doc-', cast(o_orderkey as string)) AS doc_id"
    rows = [
        ("invoice_no", "invoice_no"),
        ("invoice_date", "invoice_date"),
        ("iban", "case when st = 'P' and pr in ('1-URGENT', '4-NOT SPECIFIED') then null else good_iban end"),
        ("seller_tax_id", "seller_tax_id"),
        ("client_tax_id", "client_tax_id"),
        ("seller", "concat('Supplier ', cast(nat as string), ' Main  Street')"),
        ("client", "upper(c_name)"),
    ]
    return d.rows(keys, "hdr", ("name", "value"), [(f"'{n}'", e) for n, e in rows])


def _header(d):
    """Wide header; the batch index is the order key."""
    cols = ", ".join(f"{e} AS {n}" for n, e in FIELD_ROWS)
    return f"""
    SELECT concat('doc-', cast(o_orderkey as string)) AS doc_id, o_orderkey AS batch_index, {cols}
    FROM hdr"""


def _item_gt(d):
    """Ground truth of the items; the last line of long orders is not labelled."""
    return f"""
    SELECT doc_id, item_index, item_desc, item_qty, item_net_price,
      replace(item_net_worth, ' ', '') AS item_net_worth, replace(item_vat, ' ', '') AS item_vat,
      item_gross_worth
    FROM item WHERE item_index < 6"""


# --- positioned lines ----------------------------------------------------------


def _header_rows(d):
    """Header and party block. Coordinates are pixels on a page 900 wide."""
    no = "invoice_no"
    rows = [
        # slot, x0, y0, x1, y1, text
        (1, 30, 30, 250, 50,
         f"case pr when '1-URGENT' then 'Invoice no:' when '2-HIGH' then concat('Invoicen0:', {no}) "
         f"when '3-MEDIUM' then concat('Invoice no: ', {no}) when '5-LOW' then concat('Invoice Number ', {no}) "
         f"else concat('Invoiceno:', {no}) end"),
        (2, 30, 52, 140, 70, f"case when pr = '1-URGENT' then {no} end"),
        (3, 450, 30, 600, 50,
         "case when pr in ('2-HIGH', '3-MEDIUM') then concat('Invoice date: ', invoice_date) "
         "when pr = '5-LOW' and st = 'O' then 'Date ot issue' else 'Date of issue:' end"),
        (4, 450, 52, 540, 70,
         "case when pr in ('1-URGENT', '4-NOT SPECIFIED') then invoice_date "
         "when pr = '5-LOW' and st <> 'P' then concat(' ', invoice_date) "
         "when pr = '5-LOW' then 'Page 1' end"),
        (5, 30, 150, 120, 170,
         "case when st = 'O' then 'Sel1er:' when st = 'P' and pr = '5-LOW' then 'Vendor' else 'Seller:' end"),
        (6, 450, 150, 540, 170,
         "case when st = 'P' and pr = '3-MEDIUM' then 'Bill to:' when st = 'P' and pr = '4-NOT SPECIFIED' "
         "then 'Customer' when st = 'O' then 'C1ient:' else 'Client:' end"),
        (7, 30, 180, 220, 200, "concat('Supplier', cast(nat as string), 'Main')"),
        (8, 450, 180, 640, 200, "c_name"),
        (9, 30, 205, 260, 225, "concat(cast(o_custkey as string), 'ElizabethStreet,Apt.', cast(nat as string))"),
        (10, 450, 205, 700, 225, "concat('Unit', cast(nat as string), 'Box', cast(o_custkey as string))"),
        (11, 450, 228, 500, 246, "case when st = 'F' and pr = '1-URGENT' then 'no' when st = 'F' then '   ' end"),
        (12, 30, 255, 260, 275,
         "case when st = 'O' then concat('Taxld:', seller_tax_id) when st = 'P' and pr = '2-HIGH' then seller_tax_id "
         "when st = 'P' and pr = '1-URGENT' then 'Tax Id:' else concat('Tax Id: ', seller_tax_id) end"),
        (13, 450, 255, 700, 275,
         "case when st = 'F' and pr = '2-HIGH' then concat('registered ', client_tax_id, ' at court') "
         "when st = 'O' then concat('Tax ld: ', client_tax_id) else concat('Tax Id: ', client_tax_id) end"),
        (14, 30, 280, 330, 300,
         "case when st = 'P' and pr = '1-URGENT' then null when st = 'F' and pr = '5-LOW' then concat('IBAN: ', bad_iban) "
         "when st = 'O' and pr = '2-HIGH' then good_iban "
         "when st = 'O' then concat('iban:', lower(good_iban)) else concat('IBAN: ', good_iban) end"),
        (15, 30, 400, 120, 422,
         "case when st = 'P' and pr = '1-URGENT' then 'Positions' when st = 'O' and pr = '1-URGENT' then 'ITEM5' when st = 'O' then 'ITEMS:' "
         "when st = 'P' then 'Line items' else 'ITEMS' end"),
        (16, 30, 430, 60, 450, "'No.'"),
        (17, 70, 430, 180, 450, "'Description'"),
        (18, 400, 430, 440, 450, "'Qty'"),
        (19, 600, 430, 690, 450, "'Net worth'"),
        (20, 30, 0, 150, 0, "case when st = 'P' and pr = '2-HIGH' then null when st = 'O' then 'SUMMARY' else 'Summary' end"),
        (21, 700, 0, 740, 0, "'Total'"),
        (22, 600, 0, 690, 0, f"{european(d, 'total_c')}"),
    ]
    named = []
    for slot, x0, y0, x1, y1, text in rows:
        after = slot >= 20
        top = f"bottom_y + {20 + 30 * (slot - 20)}" if after else str(y0)
        end = f"bottom_y + {42 + 30 * (slot - 20)}" if after else str(y1)
        order = f"{slot + 100000}" if after else str(slot)
        named.append((order, text, f"cast({x0} as double)", f"cast({top} as double)",
                      f"cast({x1} as double)", f"cast({end} as double)"))
    return named


LINE = ("slot", "text", "x0", "y0", "x1", "y1")


def _page_header(d):
    return d.rows("o_orderkey, page_height", "page_size", LINE, _header_rows(d))


def _page_size(d):
    """Orders with the y below their last item."""
    return """
    SELECT hdr.*, 470 + 60 * coalesce(n, 0) AS bottom_y, 800 + 60 * coalesce(n, 0) AS page_height
    FROM hdr LEFT JOIN (
      SELECT l_orderkey, cast(count(*) as int) AS n FROM li GROUP BY l_orderkey
    ) c ON o_orderkey = l_orderkey"""


def _item_rows(d):
    """Lines of the item table: number, description, values, continuation."""
    y = "470 + 60 * item_index"
    gross = f"case when disc = 3 and ls = 'F' then 'n/a' else {european(d, 'shown_gross', '.')} end"
    rows = [
        # step, x0, dy, x1, height, text
        (0, 70, -1, 300, 22, "concat('Article', cast(l_partkey as string))"),
        (1, 30, 0, 55, 20, "concat(cast(item_index + 1 as string), case when ls = 'O' then ' .' else '.' end)"),
        (2, 600, 1, 680, 20, european(d, "shown_net")),
        (3, 400, 2, 440, 20, european(d, "qty * 100")),
        (4, 450, 0, 490, 20, "case when flag = 'N' then 'each' when flag = 'A' then 'pcs' end"),
        (5, 500, 1, 580, 20, f"case when disc = 7 and flag = 'R' then null else {european(d, 'price_c')} end"),
        (6, 700, 0, 740, 20,
         "case when disc = 1 and ls = 'O' then null when disc = 2 then concat(cast(vat as string), ' %') "
         "else concat(cast(vat as string), '%') end"),
        (7, 780, 3, 860, 20, gross),
        (8, 70, 24, 250, 18, "case when flag <> 'R' then concat('lot', cast(l_suppkey as string), 'Grade', flag) end"),
        (9, 72, 42, 200, 10, "case when ls = 'O' then 'cleaned,boxed' end"),
        (10, 395, 30, 500, 10, "case when flag = 'A' then 'see note' end"),
    ]
    return [
        (f"100 + 20 * item_index + {step}", text, f"cast({x0} as double)",
         f"cast({y} + {dy} as double)", f"cast({x1} as double)", f"cast({y} + {dy} + {h} as double)")
        for step, x0, dy, x1, h, text in rows
    ]


def _page_items(d):
    return d.rows("l_orderkey", "item_amounts", LINE, _item_rows(d))


# Item lines are numbered from slot 100 on, 20 an item; the lines below the table from slot 100020 on.
MOST_ITEMS = 4995


def _line_count(d):
    """Order lines and how many page lines each gives."""
    lines = _mask([text.replace("item_index", "0") for _, text, *_ in _item_rows(d)])
    return f"""
    SELECT *, bit_count({lines}) AS n_lines
    FROM (SELECT *, {_shown(d)} FROM (SELECT *, {LI_COLUMNS} FROM {d.table('lineitem')}))"""


def _odd_order(d):
    """Keys of the orders whose page lines cannot be numbered by counting."""
    return f"""
    SELECT o_orderkey AS odd FROM hdr GROUP BY o_orderkey HAVING count(*) > 1 OR o_orderkey IS NULL
    UNION
    SELECT l_orderkey FROM line_count GROUP BY l_orderkey HAVING count(*) > {MOST_ITEMS}"""


def _of_odd_orders(source: str, key: str):
    """Rows of those orders only: what every other order needs is then worked out once."""
    return lambda d: f"SELECT * FROM {source} LEFT SEMI JOIN odd_order ON {key} <=> odd"


def _counted_item(d, source: str = "line_count"):
    """Order lines with their place, and how many page lines the order's lines before them give.

    Only the given columns and the number of lines are moved and sorted, the amounts are made after.
    """
    whole = f"{LI_ORDER} rows between unbounded preceding and unbounded following"
    return f"""
    SELECT l_orderkey, l_partkey, l_suppkey, flag, ls, qty, vat, disc, {_shown(d)}, item_index, lines_before, items
    FROM (SELECT {LI_COLUMNS}, item_index, lines_before, items FROM (
      SELECT {LI_GIVEN}, cast(row_number() over ({LI_ORDER}) as int) - 1 AS item_index,
        coalesce(sum(n_lines) over ({LI_ORDER} rows between unbounded preceding and 1 preceding), 0) AS lines_before,
        cast(count(*) over ({whole}) as int) AS items
      FROM {source}))"""


def _mask(texts) -> str:
    """One bit for each text that is there."""
    return " + ".join(f"case when {t} is null then 0 else {1 << i} end" for i, t in enumerate(texts))


def _numbered(rows, texts, mask: str, before: str) -> str:
    """Array of lines; ``line_no`` counts the lines with text before each."""
    out = []
    for i, (slot, _, *box) in enumerate(rows):
        named = dict(zip(("x0", "y0", "x1", "y1"), box))
        n = f"{before} + bit_count({mask} & {(1 << i) - 1})"
        fields = {"slot": f"cast({slot} as int)", "line_no": f"cast({n} as int)", "text": texts[i], **named}
        out.append("named_struct(" + ", ".join(f"'{k}', {e}" for k, e in fields.items()) + ")")
    return f"array({', '.join(out)})"


def _counts(name: str, rows, source: str) -> str:
    """``source`` with the texts of the lines as columns, and which of them are there."""
    texts = [f"{name}{i}" for i in range(len(rows))]
    listed = ", ".join(f"{r[1]} AS {t}" for r, t in zip(rows, texts))
    return f"SELECT *, {_mask(texts)} AS {name}_mask FROM (SELECT *, {listed} FROM {source})"


def _head_and_tail(d):
    rows = _header_rows(d)
    head = [r for r in rows if not r[0].isdigit() or int(r[0]) < 100]
    return head, rows[len(head):]


def _headed(d):
    """Orders with the texts above the item table, and how often their key occurs.

    Keys are counted over the given columns: only those are moved, what is made of them is made after.
    """
    counted = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_name, c_nationkey,
      count(*) over (partition by o_orderkey) AS copies
      FROM {d.table('orders')} JOIN {d.table('customer')} ON o_custkey = c_custkey)"""
    return _counts("h", _head_and_tail(d)[0], f"({_hdr(d, counted, ', copies')})")


def _page_lines(d, prefix: str = ""):
    """Every line of every page. A page's line numbers follow from how many lines its head, its
    items and each item before give, so the lines themselves are neither moved nor sorted."""
    headed, line_count, counted_item = (prefix + name for name in ("headed", "line_count", "counted_item"))
    head, tail = _head_and_tail(d)
    items = _item_rows(d)
    texts = lambda name, rows: [f"{name}{i}" for i in range(len(rows))]
    head_lines = _numbered(head, texts("h", head), "h_mask", "0")
    tail_lines = _numbered(tail, texts("f", tail), "f_mask", "bit_count(h_mask) + item_lines")
    item_lines = _numbered(items, texts("t", items), "t_mask", "head_lines + lines_before")
    exact = f"copies = 1 AND items <= {MOST_ITEMS}"
    page = "o_orderkey AS k, 800 + 60 * items AS page_height"
    totals = f"""SELECT o_orderkey, st, pr, total_c, copies, {', '.join(texts('h', head))}, h_mask, coalesce(n, 0) AS items, coalesce(n_lines, 0) AS item_lines
      FROM {headed} LEFT JOIN (SELECT l_orderkey, cast(count(*) as int) AS n, sum(n_lines) AS n_lines FROM {line_count} GROUP BY l_orderkey)
        ON o_orderkey = l_orderkey"""
    below = _counts("f", tail, f"(SELECT *, 470 + 60 * items AS bottom_y FROM ({totals}))")
    within = _counts("t", items, f"""(SELECT * FROM {counted_item}
        JOIN (SELECT o_orderkey, copies, bit_count(h_mask) AS head_lines FROM {headed}) ON o_orderkey = l_orderkey)""")
    return f"""
    SELECT {page}, {exact} AND o_orderkey IS NOT NULL AS exact, inline(concat({head_lines}, {tail_lines})) FROM ({below})
    UNION ALL
    SELECT {page}, {exact} AS exact, inline({item_lines}) FROM ({within})"""


def _placed_line(d):
    """The page lines: numbered by counting where an order's key is its own, else by their slots.

    Both read the same pages, so that the order lines are moved once; picking out the orders to rank
    before would move all order lines a second time.
    """
    columns = "concat('doc-', cast(k as string)) AS doc_id, {0} AS line_no, text, x0, y0, x1, y1, 900 AS page_width, page_height"
    ranked = "cast(row_number() over (partition by k order by slot) as int) - 1"
    return f"""
    SELECT {columns.format('line_no')} FROM page_lines WHERE exact AND text IS NOT NULL
    UNION ALL
    SELECT {columns.format(ranked)} FROM page_lines WHERE NOT exact AND text IS NOT NULL"""


def _line_text(d):
    """The texts of the page lines, where their numbers are not asked for."""
    return "SELECT text FROM page_lines WHERE text IS NOT NULL"


def _ocr_line(d):
    if d.name == "spark":
        return _placed_line(d)
    return """
    SELECT concat('doc-', cast(k as string)) AS doc_id,
      cast(row_number() over (partition by k order by slot) as int) - 1 AS line_no,
      text, x0, y0, x1, y1, 900 AS page_width, page_height
    FROM (
      SELECT o_orderkey AS k, slot, text, x0, y0, x1, y1, page_height FROM page_header WHERE text IS NOT NULL
      UNION ALL
      SELECT l_orderkey AS k, slot, text, x0, y0, x1, y1, page_height
      FROM page_items JOIN (SELECT o_orderkey, page_height FROM page_size) s ON l_orderkey = o_orderkey
      WHERE text IS NOT NULL
    ) x"""


def _text_line(d):
    """Lines of the documents, as detections: four corners per line, score as text."""
    src = f"(SELECT doc_id AS k, lang, text FROM {d.table('documents')}) t"
    return f"""
    SELECT concat('txt-', cast(k as string)) AS doc_id, line_no, line AS text,
      case lang when 'en' then '0.97' when 'fr' then '1.25' when 'de' then 'n/a' else '-0.5' end AS score,
      cast(40 + line_no % 3 as double) AS left_x, cast(40 + 8 * length(line) as double) AS right_x,
      cast(30 * line_no as double) AS top_y, cast(30 * line_no + 24 as double) AS bottom_y
    FROM ({d.split_lines('k, lang', 'text', src)}) x"""


# --- relational tables ----------------------------------------------------------


def _workspaces(d):
    gst = f"concat({digits('n_nationkey', 2)}, 'ABCDE', {digits('n_nationkey', 4)}, 'F1Z5')"
    ca = f"concat({digits('50 + r_regionkey', 2)}, 'CAXYZ', {digits('r_regionkey', 4)}, 'K1Z9')"
    linked = f"concat({digits('50 + n_regionkey', 2)}, 'CAXYZ', {digits('n_regionkey', 4)}, 'K1Z9')"
    return f"""
    SELECT concat('ws-', cast(n_nationkey as string)) AS id,
      concat('user-', cast(n_nationkey as string)) AS owner_user_id, n_name AS name,
      case when n_regionkey = 4 then null else {gst} end AS gstin,
      case when n_regionkey = 0 then null else {linked} end AS ca_gstin,
      cast(n_nationkey as bigint) * 86400000 AS created_at
    FROM {d.table('nation')}
    UNION ALL
    SELECT concat('ca-', cast(r_regionkey as string)), concat('ca-user-', cast(r_regionkey as string)),
      r_name, {ca}, null, cast(0 as bigint)
    FROM {d.table('region')}"""


def _users(d):
    return f"""
    SELECT concat('user-', cast(n_nationkey as string)) AS id,
      case when n_regionkey = 4 then 'admin' else 'business' end AS role,
      concat(lower(n_name), '@example.com') AS email,
      concat('+91', {digits('9000000000 + n_nationkey', 10)}) AS phone
    FROM {d.table('nation')}
    UNION ALL
    SELECT concat('ca-user-', cast(r_regionkey as string)), 'ca', concat(lower(r_name), '@example.com'),
      concat('+44', {digits('7000000000 + r_regionkey', 10)})
    FROM {d.table('region')}"""


def _sources(d):
    keys = "n_nationkey, n_regionkey"
    inner = d.rows(keys, d.table("nation"), ("kind",), [("'gmail'",), ("'upload'",), ("'folder'",)])
    return f"""
    SELECT concat('src-', cast(n_nationkey as string), '-', kind) AS id,
      concat('ws-', cast(n_nationkey as string)) AS workspace_id, kind,
      concat(kind, ' source') AS label,
      case when kind <> 'gmail' then 'connected' when n_regionkey = 0 then 'disconnected'
           when n_regionkey = 1 then 'error' else 'connected' end AS status,
      case when kind = 'gmail' and n_regionkey = 2 then cast(1704200000123 as bigint) end AS last_polled_at
    FROM ({inner}) x
    WHERE not (kind = 'folder' and n_regionkey = 3) and not (kind = 'upload' and n_regionkey = 2)"""


def _inbox_messages(d):
    """Stored messages: one per document whose id is a customer's key."""
    return f"""
    SELECT concat('msg-', cast(doc_id as string)) AS id,
      concat('ws-', cast(coalesce(c_nationkey, doc_id % 25) as string)) AS workspace_id,
      case when lang = 'es' then null
           when lang = 'en' then concat('src-', cast(coalesce(c_nationkey, doc_id % 25) as string), '-gmail')
           else concat('src-', cast(coalesce(c_nationkey, doc_id % 25) as string), '-folder') end AS source_id,
      case when lang = 'en' then concat(lower(source), '@example.com') end AS sender,
      concat('Bill ', cast(doc_id as string)) AS subject,
      cast(1704067200000 + n_chars * 3600000 as bigint) AS received_at,
      case when lang = 'fr' then 'image/png' else 'application/pdf' end AS content_type,
      concat('ws-', cast(coalesce(c_nationkey, doc_id % 25) as string), '/', substr({d.sha('text')}, 1, 2), '/',
             cast(doc_id as string), case when lang = 'fr' then '.png' else '.pdf' end) AS file_storage_key,
      n_chars AS file_size_bytes, {d.sha('text')} AS file_sha256,
      case when lang = 'de' then 'failed' when lang = 'es' then 'ignored' when source = 'src1' then 'extracting'
           when source in ('src2', 'src3', 'src4', 'src5') then 'queued' else 'extracted' end AS status,
      case when lang = 'de' and source in ('src6', 'src7', 'src8') then 'blank_pages'
           when lang = 'de' and source in ('src0', 'src2') then 'pdf_password_protected'
           when lang = 'de' and source = 'src9' then 'worker lost'
           when lang = 'es' and source in ('src1', 'src11') then 'newsletter'
           when lang = 'es' then 'user_marked' end AS ignored_reason,
      cast(1704067200000 + n_chars * 3600000 as bigint) AS created_at
    FROM {d.table('documents')} LEFT JOIN {d.table('customer')} ON doc_id = c_custkey"""


def _invoices(d):
    return f"""
    SELECT concat('inv-', cast(hdr.o_orderkey as string)) AS id,
      concat('ws-', cast(nat as string)) AS workspace_id,
      concat('msg-', cast(o_custkey as string)) AS inbox_message_id,
      case when st = 'P' or supp is null then null else concat('Supplier#', {digits('supp', 9)}) end AS vendor_name,
      c_name AS client_name, cast(null as string) AS client_gstin,
      seller_tax_id AS seller_gstin, invoice_no, invoice_date,
      case when pr = '5-LOW' and st = 'P' then null
           when pr = '3-MEDIUM' and st = 'P' then 0 - total_c else total_c end AS total_amount_minor,
      case when nat = 7 then 'USD' else 'INR' end AS currency,
      case when st = 'F' and pr = '1-URGENT' then 'flagged' when st = 'F' then 'approved'
           when st = 'O' and pr = '5-LOW' then 'rejected' when st = 'O' then 'under_review'
           else 'pending' end AS status,
      created_at
    FROM hdr LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM li GROUP BY l_orderkey) v
      ON o_orderkey = l_orderkey"""


def _validation_findings(d):
    """One finding per order line."""
    return f"""
    SELECT concat('vf-', cast(l_orderkey as string), '-', cast(item_index as string)) AS id,
      concat('ws-', cast(nat as string)) AS workspace_id,
      concat('inv-', cast(l_orderkey as string)) AS invoice_id,
      case when disc = 10 then 'iban_shape' when flag = 'A' then 'item_net_worth_consistency'
           when flag = 'N' then 'item_gross_worth_consistency' else 'iban_checksum' end AS rule_name,
      concat('item[', cast(item_index as string), ']') AS target,
      case when disc >= 9 then 'FAIL' when disc = 0 then 'NOT_APPLICABLE' else 'PASS' end AS outcome,
      case when disc >= 9 then 'out of tolerance' when disc = 0 then 'missing input' end AS reason,
      case when disc >= 9 then cast(net_c as string) end AS observed,
      {d.ms('l_shipdate')} AS created_at
    FROM li JOIN hdr ON l_orderkey = o_orderkey"""


def _pipeline_runs(d):
    """One run per order line; the version follows the return flag."""
    return f"""
    SELECT concat('run-', cast(l_orderkey as string), '-', cast(item_index as string)) AS id,
      concat('ws-', cast(nat as string)) AS workspace_id,
      concat('inv-', cast(l_orderkey as string)) AS invoice_id,
      concat('v', flag) AS pipeline_version,
      concat('{{"lines":', cast(qty as string), '}}') AS ocr_result_json,
      case when disc = 0 then '{{broken' else concat('{{"fields":', cast(vat as string), '}}') end
        AS extraction_result_json,
      case when disc = 1 then null else concat('{{"items":', cast(item_index as string), '}}') end
        AS tables_result_json,
      concat('{{"findings":', cast(disc as string), '}}') AS validation_result_json,
      cast(net_c as double) / 4 AS total_ms,
      {d.ms('l_shipdate')} AS created_at
    FROM li JOIN hdr ON l_orderkey = o_orderkey"""


def _jobs(d):
    return f"""
    SELECT concat('job-', cast(o_orderkey as string)) AS id,
      concat('ws-', cast(nat as string)) AS workspace_id,
      concat('msg-', cast(o_custkey as string)) AS inbox_message_id,
      concat('inv-', cast(o_orderkey as string)) AS invoice_id, 'full' AS stage,
      case when st = 'O' and pr = '1-URGENT' then 'running' when st = 'O' and pr = '2-HIGH' then 'queued'
           when st = 'P' then 'failed' else 'done' end AS state,
      case when st = 'P' then 3 else 1 end AS attempts, 3 AS max_attempts,
      created_at AS next_run_at, created_at
    FROM hdr"""


def _audit_events(d):
    return f"""
    SELECT event_id, concat('evt-', cast(event_id as string)) AS id,
      concat('ws-', cast(user_id % 25 as string)) AS workspace_id,
      concat('user-', cast(user_id as string)) AS actor_user_id, user_id,
      case event_type when 'click' then 'invoice.uploaded' when 'error' then 'login.failed'
        when 'purchase' then 'login.ok' when 'signup' then 'source.connected' else 'invoice.viewed' end AS action,
      case when event_type = 'signup' and value > 5 and user_id % 25 in (3, 11, 19) then '{{"seed":"demo"}}'
           when event_type = 'view' then null else props end AS metadata_json,
      cast(round(value * 100) as bigint) AS value_c,
      {d.ms('ts')} AS ts
    FROM {d.table('events')}"""


def _sessions(d):
    return """
    SELECT concat('ses-', cast(event_id as string)) AS id, actor_user_id AS user_id,
      ts AS created_at, ts + value_c * 100000 AS expires_at,
      case when action = 'login.failed' then ts + 1000 end AS revoked_at
    FROM audit_events"""


def _otp_challenges(d):
    return """
    SELECT concat('otp-', cast(event_id as string)) AS id,
      concat('+4420', lpad(cast(user_id as string), 8, '0')) AS phone,
      case when action in ('login.ok', 'login.failed') then 'login' else 'signup' end AS purpose,
      ts AS created_at, ts + value_c * 100000 AS expires_at,
      case when action = 'source.connected' then 5 else 1 end AS attempts, 5 AS max_attempts,
      case when action = 'invoice.viewed' then ts + 500 end AS used_at
    FROM audit_events"""


def _uploads(d):
    """Arriving files: the document text behind the leading bytes of a file type, and some empty ones."""
    text = "text"
    return f"""
    SELECT concat('upl-', cast(doc_id as string)) AS upload_id,
      concat('ws-', case lang when 'en' then '0' when 'de' then '1' else '2' end) AS workspace_id,
      concat('user-', substr(source, 4)) AS user_id,
      concat('scan-', cast(doc_id as string)) AS filename,
      cast(1706000000000 + n_chars * 1000 as bigint) AS received_at,
      case when lang = 'en' then {d.blob('255044462D', text)}
           when lang = 'de' then {d.blob('FFD8FFE1', text)}
           when lang = 'fr' and n_chars < 3000 then {d.blob('524946460000000057454250', text)}
           when lang = 'fr' then {d.blob('49492A00', text)}
           when lang = 'es' and source = 'src1' then {d.blob('89504E470D0A1A0A', text)}
           else {d.blob('', text)} end AS data
    FROM {d.table('documents')}
    UNION ALL SELECT concat('upl-empty-', cast(doc_id as string)), 'ws-2', concat('user-', substr(source, 4)),
      concat('blank-', cast(doc_id as string)), cast(1706000000000 + n_chars * 1000 as bigint), {d.blob('', "''")}
    FROM {d.table('documents')} WHERE lang = 'es' AND n_chars < 2000"""


BUILDERS = {
    "li": (_li, ()),
    "item_amounts": (_item_amounts, ("li",)),
    "item": (_item, ("item_amounts",)),
    "hdr": (_hdr, ()),
    "field": (_field, ("hdr",)),
    "field_gt": (_field_gt, ("hdr",)),
    "header": (_header, ("hdr",)),
    "item_gt": (_item_gt, ("item",)),
    "page_size": (_page_size, ("hdr", "li")),
    "page_header": (_page_header, ("page_size",)),
    "page_items": (_page_items, ("item_amounts",)),
    "ocr_line": (_ocr_line, ("page_header", "page_items", "page_size")),
    "text_line": (_text_line, ()),
    "workspaces": (_workspaces, ()),
    "users": (_users, ()),
    "sources": (_sources, ()),
    "inbox_messages": (_inbox_messages, ()),
    "invoices": (_invoices, ("hdr", "li")),
    "validation_findings": (_validation_findings, ("li", "hdr")),
    "pipeline_runs": (_pipeline_runs, ("li", "hdr")),
    "jobs": (_jobs, ("hdr",)),
    "audit_events": (_audit_events, ()),
    "sessions": (_sessions, ("audit_events",)),
    "otp_challenges": (_otp_challenges, ("audit_events",)),
    "uploads": (_uploads, ()),
}


def _closure(names: Iterable[str], builders: dict) -> set[str]:
    """Views with everything they build on."""
    need: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo.extend(builders[n][1])
    return need


# What Spark builds these views from; they give the same rows.
SPARK_PARTS = {
    "line_count": (_line_count, ()),
    "counted_item": (_counted_item, ("line_count",)),
    "headed": (_headed, ("hdr",)),
    "page_lines": (_page_lines, ("headed", "line_count", "counted_item")),
    "odd_order": (_odd_order, ("hdr", "line_count")),
    "odd_headed": (_of_odd_orders("headed", "o_orderkey"), ("headed", "odd_order")),
    "odd_line_count": (_of_odd_orders("line_count", "l_orderkey"), ("line_count", "odd_order")),
    "odd_counted_item": (lambda d: _counted_item(d, "odd_line_count"), ("odd_line_count",)),
    "odd_page_lines": (lambda d: _page_lines(d, "odd_"), ("odd_headed", "odd_line_count", "odd_counted_item")),
    "ocr_line": (_ocr_line, ("page_lines",)),
    "line_text": (_line_text, ("page_lines",)),
}


def ctes(d, *names: str) -> str:
    """Comma-separated CTE definitions of the views and all they need."""
    builders = BUILDERS if d.name == "duckdb" else BUILDERS | SPARK_PARTS
    need = _closure(names, builders)
    order = list(BUILDERS) if d.name == "duckdb" else [n for n in BUILDERS if n not in SPARK_PARTS] + list(SPARK_PARTS)
    return ",\n".join(f"{n} AS ({builders[n][0](d)})" for n in order if n in need)


def oracle(select: str, *views: str, extra: str = "") -> str:
    """Oracle SQL: the views as CTEs, then further CTEs, then the SELECT."""
    parts = [p for p in (ctes(DuckDialect(), *views) if views else "", extra.strip().rstrip(",")) if p]
    word = "WITH RECURSIVE" if "UNION ALL SELECT a, b, i + 1" in extra or "/* recursive */" in extra else "WITH"
    return (f"{word} {', '.join(parts)}\n" if parts else "") + select


class Given:
    """Frames over one data directory: given tables and derived views."""

    def __init__(self, spark, sf_dir: str):
        from tallyvine.session import prepare

        self.spark = prepare(spark)
        self.dialect = SparkDialect(sf_dir)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str):
        if name in TABLES:
            return self.table(name)
        return self.spark.sql(f"WITH {ctes(self.dialect, name)} SELECT * FROM {name}")

    def sql(self, select: str, *views: str):
        """A SELECT over the views, in Spark's spelling."""
        head = f"WITH {ctes(self.dialect, *views)} " if views else ""
        return self.spark.sql(head + select)

    __getattr__ = view
