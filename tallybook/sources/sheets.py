"""Stand-in workbooks rendered from the given tables.

One workbook per order (``Project#<o_orderkey>.xlsx``), with up to four
sheets: labour, material and milestone sheets from the order's line items
(in three header styles: Thai, English, and Thai without a total column),
plus a summary sheet matching no ledger for orders in status ``P``.  Even
order keys get a title row above the header.  Numbers and dates are typed
the messy ways of :mod:`tallybook.sources.render`; a pending milestone has
a blank received cell.

The result has the grid schema the import expects:
``grid(file, sheet, sheet_idx, row_idx, cells array<string>)`` plus an
``imports(file, project_id, user_id)`` table.  The SPEC also yields the
DuckDB twin used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.session import dealt
from tallybook.sources import render as R
from tallybook.sources.tables import table

# kind -> (sheet name, sheet index, line numbers, header styles); a style is a
# list of (header text, value key).
SPEC = {
    "labor": ("ค่าแรง", 0, (1, 4, 7), [
        [("ชื่อช่าง", "worker"), ("ประเภท", "wtype"), ("วันทำงาน", "qty"), ("ค่าแรง/วัน", "price"),
         ("ยอดรวม", "total"), ("จ่ายแล้ว", "paid"), ("วันที่", "date")],
        [("Worker", "worker"), ("Type", "wtype"), ("Days", "qty"), ("Daily Rate", "price"),
         ("Amount", "total"), ("Paid", "paid"), ("Date", "date")],
        [("ชื่อ", "worker"), ("ตำแหน่ง", "wtype"), ("จำนวนวัน", "qty"), ("ค่าแรงต่อวัน", "price"),
         ("ชำระ", "paid"), ("ว/ด/ป", "date")],
    ]),
    "material": ("วัสดุ", 1, (2, 5), [
        [("รายการ", "item"), ("จำนวน", "qty"), ("หน่วย", "unit"), ("ราคา/หน่วย", "price"),
         ("ยอดรวม", "total"), ("ร้าน", "supplier"), ("วันที่ซื้อ", "date")],
        [("Item", "item"), ("Qty", "qty"), ("Unit", "unit"), ("Price", "price"),
         ("Total", "total"), ("Supplier", "supplier"), ("Date", "date")],
        [("วัสดุ", "item"), ("ปริมาณ", "qty"), ("หน่วย", "unit"), ("ราคาต่อหน่วย", "price"),
         ("ผู้ขาย", "supplier"), ("ว/ด/ป", "date")],
    ]),
    "milestone": ("งวดงาน", 2, (3, 6), [
        [("งวด", "ms_name"), ("มูลค่า", "total"), ("กำหนด", "date"), ("รับแล้ว", "received"),
         ("สถานะ", "status")],
        [("Milestone", "ms_name"), ("Amount", "total"), ("Due", "date"), ("Received", "received"),
         ("Status", "status")],
        [("ชื่องวด", "ms_name"), ("ยอดเงิน", "total"), ("วันครบกำหนด", "date"), ("สถานะ", "status")],
    ]),
}
SUMMARY = ("สรุป", 3, [("หัวข้อ", None), ("ค่า", None)], ("ลูกค้า", "c_name"))
# Field each value key lands in (ground truth of the mapping, per kind).
FIELD_OF = {
    "labor": {"worker": "worker_name", "wtype": "worker_type", "qty": "work_days",
              "price": "daily_rate", "total": "total_amount", "paid": "paid_amount",
              "date": "work_date"},
    "material": {"item": "item_name", "qty": "quantity", "unit": "unit", "price": "unit_price",
                 "total": "total_amount", "supplier": "supplier", "date": "purchase_date"},
    "milestone": {"ms_name": "milestone_name", "total": "amount", "date": "due_date",
                  "received": "received_date", "status": "status"},
}
VALUE_KEYS = sorted({key for _, _, _, styles in SPEC.values() for st in styles for _, key in st})
BODY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
              "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"]


def _money_variant() -> Column:
    return (F.col("l_linenumber") - 1) % 6 + 1


def _date_variant() -> Column:
    return (F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1


def _value(key: str) -> Column:
    mv, dv = _money_variant(), _date_variant()
    ship = F.col("l_shipdate").cast("date")
    received = F.col("l_linestatus") == "F"
    return {
        "worker": F.concat(F.lit("Worker#"), F.col("l_suppkey").cast("string")),
        "wtype": F.col("l_returnflag"),
        "qty": R.money_text(F.col("l_quantity"), mv),
        "price": R.money_text(F.col("p_retailprice"), mv),
        "total": R.money_text(F.col("l_extendedprice"), mv),
        "paid": R.money_text(F.when(received, F.col("l_extendedprice")).otherwise(F.lit(0.0)), mv),
        "date": R.date_text(ship, dv),
        "item": F.col("p_name"),
        "unit": F.col("p_type"),
        "supplier": F.col("s_name"),
        "ms_name": F.concat(F.lit("M"), F.col("l_linenumber").cast("string")),
        "received": F.when(received, R.date_text(F.date_add(ship, 7), dv)),
        "status": F.when(received, F.lit("received")).otherwise(F.lit("pending")),
    }[key]


#: Parts that a join may broadcast; beyond, both sides are dealt by the part.
BROADCAST_PARTS = 500_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    if p.count() > BROADCAST_PARTS:
        n = li.count()
        li, p = dealt(li, n, "l_partkey"), dealt(p, n, "p_partkey")
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
              .join(s, li.l_suppkey == s.s_suppkey, "left"))


def render_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid(file, sheet, sheet_idx, row_idx, cells) for every order's workbook.

    The line items are joined and ranked once for all kinds of sheets; the first line of a sheet also gives its
    title and header rows."""
    file = F.concat(F.lit("Project#"), F.col("l_orderkey").cast("string"), F.lit(".xlsx"))
    titled = (F.col("l_orderkey") % 2 == 0).cast("int")
    style = F.col("l_orderkey") % 3

    def of_kind(value):
        out = F
        for kind, spec in SPEC.items():
            out = out.when(F.col("kind") == spec[1], value(kind, *spec))
        return out

    def cells_of(fn):
        def cells(kind, sheet, sidx, numbers, styles):
            w = max(len(s) for s in styles)
            arrs = [F.array(*[fn(h, v) for h, v in s] +
                            [F.lit(None).cast("string")] * (w - len(s))) for s in styles]
            return F.when(style == 0, arrs[0]).when(style == 1, arrs[1]).otherwise(arrs[2])
        return of_kind(cells)

    def title(kind, sheet, sidx, numbers, styles):
        w = max(len(s) for s in styles)
        return F.array(F.concat(F.lit(sheet + " "), file), *[F.lit(None).cast("string")] * (w - 1))

    kind = F
    for _, sidx, numbers, _ in SPEC.values():
        kind = kind.when(F.col("l_linenumber").isin(*numbers), F.lit(sidx))
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "kind").orderBy(*BODY_ORDER))
    lines = dealt(_lines(spark, sf_dir).withColumn("kind", kind).filter(F.col("kind").isNotNull()), table(spark, sf_dir, "lineitem").count(), "l_orderkey")
    li = lines.withColumn("rank", rank)
    # rows that a line gives: 0 title, 1 header, 2 the line itself
    given = (F.when(F.col("rank") > 1, F.array(F.lit(2))).when(titled == 1, F.array(F.lit(0), F.lit(1), F.lit(2)))
              .otherwise(F.array(F.lit(1), F.lit(2))))
    row = F.col("row")
    # texts are written once per line, then put into the cells of its sheet's style
    used = {key: [spec[1] for spec in SPEC.values() if any(key == k for st in spec[3] for _, k in st)] for key in VALUE_KEYS}
    texts = li.select("l_orderkey", "kind", "rank", given.alias("given"),
                      *[F.when(F.col("kind").isin(*kinds), _value(key)).alias(f"_{key}") for key, kinds in used.items()])
    sheets = texts.withColumn("row", F.explode("given")).select(
        file.alias("file"), of_kind(lambda kind, sheet, *_: F.lit(sheet)).alias("sheet"), F.col("kind").alias("sheet_idx"),
        F.when(row == 0, F.lit(0)).when(row == 1, titled).otherwise(titled + F.col("rank")).alias("row_idx"),
        F.when(row == 2, cells_of(lambda h, v: F.col(f"_{v}"))).when(row == 1, cells_of(lambda h, v: F.lit(h)))
         .otherwise(of_kind(title)).alias("cells"))
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    oc = o.join(c, o.o_custkey == c.c_custkey, "left").withColumnRenamed("o_orderkey", "l_orderkey")
    sname, sidx, heads_, (label, col) = SUMMARY
    summary = oc.withColumn("row_idx", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        file.alias("file"), F.lit(sname).alias("sheet"), F.lit(sidx).alias("sheet_idx"), "row_idx",
        F.when(F.col("row_idx") == 0, F.array(*[F.lit(h) for h, _ in heads_])).otherwise(F.array(F.lit(label), F.col(col))).alias("cells"))
    return sheets.unionByName(summary).withColumn("row_idx", F.col("row_idx").cast("long"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which project and user each workbook is imported for."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("Project#"), F.col("o_orderkey").cast("string"), F.lit(".xlsx")).alias("file"),
                    F.col("o_orderkey").cast("string").alias("project_id"),
                    F.col("o_custkey").cast("string").alias("user_id"))


# ---------------------------------------------------------------- DuckDB twin
def _sql_money(x: str) -> str:
    f = f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"
    v = "((l_linenumber - 1) % 6 + 1)"
    return (f"CASE {v} WHEN 1 THEN '฿' || {f} WHEN 2 THEN replace({f}, ',', '') "
            f"WHEN 3 THEN {f} || ' บาท' WHEN 4 THEN translate({f}, '0123456789', '๐๑๒๓๔๕๖๗๘๙') "
            f"WHEN 5 THEN '-' || {f} WHEN 6 THEN '(' || {f} || ')' END")


def _sql_date(d: str) -> str:
    v = "((l_orderkey + l_linenumber) % 6 + 1)"
    return (f"CASE {v} WHEN 1 THEN strftime({d}, '%d/%m/%Y') WHEN 2 THEN strftime({d}, '%d-%m-%Y') "
            f"WHEN 3 THEN strftime({d}, '%Y-%m-%d') WHEN 4 THEN strftime({d}, '%d/%m/%y') "
            f"WHEN 5 THEN strftime({d}, '%d %b %Y') WHEN 6 THEN strftime({d}, '%d %B %Y') END")


SQL_VALUE = {
    "worker": "'Worker#' || CAST(l_suppkey AS VARCHAR)",
    "wtype": "l_returnflag",
    "qty": _sql_money("l_quantity"),
    "price": _sql_money("p_retailprice"),
    "total": _sql_money("l_extendedprice"),
    "paid": _sql_money("CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0.0 END"),
    "date": _sql_date("CAST(l_shipdate AS DATE)"),
    "item": "p_name",
    "unit": "p_type",
    "supplier": "s_name",
    "ms_name": "'M' || CAST(l_linenumber AS VARCHAR)",
    "received": f"CASE WHEN l_linestatus = 'F' THEN {_sql_date('CAST(l_shipdate AS DATE) + 7')} END",
    "status": "CASE WHEN l_linestatus = 'F' THEN 'received' ELSE 'pending' END",
}
SQL_FILE = "'Project#' || CAST(l_orderkey AS VARCHAR) || '.xlsx'"


def sql_lines(kind: str) -> str:
    """Line items of one sheet kind with part, supplier, style, title flag and rank."""
    numbers = ", ".join(str(n) for n in SPEC[kind][2])
    order = ", ".join(BODY_ORDER)
    return f"""(SELECT l.*, p.p_name, p.p_type, p.p_retailprice, s.s_name,
        CAST(l.l_orderkey % 3 AS INTEGER) AS style, CAST(l.l_orderkey % 2 = 0 AS INTEGER) AS titled,
        ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY {order}) AS rnk
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
                  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE l.l_linenumber IN ({numbers}))"""


def sql_cells_long() -> str:
    """Long form of the grid: (file, sheet, sheet_idx, row_idx, col_idx, v), col_idx from 0."""
    parts = []
    for kind, (sheet, sidx, _, styles) in SPEC.items():
        src = sql_lines(kind)
        for si, st in enumerate(styles):
            for j, (h, key) in enumerate(st):
                parts.append(f"SELECT {SQL_FILE} AS file, '{sheet}' AS sheet, {sidx} AS sheet_idx, "
                             f"titled + rnk AS row_idx, {j} AS col_idx, {SQL_VALUE[key]} AS v "
                             f"FROM {src} x WHERE style = {si}")
                parts.append(f"SELECT DISTINCT {SQL_FILE}, '{sheet}', {sidx}, titled, {j}, '{h}' "
                             f"FROM {src} x WHERE style = {si}")
        parts.append(f"SELECT DISTINCT {SQL_FILE}, '{sheet}', {sidx}, 0, 0, '{sheet} ' || {SQL_FILE} "
                     f"FROM {src} x WHERE titled = 1")
    sname, sidx, heads, (label, col) = SUMMARY
    osrc = ("(SELECT o.o_orderkey AS l_orderkey, c.c_name FROM orders o "
            "LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P')")
    for j, (h, _) in enumerate(heads):
        parts.append(f"SELECT {SQL_FILE}, '{sname}', {sidx}, 0, {j}, '{h}' FROM {osrc} x")
    parts.append(f"SELECT {SQL_FILE}, '{sname}', {sidx}, 1, 0, '{label}' FROM {osrc} x")
    parts.append(f"SELECT {SQL_FILE}, '{sname}', {sidx}, 1, 1, {col} FROM {osrc} x")
    return "\nUNION ALL ".join(parts)
