"""Registered spreadsheet-import queries.

Input: one rendered workbook per order (:mod:`tallybook.sources.sheets`),
stored once in the shared folder.  The oracles compute what a correct
import must produce straight from ``lineitem`` (the values that were
rendered), so they check the whole chain: fill, header search, mapping,
cleaning, derivation and the ledger form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import grid as G
from tallybook.operators import ingest
from tallybook.plans.catalog import register
from tallybook.plans.oracle import money
from tallybook.sources import sheets as SH
from tallybook.sources.stored import stored
from tallybook.sources.tables import table


def _grid(spark, sf_dir):
    return stored(spark, "workbooks", sf_dir, lambda: SH.render_grid(spark, sf_dir))


def _imported(spark, sf_dir):
    return ingest.import_grid(_grid(spark, sf_dir))


# ------------------------------------------------------------------ oracle bits
LONG = f"long AS ({SH.sql_cells_long()})"
FILLED = """filled AS (
  SELECT file, sheet, sheet_idx, row_idx, col_idx,
         last_value(v IGNORE NULLS) OVER (PARTITION BY file, sheet, col_idx ORDER BY row_idx
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
  FROM long)"""
HEADER = """hdr AS (
  SELECT file, sheet, sheet_idx, row_idx AS header_row FROM (
    SELECT file, sheet, sheet_idx, row_idx,
           ROW_NUMBER() OVER (PARTITION BY file, sheet ORDER BY n DESC, row_idx) AS rn
    FROM (SELECT file, sheet, sheet_idx, row_idx, COUNT(v) AS n FROM long
          GROUP BY file, sheet, sheet_idx, row_idx) c) t
  WHERE rn = 1)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@register("grid_fill", _with(LONG, FILLED) + """SELECT file, sheet, row_idx, col_idx, v
FROM filled WHERE v IS NOT NULL""")
def grid_fill(spark, sf_dir):
    """G1: every non-blank cell after filling blanks from above (blocked scan)."""
    f = G.grid_fill(_grid(spark, sf_dir), "down")
    return (f.select("file", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "v"))
             .filter(F.col("v").isNotNull()))


@register("header_detect", _with(LONG, FILLED, HEADER) + """SELECT h.file, h.sheet, h.header_row,
  string_agg(trim(f.v), '|' ORDER BY f.col_idx) AS header_text
FROM hdr h JOIN filled f ON f.file = h.file AND f.sheet = h.sheet AND f.row_idx = h.header_row
WHERE f.v IS NOT NULL
GROUP BY h.file, h.sheet, h.header_row""")
def header_detect(spark, sf_dir):
    """Header row (most non-blank cells, first wins) and its names per sheet."""
    h, _ = G.fill_and_search(_grid(spark, sf_dir))
    return h.select("file", "sheet", "header_row", F.array_join("names", "|").alias("header_text"))


@register("body_rows", _with(LONG, FILLED, HEADER) + """SELECT f.file, f.sheet, f.row_idx,
  COUNT(f.v) AS n_cells
FROM filled f JOIN hdr h ON f.file = h.file AND f.sheet = h.sheet
WHERE f.row_idx > h.header_row
GROUP BY f.file, f.sheet, f.row_idx
HAVING COUNT(f.v) > 0""")
def body_rows(spark, sf_dir):
    """Rows under the header that are not all blank, with their cell counts."""
    _, b = G.fill_and_search(_grid(spark, sf_dir))
    return b.select("file", "sheet", "row_idx",
                    F.size(F.filter("cells", lambda x: x.isNotNull())).cast("long").alias("n_cells"))


def _field_rows() -> str:
    parts = []
    for kind, (sheet, _, _, styles) in SH.SPEC.items():
        for si, st in enumerate(styles):
            for j, (h, key) in enumerate(st):
                parts.append(f"SELECT '{sheet}' AS sheet, {si} AS style, {j} AS col_idx, '{h}' AS source_name, "
                             f"'{kind}' AS table_type, '{SH.FIELD_OF[kind][key]}' AS field")
    return "truth AS (" + "\nUNION ALL ".join(parts) + ")"


@register("map_columns", _with(_field_rows(), LONG) + """SELECT DISTINCT l.file, t.sheet, t.table_type,
  t.col_idx, t.source_name, t.field
FROM truth t JOIN long l ON l.sheet = t.sheet AND l.col_idx = t.col_idx AND l.v = t.source_name
  AND CAST(regexp_extract(l.file, '#(\\d+)', 1) AS BIGINT) % 3 = t.style
  AND l.row_idx = CASE WHEN CAST(regexp_extract(l.file, '#(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END""")
def map_columns(spark, sf_dir):
    """Sheet type and column -> field by synonym scoring, for every sheet."""
    imp = _imported(spark, sf_dir)
    return imp.column_map.join(imp.sheet_types.select("file", "sheet", "table_type"), ["file", "sheet"]) \
              .select("file", "sheet", "table_type", "col_idx", "source_name", "field")


def _truth_lines(kind: str) -> str:
    return f"""(SELECT x.*, CAST(o.o_custkey AS VARCHAR) AS user_id FROM {SH.sql_lines(kind)} x
  LEFT JOIN orders o ON x.l_orderkey = o.o_orderkey)"""


_LABOR = f"""SELECT CAST(l_orderkey AS VARCHAR) AS project_id, user_id,
  'Worker#' || CAST(l_suppkey AS VARCHAR) AS worker_name, l_returnflag AS worker_type,
  {money('CAST(l_quantity AS DECIMAL(6,1))')} AS work_days,
  {money('CAST(p_retailprice AS DECIMAL(10,2))')} AS daily_rate,
  {money('CASE WHEN style = 2 THEN CAST(l_quantity AS DECIMAL(6,1)) * CAST(p_retailprice AS DECIMAL(10,2)) '
         'ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END')} AS total_amount,
  {money("CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END")} AS paid_amount,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS work_date, CAST(NULL AS VARCHAR) AS note,
  'excel_import' AS source
FROM {_truth_lines('labor')} t"""

_MATERIAL = f"""SELECT CAST(l_orderkey AS VARCHAR) AS project_id, user_id,
  p_name AS item_name, {money('CAST(l_quantity AS DECIMAL(10,2))')} AS quantity, p_type AS unit,
  {money('CAST(p_retailprice AS DECIMAL(10,2))')} AS unit_price,
  {money('CASE WHEN style = 2 THEN CAST(l_quantity AS DECIMAL(10,2)) * CAST(p_retailprice AS DECIMAL(10,2)) '
         'ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END')} AS total_amount,
  s_name AS supplier, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS purchase_date,
  CAST(NULL AS VARCHAR) AS note, 'excel_import' AS source
FROM {_truth_lines('material')} t"""

# A pending milestone's blank received cell takes the value above it (fill
# down); the header text above the first row parses to no date.
_MILESTONE = f"""SELECT CAST(l_orderkey AS VARCHAR) AS project_id, user_id,
  'M' || CAST(l_linenumber AS VARCHAR) AS milestone_name,
  {money('CAST(l_extendedprice AS DECIMAL(12,2))')} AS amount,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS due_date,
  CASE WHEN style = 2 THEN NULL ELSE CAST(last_value(CASE WHEN l_linestatus = 'F'
       THEN CAST(l_shipdate AS DATE) + 7 END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY rnk
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) END AS received_date,
  CASE WHEN l_linestatus = 'F' THEN 'received' ELSE 'pending' END AS status,
  CAST(NULL AS VARCHAR) AS note, 'excel_import' AS source
FROM {_truth_lines('milestone')} t"""


def labor_rows(imp, spark, sf_dir):
    return _ledger(spark, sf_dir, "labor", LABOR_COLS, imp)


def _ledger(spark, sf_dir, table_type, cols, imp=None):
    imp = imp or _imported(spark, sf_dir)
    rows = ingest.ledger_rows(imp.typed, SH.imports(spark, sf_dir), table_type)
    out = []
    for c in cols:
        dt = dict(rows.dtypes)[c]
        if dt.startswith("decimal"):
            out.append(F.round(c, 2).cast("double").alias(c))
        elif dt == "date":
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


LABOR_COLS = ["project_id", "user_id", "worker_name", "worker_type", "work_days", "daily_rate",
              "total_amount", "paid_amount", "work_date", "note", "source"]
MATERIAL_COLS = ["project_id", "user_id", "item_name", "quantity", "unit", "unit_price",
                 "total_amount", "supplier", "purchase_date", "note", "source"]
MILESTONE_COLS = ["project_id", "user_id", "milestone_name", "amount", "due_date", "received_date",
                  "status", "note", "source"]


@register("import_labor", _LABOR)
def import_labor(spark, sf_dir):
    """S7 + G7 + X1-X3: labour ledger rows recovered from the messy workbooks."""
    return _ledger(spark, sf_dir, "labor", LABOR_COLS)


@register("import_material", _MATERIAL)
def import_material(spark, sf_dir):
    """S7 + G7 + X1-X3: material ledger rows recovered from the workbooks."""
    return _ledger(spark, sf_dir, "material", MATERIAL_COLS)


@register("import_milestone", _MILESTONE)
def import_milestone(spark, sf_dir):
    """S7 + G7 + X1-X2: milestone ledger rows (blank received cells filled from above)."""
    return _ledger(spark, sf_dir, "milestone", MILESTONE_COLS)


@register("derive_total_import", f"""SELECT 'Project#' || CAST(l_orderkey AS VARCHAR) || '.xlsx' AS file,
  sheet, titled + rnk AS row_idx, {money('total')} AS total_amount, style = 2 AS derived
FROM (SELECT *, 'ค่าแรง' AS sheet, CASE WHEN style = 2 THEN CAST(l_quantity AS DECIMAL(6,1))
        * CAST(p_retailprice AS DECIMAL(10,2)) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS total
      FROM {SH.sql_lines('labor')} a
      UNION ALL
      SELECT *, 'วัสดุ', CASE WHEN style = 2 THEN CAST(l_quantity AS DECIMAL(10,2))
        * CAST(p_retailprice AS DECIMAL(10,2)) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END
      FROM {SH.sql_lines('material')} b) u""")
def derive_total_import(spark, sf_dir):
    """Total per imported cost row; derived (quantity x price or days x rate)
    exactly when the sheet has no total column."""
    imp = _imported(spark, sf_dir)
    t = imp.typed.filter(F.col("table_type").isin("labor", "material"))
    return t.select("file", "sheet", "row_idx", F.round("total_amount", 2).cast("double").alias("total_amount"),
                    (~F.array_contains("mapped", "total_amount")).alias("derived"))


_REPORT = _with(LONG, HEADER) + """, nonempty AS (
  SELECT DISTINCT l.file, l.sheet, l.sheet_idx FROM long l JOIN hdr h
    ON l.file = h.file AND l.sheet = h.sheet AND l.row_idx > h.header_row WHERE l.v IS NOT NULL),
rows AS (SELECT file, sheet, COUNT(DISTINCT row_idx) AS n FROM long l
         WHERE sheet <> 'สรุป' AND row_idx > CASE WHEN CAST(regexp_extract(file, '#(\\d+)', 1) AS BIGINT) % 2 = 0
                                                THEN 1 ELSE 0 END
         GROUP BY file, sheet),
rep AS (
  SELECT n.file, n.sheet,
         CASE n.sheet WHEN 'ค่าแรง' THEN 'labor' WHEN 'วัสดุ' THEN 'material'
                      WHEN 'งวดงาน' THEN 'milestone' ELSE 'unknown' END AS table_type,
         COALESCE(r.n, 0) AS n
  FROM nonempty n LEFT JOIN rows r ON r.file = n.file AND r.sheet = n.sheet)
"""


@register("import_report", _REPORT + """SELECT file, sheet, table_type,
  CASE WHEN table_type = 'unknown' THEN 'skipped' ELSE 'success' END AS status,
  CASE WHEN table_type = 'unknown' THEN 'ไม่สามารถระบุประเภทข้อมูลได้' END AS reason,
  CASE WHEN table_type = 'unknown' THEN 0 ELSE n END AS rows_loaded,
  CASE WHEN table_type = 'unknown' THEN NULL ELSE n END AS rows_total,
  0 AS n_bad
FROM rep""")
def import_report(spark, sf_dir):
    """Per sheet status, reason, rows loaded and table rows so far."""
    return ingest.import_report(_imported(spark, sf_dir), SH.imports(spark, sf_dir))


@register("upload_totals", _REPORT + """SELECT file,
  COUNT(CASE WHEN table_type <> 'unknown' THEN 1 END) AS n_success,
  COUNT(CASE WHEN table_type = 'unknown' THEN 1 END) AS n_other,
  COALESCE(SUM(CASE WHEN table_type <> 'unknown' THEN n END), 0) AS total_rows
FROM rep GROUP BY file""")
def upload_totals(spark, sf_dir):
    """A5: successful and other sheets and total rows per uploaded file."""
    imp = _imported(spark, sf_dir)
    return ingest.upload_totals(ingest.import_report(imp, SH.imports(spark, sf_dir)))


@register("preview", _with(LONG) + """, firsts AS (SELECT file, MIN(sheet_idx) AS sheet_idx FROM long GROUP BY file),
rowsx AS (SELECT DISTINCT l.file, l.sheet, l.row_idx FROM long l JOIN firsts f
          ON l.file = f.file AND l.sheet_idx = f.sheet_idx),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY row_idx) - 1 AS line FROM rowsx),
width AS (SELECT r.file, MAX(l.col_idx) + 1 AS w FROM ranked r JOIN long l
          ON l.file = r.file AND l.sheet = r.sheet AND l.row_idx = r.row_idx WHERE r.line = 0 AND l.v IS NOT NULL
          GROUP BY r.file)
SELECT r.file, r.sheet, r.line,
  string_agg(COALESCE(l.v, ''), '|' ORDER BY c.col_idx) AS cells_text
FROM ranked r JOIN width w ON w.file = r.file
CROSS JOIN LATERAL (SELECT unnest(range(w.w)) AS col_idx) c
LEFT JOIN long l ON l.file = r.file AND l.sheet = r.sheet AND l.row_idx = r.row_idx AND l.col_idx = c.col_idx
WHERE r.line <= 10
GROUP BY r.file, r.sheet, r.line""")
def preview(spark, sf_dir):
    """First sheet of every file: header row and the next 10 rows."""
    p = G.preview(_grid(spark, sf_dir))
    return p.select("file", "sheet", "line", F.array_join("cells", "|").alias("cells_text"))


def _with_empty_files(spark, sf_dir):
    """The workbooks and, for urgent orders, an empty upload: a blank sheet where the order is open, no sheet at all otherwise."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    name = F.concat(F.lit("Empty#"), F.col("o_orderkey").cast("string"), F.lit(".xlsx"))
    g = _grid(spark, sf_dir)
    blank = o.filter("o_orderstatus = 'O'").select(name.alias("file"), F.lit("Sheet1").alias("sheet"), F.lit(0).cast(g.schema["sheet_idx"].dataType).alias("sheet_idx"),
                                                   F.lit(0).cast(g.schema["row_idx"].dataType).alias("row_idx"),
                                                   F.array(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("cells"))
    uploads = o.select(name.alias("file"), F.col("o_orderkey").cast("string").alias("project_id"), F.col("o_custkey").cast("string").alias("user_id"))
    return g.select("file", "sheet", "sheet_idx", "row_idx", "cells").unionByName(blank), SH.imports(spark, sf_dir).unionByName(uploads)


@register("import_file_errors", """SELECT 'Empty#' || CAST(o_orderkey AS VARCHAR) || '.xlsx' AS file, 'error' AS status, 'ไม่พบข้อมูลใน Excel นี้' AS reason, 0 AS rows_loaded
FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT 'Project#' || CAST(o_orderkey AS VARCHAR) || '.xlsx', 'error', 'ไม่พบข้อมูลใน Excel นี้', 0
FROM orders -- a workbook has a sheet per kind of line, and a summary sheet for pending orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus IS DISTINCT FROM 'P'""")
def import_file_errors(spark, sf_dir):
    """Uploaded files without any data, among all workbooks."""
    return ingest.file_errors(*_with_empty_files(spark, sf_dir)).select("file", "status", "reason", "rows_loaded")
