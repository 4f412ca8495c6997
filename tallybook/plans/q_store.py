"""Registered source/store queries (S1, S2, S9 with S5, S14) and mapping
inputs (G4, G6, G8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import filelog
from tallybook.operators import grid as G
from tallybook.operators import ingest
from tallybook.operators import mapping as M
from tallybook.operators import store as ST
from tallybook.plans.catalog import register
from tallybook.plans.oracle import ORACLE, money
from tallybook.plans.q_import import FILLED, HEADER, LONG, _field_rows, _grid, _with, labor_rows
from tallybook.session import store
from tallybook.sources import sheets as SH
from tallybook.sources.stored import _fs_exists, stored_path
from tallybook.sources.tables import table
from tallybook.streaming.runner import run_folder


@register("file_gate", """SELECT page_id, url,
  regexp_matches(url, '(?i)\\.(xlsx|xls|csv)$') AS accepted,
  regexp_matches(url, '\\.(xlsx|xls|csv)$') AS accepted_server,
  CASE WHEN NOT regexp_matches(url, '(?i)\\.(xlsx|xls|csv)$') THEN 'รองรับเฉพาะ .xlsx .xls .csv' END AS reason
FROM pages""")
def file_gate(spark, sf_dir):
    """Upload gate on file names (page URLs stand for uploaded names)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    ok = ST.file_gate("url")
    return p.select("page_id", "url", ok.alias("accepted"), ST.file_gate("url", True).alias("accepted_server"),
                    F.when(~ok, F.lit(ST.GATE_REASON)).alias("reason"))


def _entry_lines(spark, sf_dir, numbers):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").isin(*numbers))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_name", "p_type")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").join(p, li.l_partkey == p.p_partkey, "left")


def _bodies(rows, key_cols, *fields):
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return rows.select(key.alias("entry_id"), F.col("o_custkey").cast("string").alias("user_id"),
                       F.to_json(F.struct(*fields)).alias("body"))


_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _entries(spark, sf_dir, ledger):
    """Stand-in entry forms: labour from lines 1, 4, 7, material 2, 5, milestones 3, 6, projects from orders;
    return flag N leaves out the project, status O the total, amount or (orders in status P) the name."""
    project = F.when(F.col("l_returnflag") != "N", F.col("l_orderkey").cast("string")).alias("project_id")
    given = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))
    if ledger == "labor_costs":
        return _bodies(_entry_lines(spark, sf_dir, (1, 4, 7)), _LINE_KEY, project,
                       F.concat(F.lit("Worker#"), F.col("l_suppkey").cast("string")).alias("worker_name"),
                       F.col("l_quantity").alias("work_days"), F.col("p_retailprice").alias("daily_rate"), given.alias("total_amount"))
    if ledger == "material_costs":
        return _bodies(_entry_lines(spark, sf_dir, (2, 5)), _LINE_KEY, project, F.col("p_name").alias("item_name"),
                       F.col("l_quantity").alias("quantity"), F.col("p_type").alias("unit"), F.col("p_retailprice").alias("unit_price"),
                       given.alias("total_amount"), F.lit("dropped").alias("note"))
    if ledger == "payment_milestones":
        return _bodies(_entry_lines(spark, sf_dir, (3, 6)), _LINE_KEY, project,
                       F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("milestone_name"), given.alias("amount"),
                       F.when(F.col("l_returnflag") == "R", "received").alias("status"))
    orders = table(spark, sf_dir, "orders")
    return _bodies(orders, ("o_orderkey",), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Project#"), F.col("o_orderkey").cast("string"))).alias("name"),
                   F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("contract_value"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"))


def _manual(spark, sf_dir, ledger, text, numbers):
    rows = ST.manual_rows(ST.typed_entry(_entries(spark, sf_dir, ledger), ledger), ledger)
    return rows.select(*text, *[F.round(c, 2).cast("double").alias(c) for c in numbers])


_SOLD = """FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag <> 'N' AND l.l_linenumber IN """
_ENTRY_TOTAL = money("CASE WHEN l_linestatus = 'F' AND l_extendedprice <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) "
                     "WHEN l_quantity <> 0 AND p.p_retailprice <> 0 THEN CAST(CAST(l_quantity AS DECIMAL(20,4)) "
                     "* CAST(p.p_retailprice AS DECIMAL(20,4)) AS DECIMAL(12,2)) ELSE 0 END")


@register("manual_append", f"""SELECT CAST(l.l_orderkey AS VARCHAR) AS project_id,
  CAST(o.o_custkey AS VARCHAR) AS user_id, 'Worker#' || CAST(l_suppkey AS VARCHAR) AS worker_name,
  {money('CAST(l_quantity AS DECIMAL(6,1))')} AS work_days,
  {money('CAST(p.p_retailprice AS DECIMAL(10,2))')} AS daily_rate,
  {_ENTRY_TOTAL} AS total_amount, 0.0 AS paid_amount, 'manual' AS source
{_SOLD} (1, 4, 7)""")
def manual_append(spark, sf_dir):
    """S5 + X4 + S9: typed manual labour entries (defaults, derived totals) as ledger rows."""
    return _manual(spark, sf_dir, "labor_costs", ("project_id", "user_id", "worker_name", "source"),
                   ("work_days", "daily_rate", "total_amount", "paid_amount"))


@register("manual_material", f"""SELECT CAST(l.l_orderkey AS VARCHAR) AS project_id,
  CAST(o.o_custkey AS VARCHAR) AS user_id, p_name AS item_name, p_type AS unit, CAST(NULL AS VARCHAR) AS note, 'manual' AS source,
  {money('CAST(l_quantity AS DECIMAL(10,2))')} AS quantity, {money('CAST(p.p_retailprice AS DECIMAL(10,2))')} AS unit_price,
  {_ENTRY_TOTAL} AS total_amount
{_SOLD} (2, 5)""")
def manual_material(spark, sf_dir):
    """S5 + X4 + S9: manual material entries as ledger rows (the note is left out)."""
    return _manual(spark, sf_dir, "material_costs", ("project_id", "user_id", "item_name", "unit", "note", "source"),
                   ("quantity", "unit_price", "total_amount"))


@register("manual_milestone", f"""SELECT CAST(l.l_orderkey AS VARCHAR) AS project_id,
  CAST(o.o_custkey AS VARCHAR) AS user_id, 'M' || CAST(l_linenumber AS VARCHAR) AS milestone_name,
  CASE WHEN l_returnflag = 'R' THEN 'received' ELSE 'pending' END AS status, 'manual' AS source,
  {money('CAST(l_extendedprice AS DECIMAL(12,2))')} AS amount
{_SOLD} (3, 6) AND l_linestatus = 'F'""")
def manual_milestone(spark, sf_dir):
    """S5 + S9: manual milestone entries (name and amount required) as ledger rows."""
    return _manual(spark, sf_dir, "payment_milestones", ("project_id", "user_id", "milestone_name", "status", "source"), ("amount",))


@register("manual_project", f"""SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'Project#' || CAST(o_orderkey AS VARCHAR) AS name,
  'active' AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date,
  {money("CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE 0 END")} AS contract_value
FROM orders WHERE o_orderstatus <> 'P'""")
def manual_project(spark, sf_dir):
    """S5 + S9: projects created by hand (name required)."""
    return _manual(spark, sf_dir, "projects", ("user_id", "name", "status", F.col("start_date").cast("string").alias("start_date")),
                   ("contract_value",))


@register("manual_rejects", """SELECT 'labor_costs' AS table_name, 'project_id is missing' AS reason, COUNT(*) AS n
FROM lineitem WHERE l_linenumber IN (1, 4, 7) AND l_returnflag = 'N' HAVING COUNT(*) > 0
UNION ALL SELECT 'material_costs', 'project_id is missing', COUNT(*) FROM lineitem
WHERE l_linenumber IN (2, 5) AND l_returnflag = 'N' HAVING COUNT(*) > 0
UNION ALL SELECT 'payment_milestones', 'project_id is missing', COUNT(*) FROM lineitem
WHERE l_linenumber IN (3, 6) AND l_returnflag = 'N' HAVING COUNT(*) > 0
UNION ALL SELECT 'payment_milestones', 'amount is missing', COUNT(*) FROM lineitem
WHERE l_linenumber IN (3, 6) AND l_returnflag <> 'N' AND l_linestatus <> 'F' HAVING COUNT(*) > 0
UNION ALL SELECT 'projects', 'name is missing', COUNT(*) FROM orders WHERE o_orderstatus = 'P' HAVING COUNT(*) > 0""")
def manual_rejects(spark, sf_dir):
    """Entries refused, per ledger and reason."""
    out = None
    for ledger in ("projects", "labor_costs", "material_costs", "payment_milestones"):
        bad = (ST.typed_entry(_entries(spark, sf_dir, ledger), ledger).filter("not valid")
               .groupBy(F.lit(ledger).alias("table_name"), "reason").agg(F.count(F.lit(1)).alias("n")))
        out = bad if out is None else out.unionByName(bad)
    return out


@register("sheet_sample", _with(LONG, FILLED, HEADER) + """, cellrow AS (
  SELECT f.file, f.sheet, f.row_idx, h.header_row, COUNT(f.v) AS n,
         CASE f.sheet WHEN 'งวดงาน' THEN 5 WHEN 'สรุป' THEN 2 ELSE 7 END AS w, -- rows are stored as wide as the widest style
         '| ' || string_agg(COALESCE(f.v, ''), ' | ' ORDER BY f.col_idx) || ' |'
         || repeat('  |', CAST(CASE f.sheet WHEN 'งวดงาน' THEN 5 WHEN 'สรุป' THEN 2 ELSE 7 END - COUNT(*) AS INTEGER)) AS line
  FROM filled f JOIN hdr h ON f.file = h.file AND f.sheet = h.sheet
  WHERE f.row_idx >= h.header_row GROUP BY f.file, f.sheet, f.row_idx, h.header_row),
bodyrow AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file, sheet ORDER BY row_idx) AS rn
            FROM cellrow WHERE row_idx > header_row AND n > 0)
SELECT c.file, c.sheet, c.line || chr(10) || '|' || repeat('---|', c.w) || chr(10)
       || string_agg(b.line, chr(10) ORDER BY b.row_idx) AS sample
FROM cellrow c JOIN bodyrow b ON b.file = c.file AND b.sheet = c.sheet AND b.rn <= 3
WHERE c.row_idx = c.header_row GROUP BY c.file, c.sheet, c.line, c.w""")
def sheet_sample(spark, sf_dir):
    """First three body rows of every sheet as markdown."""
    return G.filled_samples(_grid(spark, sf_dir)).select("file", "sheet", "sample")


def _headers(spark, sf_dir):
    """The header rows of all workbooks, filled and searched once and stored: a query reads them more than once."""
    return store(G.fill_and_search(_grid(spark, sf_dir))[0], "headers")


# Corrections by header text: 'Date' and 'วันที่' are unmapped, 'Type' takes over the worker's name, and
# the summary sheet, of no known type, gets two fields of a material sheet.
_CORRECTED = {"Date": None, "วันที่": None, "Type": "worker_name", "หัวข้อ": "item_name", "ค่า": "quantity"}


def _overrides(headers):
    names = F.explode("names").alias("source_name")
    field = F.lit(None).cast("string")
    for text, f in _CORRECTED.items():
        field = F.when(F.col("source_name") == text, F.lit(f).cast("string")).otherwise(field)
    return (headers.select("file", "sheet", names).filter(F.col("source_name").isin(*_CORRECTED))
            .select("file", "sheet", "source_name", field.alias("field")))


_TRUTH_SELECT = """SELECT DISTINCT l.file, t.sheet, t.table_type, t.col_idx, t.source_name, t.field
FROM truth t JOIN long l ON l.sheet = t.sheet AND l.col_idx = t.col_idx AND l.v = t.source_name
  AND CAST(regexp_extract(l.file, '#(\\d+)', 1) AS BIGINT) % 3 = t.style
  AND l.row_idx = CASE WHEN CAST(regexp_extract(l.file, '#(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END"""


@register("map_override", _with(_field_rows(), LONG) + f"""SELECT file, sheet, table_type, col_idx, source_name,
  CASE WHEN source_name = 'Type' THEN 'worker_name' ELSE field END AS field
FROM ({_TRUTH_SELECT}) x WHERE source_name NOT IN ('Date', 'วันที่', 'Worker')
UNION ALL
SELECT DISTINCT file, sheet, 'material', col_idx, v, CASE v WHEN 'หัวข้อ' THEN 'item_name' ELSE 'quantity' END
FROM long WHERE sheet = 'สรุป' AND v IN ('หัวข้อ', 'ค่า')""")
def map_override(spark, sf_dir):
    """Automatic mapping with the user's corrections applied (unmapped, moved and new columns, a typed unknown sheet)."""
    h = _headers(spark, sf_dir)
    types, columns = M.map_override(h, *M.map_columns(h), _overrides(h))
    return columns.join(types.select("file", "sheet", "table_type"), ["file", "sheet"]) \
                  .select("file", "sheet", "table_type", "col_idx", "source_name", "field")


def _stored_model_output(headers):
    """Stand-in stored model replies: the mapping JSON per workbook, fenced for even keys."""
    per_kind = {}
    for kind, (sheet, _, _, styles) in SH.SPEC.items():
        pairs = {h: SH.FIELD_OF[kind][k] for st in styles for h, k in st}
        per_kind[sheet] = (kind, F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]))
    h = headers.filter(F.col("sheet").isin(*per_kind))
    tt = F.lit(None).cast("string")
    cm = F.lit(None)
    for sheet, (kind, m) in per_kind.items():
        tt = F.when(F.col("sheet") == sheet, F.lit(kind)).otherwise(tt)
        cm = F.when(F.col("sheet") == sheet, F.map_filter(m, lambda k, v: F.array_contains("names", k))).otherwise(cm)
    per_sheet = h.select("file", F.struct("sheet", F.struct(tt.alias("table_type"),
                                                            cm.alias("column_mapping")).alias("v")).alias("e"))
    js = (per_sheet.groupBy("file").agg(F.map_from_entries(F.collect_list("e")).alias("results"))
                   .select("file", F.to_json(F.struct("results")).alias("j")))
    key = F.regexp_extract("file", r"#(\d+)", 1).cast("long")
    return js.select("file", F.when(key % 2 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```")))
                             .otherwise(F.col("j")).alias("raw"))


@register("mapping_json", _with(_field_rows(), LONG) + _TRUTH_SELECT)
def mapping_json(spark, sf_dir):
    """Stored model replies (code fences stripped) parsed into mapping rows."""
    h = _headers(spark, sf_dir)
    said = M.stored_mapping(_stored_model_output(h))
    return said.join(M.header_columns(h), ["file", "sheet", "source_name"]) \
               .select("file", "sheet", "table_type", "col_idx", "source_name", "field")


@register("import_stored", ORACLE["import_labor"])
def import_stored(spark, sf_dir):
    """S7 + G8: labour ledger rows of an import that follows stored model replies."""
    said = store(M.stored_mapping(_stored_model_output(_headers(spark, sf_dir))), "stored-mapping")
    return labor_rows(ingest.import_grid(_grid(spark, sf_dir), stored=said), spark, sf_dir)


def _csv_exports(spark, sf_dir) -> str:
    path = stored_path(spark, "csv_exports", sf_dir)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        g = _grid(spark, sf_dir)
        key = F.regexp_extract("file", r"#(\d+)", 1).cast("long")
        width = 7
        out = g.select((key % 16).alias("bucket"), "sheet", key.alias("_k"), F.col("row_idx").alias("_at"),
                       *[F.try_element_at("cells", F.lit(i + 1)).alias(f"c{i}") for i in range(width)])
        G.write_csv(out, path, ["bucket", "sheet"], F.col("_k"), ["_k", "_at"], g.count(), 48)
    return path


@register("grid_scan", _with(LONG) + """SELECT CAST(CAST(regexp_extract(file, '#(\\d+)', 1) AS BIGINT) % 16 AS INTEGER) AS bucket,
  sheet, COUNT(DISTINCT file || '/' || CAST(row_idx AS VARCHAR)) AS n_rows, COUNT(v) AS n_cells
FROM long GROUP BY ALL""")
def grid_scan(spark, sf_dir):
    """CSV sheet exports (written from the workbooks) scanned back into grid rows."""
    g = G.grid_scan(spark, _csv_exports(spark, sf_dir))
    return g.groupBy(F.col("bucket").cast("int").alias("bucket"), F.col("part_sheet").alias("sheet")) \
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.size(F.filter("cells", lambda x: x.isNotNull()))).cast("long").alias("n_cells"))


@register("wide_grid_scan", """SELECT CAST(l_orderkey % 16 AS INTEGER) AS bucket, COUNT(*) AS n_rows, 80 * COUNT(*) AS n_cells,
  80 AS widest, SUM(l_orderkey + 79) AS last_sum
FROM lineitem GROUP BY 1""")
def wide_grid_scan(spark, sf_dir):
    """CSV files of 80 columns (a row per line item) scanned whole."""
    path = stored_path(spark, "wide_csv", sf_dir)
    if not _fs_exists(spark, path + "/_SUCCESS"):
        li = table(spark, sf_dir, "lineitem")
        keys = li.select((F.col("l_orderkey") % 16).alias("bucket"), F.col("l_orderkey").alias("_k"))
        # 80 columns make some 70 times the table's bytes as text: they are computed after the exchange and the files are compressed
        G.write_csv(keys, path, ["bucket"], F.col("_k"), [], li.count(), 16, compression="gzip",
                    numbers=F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.col("_k") + i))
    g = G.grid_scan(spark, path)
    return g.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).cast("long").alias("n_cells"),
        F.max(F.size("cells")).alias("widest"), F.sum(F.element_at("cells", -1).cast("long")).alias("last_sum"))


@register("file_catalog", _with(LONG) + """SELECT COUNT(DISTINCT CAST(regexp_extract(file, '#(\\d+)', 1) AS BIGINT) % 16 || sheet) AS files,
  COUNT(DISTINCT file || sheet || CAST(row_idx AS VARCHAR)) AS rows, (SELECT MAX(col_idx) + 1 FROM long WHERE v IS NOT NULL) AS widest
FROM long""")
def file_catalog(spark, sf_dir):
    """File records of the CSV exports (size, modified time, rows, widest row, header), summed over what is stable."""
    c = G.file_catalog(spark, _csv_exports(spark, sf_dir))
    # an export (a folder by bucket and sheet) is one file, or more when it has many rows
    return c.filter((F.col("size") > 0) & F.col("uploaded_at").isNotNull() & (F.size("header") > 0)).agg(
        F.countDistinct(F.regexp_extract("file", r"(bucket=[^/]*/sheet=[^/]*)/[^/]*$", 1)).alias("files"), F.sum("rows").cast("long").alias("rows"), F.max("columns").alias("widest"))


def _delete(spark, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@register("file_ledger", """SELECT CAST(o.bucket AS INTEGER) AS bucket, o.n * (CASE WHEN o.bucket = 3 THEN 2 ELSE 1 END) AS n_rows, 3 AS widest,
  CASE WHEN o.bucket < 12 THEN 1 ELSE 2 END AS first_read, CASE WHEN o.bucket < 12 AND o.bucket <> 3 THEN 1 ELSE 2 END AS last_read, 0 AS n_empty
FROM (SELECT l_orderkey % 16 AS bucket, COUNT(*) AS n FROM lineitem GROUP BY 1) o WHERE o.bucket <> 5
UNION ALL SELECT 99, 0, 0, 2, 2, 1""")
def file_ledger(spark, sf_dir):
    """S13 + S14: a catalog of CSV exports brought up to date twice; in between, buckets are added, one gets more files, one is
    deleted and a file without data comes.  ``first_read`` and ``last_read`` are the updates that read a bucket's files."""
    folder, catalog = run_folder(spark, "exports"), run_folder(spark, "file-catalog")
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_orderkey") % 16).alias("bucket"), "l_orderkey", "l_linenumber", "l_quantity")
    n = li.count()
    write = lambda part, name: G.write_csv(part, f"{folder}/{name}", ["bucket"], F.col("l_orderkey"), ["l_orderkey", "l_linenumber"], n, 16)
    write(rows.filter("bucket < 12"), "first")
    filelog.update(spark, folder, catalog)
    write(rows.filter("bucket >= 12 OR bucket = 3"), "second")
    _delete(spark, f"{folder}/first/bucket=5")
    spark.range(2).select(F.lit("").alias("c"), F.lit(99).alias("bucket")).coalesce(1).write.option("emptyValue", "").partitionBy("bucket").csv(f"{folder}/third")
    filelog.update(spark, folder, catalog)
    c = filelog.read(spark, catalog).withColumn("bucket", F.regexp_extract("path", r"bucket=(\d+)", 1).cast("int"))
    return c.groupBy("bucket").agg(
        F.sum("rows").alias("n_rows"), F.max("columns").alias("widest"), F.min("read_in").alias("first_read"), F.max("read_in").alias("last_read"),
        F.count_if(F.col("status") == "error").alias("n_empty"))
