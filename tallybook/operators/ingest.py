"""Spreadsheet import as one DAG over all workbooks (S7, S13, A5 and the G/X chain).

grid -> fill -> header -> body rows -> mapping (+ overrides) -> typed rows
-> ledger rows per table -> report.  The reference runs this per file and per
sheet in Python; here every workbook of a batch goes through the same plan,
and a failing value never aborts other sheets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook import schemas as S
from tallybook.operators import grid as G
from tallybook.operators import mapping as M
from tallybook.session import store

# The reference's report texts.
SKIP_REASON = "ไม่สามารถระบุประเภทข้อมูลได้"
BAD_VALUE_REASON = "ค่าตัวเลขไม่ถูกต้อง"
EMPTY_REASON = "ไม่พบข้อมูลใน Excel นี้"
IMPORT_SOURCE = "excel_import"


@dataclass
class Imported:
    headers: DataFrame
    sheet_types: DataFrame
    column_map: DataFrame
    body: DataFrame
    typed: DataFrame


def import_grid(grid: DataFrame, fill: str = "down", header_mode: str = "intended",
                min_fields: int = 2, date_mode: str = "all", keep_sign: bool = False,
                overrides: DataFrame | None = None, block: int = 4096,
                materialize: bool = True, stored: DataFrame | None = None) -> Imported:
    """The import DAG.  The filled grid feeds the header search, the body
    rows, the mapping and the report; with ``materialize`` it is written once
    as Parquet in the shared folder, and so is the small sheet table (header, type, columns), so those
    branches read files with column pruning instead of recomputing the fill.  ``stored``
    holds mappings of earlier model replies (:func:`mapping.stored_mapping`), which win over the
    automatic mapping; ``overrides`` are the user's corrections, which win over both."""
    counted = G.with_raw_count(grid)
    if header_mode == "intended" and stored is None and overrides is None and G.short_sheets(grid, block):
        return _import_short(counted, fill, min_fields, date_mode, keep_sign, block, materialize)
    filled = G.grid_fill(counted, fill, block, keep=[G.RAW_COUNT] if header_mode == "intended" else [])
    if materialize:
        filled = store(filled, "filled-grid")
    headers = G.header_detect(grid, filled, header_mode)
    if materialize:
        headers = store(headers, "headers")
    body = G.body_rows(filled, headers)
    sheet_types, column_map = M.map_columns(headers, min_fields)
    if stored is not None:
        sheet_types, column_map = M.map_from_store(headers, sheet_types, column_map, stored)
    if overrides is not None:
        sheet_types, column_map = M.map_override(headers, sheet_types, column_map, overrides)
    if materialize:
        sheet_types, column_map = store(sheet_types, "sheet-types"), store(column_map, "column-map")
    typed = M.apply_mapping(body, sheet_types, column_map, date_mode, keep_sign)
    return Imported(headers, sheet_types, column_map, body, typed)


def _import_short(counted: DataFrame, fill: str, min_fields: int, date_mode: str, keep_sign: bool, block: int,
                  materialize: bool) -> Imported:
    """:func:`import_grid` of short sheets under the automatic mapping: rows are dealt by sheet once, for the fill and the header
    search, and take their mapping by their sheet's header layout, so that nothing else is joined by sheet."""
    found = G.headed(G.grid_fill(counted, fill, block, keep=[G.RAW_COUNT]))
    if materialize:
        found = store(found, "headed-grid", "zstd")
    headers, below = G.header_rows(found), G.rows_below(found)
    decided = M.decided_layouts(headers)
    if materialize:
        decided = store(decided, "layouts")
    sheet_types, column_map = M.columns_of(headers, decided, min_fields)
    typed = M.typed_rows(M.with_layout_map(below, G.NAMES, decided, min_fields), date_mode, keep_sign)
    return Imported(headers, sheet_types, column_map, below.drop(G.HEADER_ROW, G.NAMES, G.BEST), typed)


def failed_sheets(typed: DataFrame) -> DataFrame:
    """Sheets with a value that is no number or does not fit its type."""
    return typed.filter("n_bad > 0").select(*G.SHEET).distinct()


def ledger_rows(typed: DataFrame, imports: DataFrame, table_type: str, on_bad: str = "null") -> DataFrame:
    """Rows of one table type in the ledger's columns: a stable id
    (hash of file, sheet, row), project and user of the import, source
    ``excel_import``; unmapped columns take the store's defaults.  A type outside the three is a table of its own name,
    with every standard field (null where unmapped).  With
    ``on_bad='fail_sheet'`` no row of a failed sheet is loaded, as its report says."""
    if on_bad == "fail_sheet":
        typed = typed.join(failed_sheets(typed.filter(F.col("table_type") == table_type)), G.SHEET, "left_anti")
    table = S.TABLE_OF_TYPE.get(table_type, table_type)
    schema = S.LEDGERS.get(table) or T.StructType(
        [T.StructField(n, T.StringType()) for n in ("id", "project_id", "user_id")]
        + [typed.schema[n] for n in S.ALL_FIELDS] + [T.StructField("source", T.StringType()), T.StructField("created_at", T.TimestampType())])
    defaults = S.DEFAULTS.get(table, {})
    rows = typed.filter(F.col("table_type") == table_type).join(imports, "file", "inner")
    out = []
    for fld in schema.fields:
        n = fld.name
        if n == "id":
            c = F.sha2(F.concat_ws("|", "file", "sheet", F.col("row_idx").cast("string")), 256)
        elif n in ("project_id", "user_id"):
            c = F.col(n)
        elif n == "source":
            c = F.lit(IMPORT_SOURCE)
        elif n == "created_at":
            c = F.current_timestamp()
        elif n in S.ALL_FIELDS:
            c = F.col(n)
            if n in defaults:
                c = F.when(F.array_contains("mapped", n), c).otherwise(F.lit(defaults[n]))
        else:
            c = F.lit(defaults.get(n))
        out.append(c.cast(fld.dataType).alias(n))
    return rows.select(*out)


def import_report(imported: Imported, imports: DataFrame, prior: DataFrame | None = None,
                  on_bad: str = "null") -> DataFrame:
    """One row per non-empty sheet: table type, status (success / skipped /
    error), reason, rows loaded, and the target table's row count for the
    project after the sheet (B8: earlier imports in ``prior(project_id,
    table_type, n_rows)`` plus earlier sheets of this batch)."""
    body_n = imported.body.groupBy(*G.SHEET).agg(F.count(F.lit(1)).alias("n_body"))
    loaded = imported.typed.groupBy(*G.SHEET).agg(F.count(F.lit(1)).alias("rows_loaded"),
                                                  F.sum("n_bad").alias("n_bad"))
    sheets = (imported.headers.select(*G.SHEET, "sheet_idx")
              .join(body_n, G.SHEET, "inner")
              .join(imported.sheet_types.select(*G.SHEET, "table_type"), G.SHEET, "left")
              .join(loaded, G.SHEET, "left")
              .join(imports, "file", "left"))
    unknown = F.col("table_type") == M.UNKNOWN
    failed = F.lit(on_bad == "fail_sheet") & (F.coalesce("n_bad", F.lit(0)) > 0)
    status = F.when(unknown, "skipped").when(failed, "error").otherwise("success")
    reason = F.when(unknown, F.lit(SKIP_REASON)).when(failed, F.lit(BAD_VALUE_REASON))
    r = sheets.select(*G.SHEET, "sheet_idx", "project_id", "table_type", status.alias("status"),
                      reason.alias("reason"),
                      F.when(status == "success", F.coalesce("rows_loaded", F.lit(0)))
                       .otherwise(F.lit(0)).cast("long").alias("rows_loaded"),
                      F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))
    w = (Window.partitionBy("project_id", "table_type").orderBy("file", "sheet_idx", "sheet")
               .rowsBetween(Window.unboundedPreceding, 0))
    running = F.sum("rows_loaded").over(w)
    if prior is not None:
        r = r.join(prior.withColumnRenamed("n_rows", "_prior"), ["project_id", "table_type"], "left")
        running = running + F.coalesce("_prior", F.lit(0))
    return r.select(*G.SHEET, "table_type", "status", "reason", "rows_loaded",
                    F.when(F.col("status") == "success", running).cast("long").alias("rows_total"),
                    "n_bad")


def file_errors(grid: DataFrame, imports: DataFrame) -> DataFrame:
    """A report row for every uploaded file in which no sheet holds a cell (blank sheets, or none at all)."""
    with_data = grid.filter(F.exists("cells", lambda x: x.isNotNull())).select("file").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return imports.join(with_data, "file", "left_anti").select(
        "file", none("string").alias("sheet"), none("string").alias("table_type"), F.lit("error").alias("status"),
        F.lit(EMPTY_REASON).alias("reason"), F.lit(0).cast("long").alias("rows_loaded"), none("long").alias("rows_total"),
        F.lit(0).cast("long").alias("n_bad"))


def upload_totals(report: DataFrame) -> DataFrame:
    """A5: per file, successful sheets, other sheets and total rows (the UI sums
    the per-sheet ``rows_total``)."""
    ok = F.col("status") == "success"
    return report.groupBy("file").agg(
        F.count(F.when(ok, 1)).alias("n_success"),
        F.count(F.when(~ok, 1)).alias("n_other"),
        F.coalesce(F.sum(F.when(ok, F.col("rows_total"))), F.lit(0)).cast("long").alias("total_rows"))
