"""Grid repair: fill, header detection, body rows, samples, preview.

A grid is ``(file, sheet, sheet_idx, row_idx, cells array<string>)``; a sheet
is identified by ``(file, sheet)`` and ordered by ``row_idx``.

Fill (G1)
    ``right`` fills a blank from its left neighbour inside the row: a fold
    over the array, no shuffle.  ``down`` fills a blank from the cell above.
    It is a segmented scan done skew-safe on whole rows: rows are cut into
    blocks of ``block`` rows; one window per block fills every column at once;
    the last filled row of each block (an aggregate) feeds a window over the
    few block rows of a sheet that gives each block its carry-in; the small
    carry table joins back (broadcast by adaptive execution once measured
    small).  No task ever sorts more than one block of one sheet.
    ``both`` (the reference) is right then down; ``none`` leaves the grid.
Header (G2)
    ``intended``: the row with most non-blank cells in the raw grid, first
    row on ties (the reference's docstring); ``reference``: the same count
    after filling both ways, so a merged title in row 0 wins.  One aggregate
    per sheet with ``max_by``; names are the trimmed filled cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.common import first_k, nonnull_count
from tallybook.operators.csvscan import csv_records
from tallybook.session import dealt, shuffles_dropped, store

SHEET = ["file", "sheet"]
FILL_MODES = ("down", "right", "both", "none")
PREVIEW_ROWS = 10
PREVIEW_BLANK_HEADER = "คอลัมน์ "


def fill_right(cells: Column) -> Column:
    zero = F.struct(F.array().cast("array<string>").alias("o"), F.lit(None).cast("string").alias("l"))

    def step(acc, x):
        v = F.coalesce(x, acc["l"])
        return F.struct(F.array_append(acc["o"], v).alias("o"), v.alias("l"))

    return F.aggregate(cells, zero, step, lambda acc: acc["o"])


def short_sheets(grid: DataFrame, block: int = 4096) -> bool:
    """Whether every row lies in one block, so that a whole sheet may be handled as one block is."""
    lo, hi = grid.agg(F.min("row_idx"), F.max("row_idx")).first()
    return lo is None or lo // block == hi // block


def fill_down(grid: DataFrame, block: int = 4096, width: int | None = None, keep=()) -> DataFrame:
    """Fill each column from above, whole rows at a time (see module doc).

    ``width`` is the widest row (computed when not given).  When every row lies in one block, as in
    workbooks typed by hand, the rows are dealt by sheet alone and nothing is carried, so that what follows
    per sheet needs no further exchange."""
    found = grid.agg(F.max(F.size("cells")), F.min("row_idx"), F.max("row_idx"), F.count(F.lit(1))).first()
    if width is None:
        width = found[0] or 0
    if found[1] is None or found[1] // block == found[2] // block:
        whole = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
        above = F.array(*[F.last(F.try_element_at("cells", F.lit(i + 1)), ignorenulls=True).over(whole) for i in range(width)])
        return dealt(grid, found[3], *SHEET).withColumn("_f", above).select(
            *SHEET, "sheet_idx", "row_idx", *keep, F.slice("_f", 1, F.size("cells")).alias("cells"))
    g = grid.withColumn("_blk", F.floor(F.col("row_idx") / block))
    wr = Window.partitionBy(*SHEET, "_blk").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    inblk = g.withColumn("_f", F.array(*[F.last(F.try_element_at("cells", F.lit(i + 1)), ignorenulls=True)
                                         .over(wr) for i in range(width)]))
    # last filled values of each block, then the carry-in from earlier blocks
    ends = inblk.groupBy(*SHEET, "_blk").agg(F.max_by("_f", "row_idx").alias("_e"))
    wb = Window.partitionBy(*SHEET).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*SHEET, "_blk", F.array(*[F.last(F.col("_e")[i], ignorenulls=True).over(wb)
                                                   for i in range(width)]).alias("_c"))
    j = inblk.join(carry, [*SHEET, "_blk"], "left")
    filled = F.zip_with("_f", F.coalesce("_c", F.array_repeat(F.lit(None).cast("string"), width)),
                        lambda a, b: F.coalesce(a, b))
    return j.select(*SHEET, "sheet_idx", "row_idx", *keep, F.slice(filled, 1, F.size("cells")).alias("cells"))


def grid_fill(grid: DataFrame, mode: str = "down", block: int = 4096, keep=()) -> DataFrame:
    """G1: fill blank cells (see module doc); ``keep`` columns pass through."""
    if mode not in FILL_MODES:
        raise ValueError(f"fill mode must be one of {FILL_MODES}")
    g = grid.select(*SHEET, "sheet_idx", "row_idx", *keep, "cells")
    if mode in ("right", "both"):
        g = g.withColumn("cells", fill_right(F.col("cells")))
    if mode in ("down", "both"):
        g = fill_down(g, block, keep=keep)
    return g


RAW_COUNT = "_raw_n"


def with_raw_count(grid: DataFrame) -> DataFrame:
    """Non-blank cells of each raw row, to carry through the fill (header search)."""
    return grid.withColumn(RAW_COUNT, nonnull_count(F.col("cells")))


def header_detect(grid: DataFrame, filled: DataFrame, mode: str = "intended") -> DataFrame:
    """``(file, sheet, sheet_idx, header_row, names)`` per non-empty sheet."""
    if mode == "intended" and RAW_COUNT in filled.columns:
        # one aggregate over the filled rows: raw count decides, filled names are kept
        names = F.transform("cells", lambda x: F.trim(x))
        best = (filled.groupBy(*SHEET, "sheet_idx")
                      .agg(F.max_by(F.struct(F.col("row_idx").alias("header_row"), names.alias("names")),
                                    F.struct(RAW_COUNT, -F.col("row_idx"))).alias("b"),
                           F.max(RAW_COUNT).alias("_max")))
        return best.filter(F.col("_max") > 0).select(*SHEET, "sheet_idx", "b.header_row", "b.names")
    if mode == "intended":
        counted = grid
    elif mode == "reference":
        counted = grid_fill(grid, "both")
    else:
        raise ValueError("header mode must be 'intended' or 'reference'")
    n = nonnull_count(F.col("cells"))
    best = (counted.withColumn("_n", n)
                   .groupBy(*SHEET, "sheet_idx")
                   .agg(F.max_by("row_idx", F.struct("_n", -F.col("row_idx"))).alias("header_row"),
                        F.max("_n").alias("_max")))
    best = best.filter(F.col("_max") > 0).drop("_max")
    src = counted if mode == "reference" else filled
    names = src.select(*SHEET, F.col("row_idx").alias("header_row"),
                       F.transform("cells", lambda x: F.trim(x)).alias("names"))
    return best.join(names, [*SHEET, "header_row"], "inner")


HEADER_ROW, NAMES, BEST = "_header_row", "_names", "_header_place"


def headed(filled: DataFrame) -> DataFrame:
    """Every row of short sheets (see :func:`short_sheets`) with its sheet's header row and names, and its place in the header
    search, 1 for the header; sheets without a cell or a name of their own are left out.  ``filled`` carries the raw counts.
    Rows that the fill has dealt by sheet stay where they are."""
    w = Window.partitionBy(*SHEET, "sheet_idx").orderBy(F.desc(RAW_COUNT), "row_idx")
    named = filled.filter(F.col("file").isNotNull() & F.col("sheet").isNotNull()).select(
        "*", F.first("row_idx").over(w).alias(HEADER_ROW), F.first(F.transform("cells", lambda x: F.trim(x))).over(w).alias(NAMES),
        F.row_number().over(w).alias(BEST), F.first(RAW_COUNT).over(w).alias("_most"))
    return named.filter(F.col("_most") > 0).drop("_most")


def header_rows(found: DataFrame) -> DataFrame:
    """G2 of :func:`headed` rows, one row per sheet."""
    return found.filter(F.col(BEST) == 1).select(*SHEET, "sheet_idx", F.col(HEADER_ROW).alias("header_row"), F.col(NAMES).alias("names"))


def rows_below(found: DataFrame) -> DataFrame:
    """G3 of :func:`headed` rows."""
    return found.filter((F.col("row_idx") > F.col(HEADER_ROW)) & F.exists("cells", lambda x: x.isNotNull()))


def fill_and_search(grid: DataFrame, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """G1 to G3 in one: the headers and the body rows of a grid filled down.

    Short sheets are dealt once, and headers and body are read off the dealt rows; as in the joins of
    :func:`header_detect` and :func:`body_rows`, a header row that comes several times is kept so, with the body under each."""
    if not short_sheets(grid, block):
        filled = grid_fill(grid, block=block)
        headers = header_detect(grid, filled)
        return headers, body_rows(filled, headers)
    found = headed(grid_fill(with_raw_count(grid), block=block, keep=[RAW_COUNT]))
    at_header = F.col("row_idx") == F.col(HEADER_ROW)
    headers = found.filter(at_header).select(*SHEET, F.col(HEADER_ROW).alias("header_row"), "sheet_idx",
                                             F.transform("cells", lambda x: F.trim(x)).alias("names"))
    each = found.withColumn("_n", F.count_if(at_header).over(Window.partitionBy(*SHEET, "sheet_idx")))
    body = rows_below(each).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    return headers, body.select(*SHEET, "sheet_idx", "row_idx", "cells")


def body_rows(filled: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows under the header with at least one non-blank cell."""
    h = headers.select(*SHEET, "header_row")
    return (filled.join(h, SHEET, "inner")
                  .filter((F.col("row_idx") > F.col("header_row")) &
                          F.exists("cells", lambda x: x.isNotNull()))
                  .drop("header_row"))


def _md_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "),
                    F.lit(" |"))


def _sample(sheets: DataFrame) -> DataFrame:
    """``file, sheet, sample, prompt_block`` of sheets with ``names`` and ``_r``, their first body rows as (row_idx, line)."""
    md = F.concat_ws("\n", _md_row(F.col("names")), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("names"))),
                     F.array_join(F.col("_r.line"), "\n"))
    out = sheets.select(*SHEET, md.alias("sample"))
    return out.withColumn("prompt_block", F.concat(F.lit("\n--- Sheet ชื่อ: "), F.col("sheet"),
                                                   F.lit(" ---\n"), F.col("sample"), F.lit("\n")))


def sheet_sample(body: DataFrame, headers: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` body rows of each sheet as a markdown table, and the
    prompt block the reference builds from it."""
    first = first_k(body, SHEET, "row_idx", k)
    rows = (first.groupBy(*SHEET)
                 .agg(F.array_sort(F.collect_list(F.struct("row_idx", _md_row(F.col("cells")).alias("line"))))
                      .alias("_r")))
    return _sample(headers.select(*SHEET, "names").join(rows, SHEET, "inner"))


def filled_samples(grid: DataFrame, k: int = 3, block: int = 4096) -> DataFrame:
    """G4 of a grid that is filled down: :func:`sheet_sample` of its body and headers.

    Short sheets are dealt once: headers and first body rows are picked where the fill has dealt them, and only they are grouped."""
    if not short_sheets(grid, block):
        filled = store(grid_fill(grid, block=block), "filled-grid")
        headers = store(header_detect(grid, filled), "headers")
        return sheet_sample(body_rows(filled, headers), headers, k)
    found = headed(grid_fill(with_raw_count(grid), block=block, keep=[RAW_COUNT]))
    at_header, below = F.col("row_idx") == F.col(HEADER_ROW), F.col("_below")
    marked = found.withColumn("_below", (F.col("row_idx") > F.col(HEADER_ROW)) & F.exists("cells", lambda x: x.isNotNull())).withColumn(
        "_n", F.count_if(at_header).over(Window.partitionBy(*SHEET, "sheet_idx"))).filter(at_header | below)
    running = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda rows: rows.withColumn("_at", F.count_if(below).over(running)).filter(at_header | (F.col("_at") <= k))
    # as in the join of body and headers, a header row that comes n times has each body row under it n times, of which the first k count
    each = first(marked).withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.when(below, F.col("_n")).otherwise(1).cast("int"))))
    line = F.struct("row_idx", _md_row(F.col("cells")).alias("line"))
    sheets = first(each).groupBy(*SHEET).agg(F.collect_list(F.when(at_header, F.transform("cells", lambda x: F.trim(x)))).alias("_heads"),
                                             F.array_sort(F.collect_list(F.when(below, line))).alias("_r"))
    return _sample(sheets.filter(F.size("_r") > 0).select(*SHEET, F.explode("_heads").alias("names"), "_r"))


def _tops(grid: DataFrame, n_rows: int) -> DataFrame:
    """The first ``n_rows`` rows of each file's first sheet with their number from 1, ``line``, and the first one's cells, ``_top``.

    Rows are dealt by file once; both come from running frames, so that no file is held in memory."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("sheet_idx"), F.asc_nulls_last("row_idx"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    named = dealt(grid.filter(F.col("file").isNotNull()), grid.count(), "file").select(
        "*", F.min("sheet_idx").over(running).alias("_first"), F.row_number().over(order).alias("line"), F.first("cells").over(running).alias("_top"))
    return named.filter((F.col("sheet_idx") == F.col("_first")) & F.col("row_idx").isNotNull() & (F.col("line") <= n_rows)).drop("_first")


def preview(grid: DataFrame, n_rows: int = PREVIEW_ROWS) -> DataFrame:
    """First sheet of each file; its first row is the header (blank ->
    "คอลัมน์ i"), then the next ``n_rows`` rows, cells cut to the header width,
    missing cells as ''.  Output rows: (file, sheet, line, cells)."""
    # a row read by the UI ends at its last non-blank cell
    width = F.aggregate(F.transform("_top", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)),
                        F.lit(0), lambda a, b: F.greatest(a, b))
    head = F.transform(F.slice("_top", 1, width), lambda x, i: F.when(
        F.coalesce(x, F.lit("")) == "", F.concat(F.lit(PREVIEW_BLANK_HEADER), (i + 1).cast("string"))).otherwise(x))
    if short_sheets(grid):
        top = _tops(grid, n_rows + 1)
    else:
        first_sheet = grid.groupBy("file").agg(F.min("sheet_idx").alias("sheet_idx"))
        g = grid.join(first_sheet, ["file", "sheet_idx"], "left_semi")
        top = first_k(g, ["file"], "row_idx", n_rows + 1, rank_col="line")
        top = top.join(top.filter(F.col("line") == 1).select("file", F.col("cells").alias("_top")), "file")
    rows = top.withColumn("_h", head).select(
        "file", "sheet", (F.col("line") - 1).alias("line"),
        F.when(F.col("line") == 1, F.col("_h"))
         .when(F.size("_h") == 0, F.array().cast("array<string>"))
         .otherwise(F.transform(F.sequence(F.lit(1), F.size("_h")),
                                lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(""))))
         .alias("cells"))
    return rows


#: Rows of one written CSV file; the scan deals a file of any size to many tasks.
CSV_ROWS = 100_000


def write_csv(df: DataFrame, path: str, folders: list[str], salt: Column, order: list[str], n_rows: int, n_folders: int,
              widened: list[Column] = (), compression: str = "none", numbers: Column | None = None) -> None:
    """``df`` as CSV files of at most CSV_ROWS rows in folders by ``folders``, more files for more rows; rows of one ``salt``
    come in the order of ``order``, and neither column is written when named with an underscore.  ``widened`` columns are
    computed after the rows are dealt, so that they are not shuffled.  ``numbers`` is an array of two or more whole numbers, computed
    there too: a file's only cells, which need no quotes and are joined to lines in the plan, where a column per cell makes code too long
    for the JVM to compile."""
    parts = -(-n_rows // (CSV_ROWS * n_folders)) or 1
    dealt = df.repartition(n_folders * parts, *folders, F.pmod(F.xxhash64(salt), F.lit(parts)))
    hidden = [c for c in df.columns if c.startswith("_")]
    rows = (dealt.sortWithinPartitions(*folders, *order) if order else dealt).select("*", *widened).drop(*hidden)
    if numbers is not None:
        rows = dealt.select(*folders, F.array_join(numbers.cast("array<string>"), ",", "").alias("value"))
    with shuffles_dropped(df.sparkSession):
        out = rows.write.mode("overwrite").option("maxRecordsPerFile", CSV_ROWS).partitionBy(*folders).option("compression", compression)
        out = out.option("zlib.compress.level", "BEST_SPEED")
        out.option("header", False).csv(path) if numbers is None else out.text(path)


def csv_width(spark, path: str) -> int:
    """Fields of the widest record of a folder of CSV files, 1 without records."""
    return csv_records(spark, path).agg(F.max(F.size("cells"))).first()[0] or 1


def grid_scan(spark, path: str | list[str]) -> DataFrame:
    """A folder of CSV sheet exports (or a list of files) -> grid rows, no header, all text.

    Files are dealt to tasks by byte ranges and read once, whatever their width and with line breaks in quoted fields
    (:mod:`tallybook.operators.csvscan`).  ``row_idx`` follows file order (ordered, not dense).  ``file`` is
    the file's path and ``sheet`` its name without extension; partition
    columns of the folder layout are kept (``part_<name>`` when the name is
    taken)."""
    df = csv_records(spark, path).withColumnRenamed("at", "row_idx")
    taken = {"file", "sheet", "sheet_idx", "row_idx", "cells"}
    parts = [F.col(f"folder.`{c}`").alias("part_" + c if c in taken else c) for c in (df.schema["folder"].dataType.names if "folder" in df.columns else ())]
    return df.select("file", F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("sheet"),
                     F.lit(0).alias("sheet_idx"), "row_idx", *parts, "cells")


def file_facts(grid: DataFrame) -> DataFrame:
    """``file, rows, columns, header``: per file with records their number, the widest one and the first one's names."""
    return grid.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("columns"),
                                    F.min_by("cells", "row_idx").alias("header"))


def file_catalog(spark, path: str) -> DataFrame:
    """Per CSV file its size, modification time, rows, widest row and first-row names."""
    meta = (spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at")))
    return meta.join(file_facts(grid_scan(spark, path)), "file", "left")
