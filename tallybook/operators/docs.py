"""Documents: type dispatch, sections, threshold gate, chunks, markdown.

A document is one row, so sections and the threshold test are row
expressions (no shuffle).  Chunking runs the recursive splitter per
document inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.functions.chunk import CHUNK_OVERLAP, CHUNK_SIZE, chunk_spans
from tallybook.operators.chatlog import strip_ws
from tallybook.operators.grid import SHEET, short_sheets
from tallybook.session import dealt

# Extension -> document type, and the joining threshold.
DOC_TYPES = {".docx": "DOCX", ".pdf": "PDF", ".png": "IMG", ".jpg": "IMG", ".jpeg": "IMG",
             ".xls": "Excel", ".xlsx": "Excel"}
THRESHOLD = 2000
SECTION_JOIN = "\n\n"


def extension(path) -> Column:
    """``os.path.splitext(path)[1].lower()``: last dot of the base name, leading dots ignored."""
    p = F.col(path) if isinstance(path, str) else path
    base = F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"^\.+", "")
    return F.lower(F.regexp_extract(stem, r"(\.[^.]*)$", 1))


def doc_type(path) -> Column:
    """S3: DOCX / PDF / IMG / Excel / UNKNOWN by extension."""
    ext = extension(path)
    out = F.lit("UNKNOWN")
    for e, t in reversed(list(DOC_TYPES.items())):
        out = F.when(ext == e, F.lit(t)).otherwise(out)
    return out


def sections(text) -> Column:
    """Non-blank lines of a text, stripped, in order (array)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, "\n"), strip_ws), lambda x: x != "")


def gate(df: DataFrame, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Adds ``sections``, ``total_len``, ``split`` (total > threshold) and
    ``joined`` (sections joined with a blank line)."""
    s = sections(text)
    return (df.withColumn("sections", s)
              .withColumn("total_len", F.aggregate("sections", F.lit(0).cast("long"),
                                                   lambda a, x: a + F.length(x)))
              .withColumn("split", F.col("total_len") > threshold)
              .withColumn("joined", F.array_join("sections", SECTION_JOIN)))


#: Characters of chunks handed over at once.
CHUNK_BATCH = 1 << 20


def _chunk_rows(size: int, overlap: int, schema: T.StructType):
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, text in enumerate(b.column(1)):
                for n, (start, chunk) in enumerate(chunk_spans(text.as_py(), size, overlap)):
                    rows.append((i, n, start, chunk))
                    held += len(chunk)
                    if held >= CHUNK_BATCH:
                        yield made(b, rows)
                        rows, held = [], 0
            if rows:
                yield made(b, rows)

    def made(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(out.types[0]),
                                           *(pa.array(c, t) for c, t in zip(columns, list(out.types)[1:]))], schema=out)
    return run


def chunk_text(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, threshold: int = THRESHOLD) -> DataFrame:
    """D3: ``(key, chunk_idx, start, chunk, split)``: documents over the threshold are joined
    and split; others keep their sections as they are.  ``start`` is the chunk's place in the joined
    text.  Only the long ones reach the Python splitter, which hands over chunk rows as it finds them: no
    value and no batch holds all chunks of a document, and no text is shuffled."""
    g = gate(df.select(key, text), text, threshold)
    schema = T.StructType([df.schema[key], T.StructField("chunk_idx", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("chunk", T.StringType())])
    long = (g.filter(F.coalesce("split", F.lit(False))).select(key, "joined")
             .mapInArrow(_chunk_rows(size, overlap, schema), schema).withColumn("split", F.lit(True)))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    step = lambda acc, s: F.struct((acc["at"] + F.length(s) + len(SECTION_JOIN)).alias("at"),
                                   F.array_append(acc["starts"], acc["at"]).alias("starts"))
    starts = F.aggregate("sections", begin, step, lambda acc: acc["starts"])
    short = (g.filter(~F.coalesce("split", F.lit(False)))
              .select(key, F.posexplode(F.arrays_zip(starts.alias("start"), F.col("sections").alias("chunk"))).alias("chunk_idx", "_c"))
              .select(key, "chunk_idx", "_c.start", "_c.chunk", F.lit(False).alias("split")))
    return long.unionByName(short)


def markdown_lines(grid: DataFrame) -> DataFrame:
    """Each sheet as a markdown table titled ``### Sheet: name``, the first
    row being the header (blank -> ``Unnamed: i``) and blank cells ``nan``; the
    sheet width is its widest row.  Output ``(file, sheet, row_idx, line)``
    with the title, header and rule on the first row's line.  Short sheets are dealt once and measured where they lie."""
    last = F.aggregate(F.transform("cells", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)),
                       F.lit(0), lambda a, b: F.greatest(a, b))
    if short_sheets(grid):
        w = Window.partitionBy(*SHEET)
        named = grid.filter(F.col("file").isNotNull() & F.col("sheet").isNotNull())
        j = dealt(named, grid.count(), *SHEET).select("*", F.max(last).over(w).alias("_w"), F.min("row_idx").over(w).alias("_first"))
    else:
        j = grid.join(grid.groupBy(*SHEET).agg(F.max(last).alias("_w"), F.min("row_idx").alias("_first")), SHEET, "inner")
    j = j.filter(F.col("_w") > 0)
    idx = F.sequence(F.lit(0), F.col("_w") - 1)
    head = F.transform(idx, lambda i: F.coalesce(F.try_element_at("cells", i + 1),
                                                  F.concat(F.lit("Unnamed: "), i.cast("string"))))
    body = F.transform(idx, lambda i: F.coalesce(F.try_element_at("cells", i + 1), F.lit("nan")))

    def md(a):
        return F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))

    first = F.concat(F.lit("### Sheet: "), F.col("sheet"), F.lit("\n"), md(head), F.lit("\n|"),
                     F.repeat(F.lit("---|"), F.col("_w")))
    return j.select(*SHEET, "row_idx",
                    F.when(F.col("row_idx") == F.col("_first"), first).otherwise(md(body)).alias("line"))
