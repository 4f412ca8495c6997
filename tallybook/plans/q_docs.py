"""Registered document queries (S3, D1-D4) over ``pages``, ``documents`` and the workbooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.operators import docs as DC
from tallybook.operators.chatlog import WS_CHARS
from tallybook.plans.catalog import register
from tallybook.plans.q_chat import WS_RE2
from tallybook.plans.q_import import LONG, _grid, _with
from tallybook.sources.tables import table

_EXT = ("lower(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^\\.+', ''), "
        "'(\\.[^.]*)$', 1))")


@register("doc_type", f"""SELECT page_id, url, ext,
  CASE ext WHEN '.docx' THEN 'DOCX' WHEN '.pdf' THEN 'PDF'
           WHEN '.png' THEN 'IMG' WHEN '.jpg' THEN 'IMG' WHEN '.jpeg' THEN 'IMG'
           WHEN '.xls' THEN 'Excel' WHEN '.xlsx' THEN 'Excel' ELSE 'UNKNOWN' END AS doc_type
FROM (SELECT page_id, url, {_EXT} AS ext FROM pages) p""")
def doc_type(spark, sf_dir):
    """S3: document type of every page URL by its extension."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", "url", DC.extension("url").alias("ext"), DC.doc_type("url").alias("doc_type"))


_SECTIONS = f"""secs AS (
  SELECT doc_id, i, regexp_replace(l[i], '^{WS_RE2}+|{WS_RE2}+$', '', 'g') AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d,
       (SELECT unnest(generate_series(1, 1000000)) AS i) g
  WHERE i <= len(l)),
kept AS (SELECT doc_id, s, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq
         FROM secs WHERE s <> '')"""


@register("sections", f"""WITH {_SECTIONS}
SELECT doc_id, CAST(seq AS INTEGER) AS seq, s AS section FROM kept""")
def sections(spark, sf_dir):
    """Non-blank, stripped sections (lines) of every document, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(DC.sections("text")).alias("seq", "section"))


@register("threshold_gate", f"""WITH {_SECTIONS},
agg AS (SELECT d.doc_id, COUNT(k.s) AS n_sections, COALESCE(SUM(length(k.s)), 0) AS total_len
        FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, n_sections, total_len, total_len > 2000 AS split,
  CASE WHEN n_sections = 0 THEN 0 ELSE total_len + 2 * (n_sections - 1) END AS joined_len
FROM agg""")
def threshold_gate(spark, sf_dir):
    """Per document, sections, total length, whether it is split, joined length."""
    d = DC.gate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.size("sections").cast("long").alias("n_sections"), "total_len", "split",
                    F.length("joined").cast("long").alias("joined_len"))


@register("chunk_text")
def chunk_text(spark, sf_dir):
    """D3: 1000/200 recursive chunks of long documents; short ones keep their sections.
    (Recursive algorithm: rows-only check; ``chunk_laws`` checks what must hold of it.)"""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = DC.chunk_text(d)
    return c.select("doc_id", "chunk_idx", "chunk", F.length("chunk").alias("n_chars"))


@register("chunk_laws", f"""WITH {_SECTIONS},
agg AS (SELECT doc_id, COUNT(*) AS n, SUM(length(s)) AS total, SUM(length(regexp_replace(s, '{WS_RE2}', '', 'g'))) AS dense
        FROM kept GROUP BY doc_id)
SELECT doc_id, total > 2000 AS split, CASE WHEN total <= 2000 THEN n END AS n_sections,
  CAST(0 AS BIGINT) AS first_start, CAST(total + 2 * (n - 1) AS BIGINT) AS last_end, CAST(dense AS BIGINT) AS n_covered,
  TRUE AS in_bounds
FROM agg""")
def chunk_laws(spark, sf_dir):
    """D3, what holds of any right splitting: per document, every character that is no blank lies in a chunk (``n_covered``
    counts each once), from the joined text's first to its last; chunks of split documents have at most 1000
    characters, advance, and repeat at most 200; other documents keep their sections."""
    c = DC.chunk_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = c.withColumn("end", F.col("start") + F.length("chunk"))
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("*", F.lag("start").over(w).alias("_start"), F.lag("end").over(w).alias("_end"), F.max("end").over(before).alias("_seen"))
    fresh = F.substr("chunk", (F.greatest(F.coalesce("_seen", F.lit(0)) - F.col("start"), F.lit(0)) + 1).cast("int"))
    sound = ((~F.col("split") | (F.length("chunk") <= 1000)) & (F.col("start") > F.coalesce("_start", F.lit(-1)))
             & (F.coalesce("_end", F.lit(0)) - F.col("start") <= 200))
    return c.groupBy("doc_id").agg(
        F.bool_or("split").alias("split"), F.nullif(F.count(F.when(~F.col("split"), 1)), F.lit(0)).alias("n_sections"),
        F.min("start").alias("first_start"), F.max("end").alias("last_end"),
        F.sum(F.length(F.translate(fresh, WS_CHARS, ""))).alias("n_covered"), F.bool_and(sound).alias("in_bounds"))


@register("markdown_table", _with(LONG) + """, wid AS (
  SELECT file, sheet, MAX(col_idx) + 1 AS w, MIN(row_idx) AS first_row FROM long
  WHERE v IS NOT NULL GROUP BY file, sheet),
rowsx AS (SELECT DISTINCT file, sheet, row_idx FROM long),
cells AS (
  SELECT r.file, r.sheet, r.row_idx, c.col_idx, w.w, r.row_idx = w.first_row AS is_head,
         CASE WHEN r.row_idx = w.first_row THEN COALESCE(l.v, 'Unnamed: ' || CAST(c.col_idx AS VARCHAR))
              ELSE COALESCE(l.v, 'nan') END AS v
  FROM rowsx r JOIN wid w ON w.file = r.file AND w.sheet = r.sheet
  CROSS JOIN LATERAL (SELECT unnest(range(w.w)) AS col_idx) c
  LEFT JOIN long l ON l.file = r.file AND l.sheet = r.sheet AND l.row_idx = r.row_idx
                  AND l.col_idx = c.col_idx)
SELECT file, sheet, row_idx,
  CASE WHEN bool_or(is_head) THEN '### Sheet: ' || sheet || chr(10) || '| ' || string_agg(v, ' | ' ORDER BY col_idx)
       || ' |' || chr(10) || '|' || repeat('---|', CAST(max(w) AS INTEGER))
       ELSE '| ' || string_agg(v, ' | ' ORDER BY col_idx) || ' |' END AS line
FROM cells GROUP BY file, sheet, row_idx""")
def markdown_table(spark, sf_dir):
    """Every workbook sheet as markdown table lines (first row as header)."""
    return DC.markdown_lines(_grid(spark, sf_dir))
