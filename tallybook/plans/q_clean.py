"""Registered cleaning queries (X1-X5) over messy text rendered from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import clean as C
from tallybook.operators.pnl import money
from tallybook.plans.catalog import register
from tallybook.plans.oracle import money as sql_money
from tallybook.sources import render as R
from tallybook.sources.tables import table

_DIGITS = ("regexp_replace(translate(COALESCE(raw, ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), "
           "'[^0-9.]', '', 'g')")


@register("clean_number", f"""SELECT l_orderkey, l_linenumber, raw,
  CASE WHEN d = '' THEN 0.0 ELSE TRY_CAST(d AS DOUBLE) END AS value,
  (d <> '' AND TRY_CAST(d AS DOUBLE) IS NULL) AS bad
FROM (SELECT l_orderkey, l_linenumber, raw, {_DIGITS} AS d
      FROM (SELECT l_orderkey, l_linenumber, {R.SQL_MONEY_TEXT} AS raw FROM lineitem) r) t""")
def clean_number(spark, sf_dir):
    """Money text (baht sign, separators, Thai digits, signs, junk) to numbers."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", R.lineitem_money_text().alias("raw"))
    return li.select("l_orderkey", "l_linenumber", "raw",
                     C.clean_number("raw").alias("value"), C.number_is_bad("raw").alias("bad"))


def _sql_parse(col: str, first_only: bool) -> str:
    four = (f"CASE WHEN regexp_full_match({col}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
            f"THEN try_strptime({col}, '%d/%m/%Y') END")
    if first_only:
        return (f"CASE WHEN {four} >= TIMESTAMP '1677-09-22' AND {four} < TIMESTAMP '2262-04-11' "
                f"THEN CAST({four} AS DATE) END")
    yy = f"CAST(right({col}, 2) AS INTEGER)"
    two = (f"CASE WHEN regexp_full_match({col}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN "
           f"try_strptime(regexp_extract({col}, '^(\\d{{1,2}}/\\d{{1,2}}/)', 1) || "
           f"CAST(CASE WHEN {yy} >= 69 THEN 1900 ELSE 2000 END + {yy} AS VARCHAR), '%d/%m/%Y') END")
    return f"""CAST(COALESCE({four},
    CASE WHEN regexp_full_match({col}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({col}, '%d-%m-%Y') END,
    CASE WHEN regexp_full_match({col}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({col}, '%Y-%m-%d') END,
    {two},
    try_strptime({col}, '%d %b %Y'), try_strptime({col}, '%d %B %Y')) AS DATE)"""


@register("parse_date", f"""SELECT l_orderkey, l_linenumber, raw,
  CAST({_sql_parse('raw', False)} AS VARCHAR) AS parsed_all,
  CAST({_sql_parse('raw', True)} AS VARCHAR) AS parsed_reference
FROM (SELECT l_orderkey, l_linenumber, {R.SQL_DATE_TEXT} AS raw FROM lineitem) r""")
def parse_date(spark, sf_dir):
    """Dates in six formats (and Buddhist years), both parse modes."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", R.lineitem_date_text().alias("raw"))
    return li.select("l_orderkey", "l_linenumber", "raw",
                     C.parse_date("raw").cast("string").alias("parsed_all"),
                     C.parse_date("raw", "reference").cast("string").alias("parsed_reference"))


_ENTRY_SQL = """SELECT l_orderkey, l_linenumber,
  CASE l_returnflag WHEN 'N' THEN CAST(0 AS DECIMAL(12,2)) WHEN 'A' THEN NULL
       ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS total_in,
  CAST(l_quantity AS DECIMAL(10,2)) AS qty,
  CAST(l_discount * 100 AS DECIMAL(10,2)) AS price
FROM lineitem"""


@register("derive_total_entry", f"""SELECT l_orderkey, l_linenumber,
  {sql_money('CASE WHEN (total_in IS NULL OR total_in = 0) AND qty IS NOT NULL AND qty <> 0 '
         'AND price IS NOT NULL AND price <> 0 THEN qty * price ELSE total_in END')} AS total_amount
FROM ({_ENTRY_SQL}) e""")
def derive_total_entry(spark, sf_dir):
    """Total of a manual entry derived when 0/missing and both factors are non-zero."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_returnflag") == "N", F.lit(0).cast("decimal(12,2)"))
                   .when(F.col("l_returnflag") == "A", F.lit(None).cast("decimal(12,2)"))
                   .otherwise(F.col("l_extendedprice").cast("decimal(12,2)")).alias("total_in"),
                  F.col("l_quantity").cast("decimal(10,2)").alias("qty"),
                  (F.col("l_discount") * 100).cast("decimal(10,2)").alias("price"))
    return e.select("l_orderkey", "l_linenumber",
                    money(C.derive_total_entry("total_in", "qty", "price")).alias("total_amount"))


@register("drop_empty_rows", """SELECT * FROM (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'Part#' || CAST(l_partkey AS VARCHAR) END AS item_name,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'Supp#' || CAST(l_suppkey AS VARCHAR) END AS supplier
  FROM lineitem) t
WHERE item_name IS NOT NULL OR supplier IS NOT NULL""")
def drop_empty_rows(spark, sf_dir):
    """Text-only rows whose mapped fields are all empty are dropped."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_returnflag") != "N",
                            F.concat(F.lit("Part#"), F.col("l_partkey").cast("string"))).alias("item_name"),
                     F.when(F.col("l_linestatus") != "O",
                            F.concat(F.lit("Supp#"), F.col("l_suppkey").cast("string"))).alias("supplier"))
    return C.drop_empty_rows(rows, subset=["item_name", "supplier"])
