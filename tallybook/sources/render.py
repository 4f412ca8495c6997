"""Messy spreadsheet text rendered from the given tables (stand-in input).

The reference's inputs are hand-typed workbooks; these functions write the
values of ``lineitem`` the ways people type them, chosen by
``l_linenumber``.  They only produce text of the expected shape; the
cleaning operators parse it without knowing how it was made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.clean import ASCII_DIGITS, THAI_DIGITS


def money_text(x: Column, variant: Column) -> Column:
    """Amount written 7 ways: baht sign, plain, with unit, Thai digits, minus,
    parentheses, and junk / empty."""
    f = F.format_number(x, 2)
    return (F.when(variant == 1, F.concat(F.lit("฿"), f))
             .when(variant == 2, F.regexp_replace(f, ",", ""))
             .when(variant == 3, F.concat(f, F.lit(" บาท")))
             .when(variant == 4, F.translate(f, ASCII_DIGITS, THAI_DIGITS))
             .when(variant == 5, F.concat(F.lit("-"), f))
             .when(variant == 6, F.concat(F.lit("("), f, F.lit(")")))
             .otherwise(F.lit(None).cast("string")))


def junk_text(flag: Column) -> Column:
    """Variant 7: '1.2.3' (not a number), '' (empty) or 'nan' (pandas' empty cell)."""
    return F.when(flag == "R", F.lit("1.2.3")).when(flag == "A", F.lit("")).otherwise(F.lit("nan"))


def date_text(d: Column, variant: Column) -> Column:
    """Date written in the six listed formats, or with a Buddhist-era year."""
    return (F.when(variant == 1, F.date_format(d, "dd/MM/yyyy"))
             .when(variant == 2, F.date_format(d, "dd-MM-yyyy"))
             .when(variant == 3, F.date_format(d, "yyyy-MM-dd"))
             .when(variant == 4, F.date_format(d, "dd/MM/yy"))
             .when(variant == 5, F.date_format(d, "dd MMM yyyy"))
             .when(variant == 6, F.date_format(d, "dd MMMM yyyy"))
             .otherwise(F.concat(F.date_format(d, "dd/MM/"), (F.year(d) + 543).cast("string"))))


# DuckDB twins for the oracle.
SQL_MONEY_TEXT = """CASE l_linenumber
  WHEN 1 THEN '฿' || format('{:,.2f}', l_extendedprice)
  WHEN 2 THEN format('{:.2f}', l_extendedprice)
  WHEN 3 THEN format('{:,.2f}', l_extendedprice) || ' บาท'
  WHEN 4 THEN translate(format('{:,.2f}', l_extendedprice), '0123456789', '๐๑๒๓๔๕๖๗๘๙')
  WHEN 5 THEN '-' || format('{:,.2f}', l_extendedprice)
  WHEN 6 THEN '(' || format('{:,.2f}', l_extendedprice) || ')'
  ELSE CASE l_returnflag WHEN 'R' THEN '1.2.3' WHEN 'A' THEN '' ELSE 'nan' END END"""

SQL_DATE_TEXT = """CASE l_linenumber
  WHEN 1 THEN strftime(CAST(l_shipdate AS DATE), '%d/%m/%Y')
  WHEN 2 THEN strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y')
  WHEN 3 THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')
  WHEN 4 THEN strftime(CAST(l_shipdate AS DATE), '%d/%m/%y')
  WHEN 5 THEN strftime(CAST(l_shipdate AS DATE), '%d %b %Y')
  WHEN 6 THEN strftime(CAST(l_shipdate AS DATE), '%d %B %Y')
  ELSE strftime(CAST(l_shipdate AS DATE), '%d/%m/') || CAST(year(l_shipdate) + 543 AS VARCHAR) END"""


def lineitem_money_text() -> Column:
    v = F.col("l_linenumber")
    return F.when(v <= 6, money_text(F.col("l_extendedprice"), v)).otherwise(junk_text(F.col("l_returnflag")))


def lineitem_date_text() -> Column:
    return date_text(F.col("l_shipdate").cast("date"), F.col("l_linenumber"))
