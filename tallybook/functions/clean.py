"""Cleaning rules as native column expressions (X1-X5); no Python UDFs.

clean_number (X1)
    Thai digits become ASCII, then every character except digits and ``.``
    is removed (the sign is dropped, as in the reference); an empty result is
    0.  A value that is still not a number (``1.2.3``, ``.``) is NULL and is
    flagged by :func:`number_is_bad`; the reference fails the whole sheet.
parse_date (X2)
    ``all`` (default): the first of six formats that parses, in listed order.
    ``reference``: only the first format (the reference's loop returns after
    it), and dates outside pandas' nanosecond range become NULL as there.
derive_total_entry (X4; X3 is part of the mapping)
    The two rules for a missing total: by absent column, or by falsy value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thai digits zero to nine, and the date formats in the reference's order
# (Python strptime: %d/%m/%Y, %d-%m-%Y, %Y-%m-%d, %d/%m/%y, %d %b %Y, %d %B %Y).
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ASCII_DIGITS = "0123456789"
DATE_PATTERNS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d/M/yy", "d MMM yyyy", "d MMMM yyyy"]
TWO_DIGIT_YEAR = "d/M/yy"
# Python's %y maps 69-99 to 1969-1999 and 00-68 to 2000-2068.
PY_CENTURY_PIVOT = 2069
# pandas datetime64[ns] bounds (reference mode only).
PANDAS_MIN, PANDAS_MAX = "1677-09-22", "2262-04-11"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_digits(x) -> Column:
    """Digits-and-dots text of a cell ('' when nothing is left)."""
    t = F.translate(F.coalesce(_c(x).cast("string"), F.lit("")), THAI_DIGITS, ASCII_DIGITS)
    return F.regexp_replace(t, r"[^0-9.]", "")


def clean_number(x, keep_sign: bool = False) -> Column:
    """Messy money text -> double (NULL when not a number)."""
    d = number_digits(x)
    v = F.when(d == "", F.lit(0.0)).otherwise(d.try_cast("double"))
    if keep_sign:
        neg = F.coalesce(_c(x).cast("string"), F.lit("")).rlike(r"^\s*[-(]")
        v = F.when(neg, -v).otherwise(v)
    return v


def number_is_bad(x) -> Column:
    """True when the cleaned text is not a number (the reference raises here)."""
    d = number_digits(x)
    return (d != "") & d.try_cast("double").isNull()


# Shape of text each format can parse (Python's strptime: %d and %m one or two
# digits, %Y four, %y two, %b/%B letters).  Testing the shape first means a
# format is only tried on text it may accept, so failed parses stay rare.
DATE_SHAPES = {
    "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "yyyy-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "d/M/yy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$",
    "d MMMM yyyy": r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$",
}


def _parse_one(x: Column, pattern: str) -> Column:
    d = F.when(x.rlike(DATE_SHAPES[pattern]), F.try_to_timestamp(x, F.lit(pattern))).cast("date")
    if pattern == TWO_DIGIT_YEAR:
        d = F.when(F.year(d) >= PY_CENTURY_PIVOT, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_date(x, mode: str = "all") -> Column:
    """Text -> date by the reference's formats (see module doc)."""
    s = _c(x).cast("string")
    if mode == "all":
        return F.coalesce(*[_parse_one(s, p) for p in DATE_PATTERNS])
    if mode == "reference":
        d = _parse_one(s, DATE_PATTERNS[0])
        return F.when((d >= F.lit(PANDAS_MIN).cast("date")) & (d < F.lit(PANDAS_MAX).cast("date")), d)
    raise ValueError("mode must be 'all' or 'reference'")


def derive_total_entry(total, a, b) -> Column:
    """A manual entry's total is a x b when the total is 0 or missing and
    both factors are non-zero."""
    t, a, b = _c(total), _c(a), _c(b)
    falsy = t.isNull() | (t == 0)
    given = a.isNotNull() & (a != 0) & b.isNotNull() & (b != 0)
    return F.when(falsy & given, a * b).otherwise(t)


def drop_empty_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows where every (given) column is NULL."""
    return df.dropna(how="all", subset=subset)
