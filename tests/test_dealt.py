"""Steps whose number of tasks follows the counted rows, not the session's setting alone."""

import pytest
from pyspark.sql import functions as F

from tallybook import session
from tallybook.operators import docs as DC
from tallybook.operators import grid as G
from tallybook.operators import questions as Q

CELLS = "file string, sheet string, sheet_idx int, row_idx long, cells array<string>"


@pytest.fixture
def few_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _sheets(spark):
    rows = [(f"f{i % 9}", f"s{k}", k, r, [f"h{r}", None if r % 2 else "x"]) for i in range(9) for k in (0, 1) for r in range(4)]
    return spark.createDataFrame(rows, CELLS)


def _exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning(")


@pytest.mark.parametrize("of", [G.fill_down, DC.markdown_lines, G.preview])
def test_one_exchange_by_counted_rows(spark, few_rows, of):
    out = of(_sheets(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(out) == 1 and ", 15), REPARTITION_BY_NUM" in plan


def test_ledger_count_deals_by_counted_rows(spark, few_rows):
    ledgers = [spark.createDataFrame([(f"p{i % 7}",) for i in range(n)], "project_id string") for n in (20, 10, 0)]
    out = Q.ledger_count(*ledgers, rows=30)
    assert ", 6), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.project_id, r.table_name): r.n_rows for r in out.collect()} == {
        (f"p{i}", t): n // 7 + (i < n % 7) for i in range(7) for t, n in (("labor_costs", 20), ("material_costs", 10)) if n // 7 + (i < n % 7)}


def test_preview_of_short_sheets_equals_the_blocked_way(spark, monkeypatch):
    """Null files, sheet numbers and rows, a blank and a narrow first row, and rows that come twice."""
    rows = [("a", "x", 1, 0, ["no"]), ("a", "y", 0, 2, ["b", None, "c", None]), ("a", "y", 0, 2, ["b", None, "c", None]), ("a", "y", 0, 5, [None, "1"]),
            ("a", "y", 0, None, ["lost"]), ("a", "z", None, 0, ["lost"]), (None, "y", 0, 0, ["lost"]), ("b", "y", None, 0, ["lost"]),
            ("c", "y", 3, 1, [None, None]), ("c", "y", 3, 2, ["v"]), ("d", None, 2, 7, ["h"]), ("d", None, 2, 9, None)]
    grid = spark.createDataFrame(rows, CELLS)
    seen = lambda: sorted(map(str, G.preview(grid, 3).select("file", "sheet", F.col("line").cast("int"), "cells").collect()))
    got = seen()
    monkeypatch.setattr(G, "short_sheets", lambda *a: False)
    assert got == seen() and len(got) == 7


def test_markdown_of_short_sheets_equals_the_joined_way(spark, monkeypatch):
    rows = [("a", "x", 0, 1, ["h", None, None]), ("a", "x", 0, 1, ["h", None, None]), ("a", "x", 0, 3, [None, "2"]), ("a", None, 0, 0, ["lost"]),
            (None, "x", 0, 0, ["lost"]), ("b", "x", 0, 0, [None]), ("c", "x", 0, None, ["n"]), ("c", "x", 0, 4, None)]
    grid = spark.createDataFrame(rows, CELLS)
    seen = lambda: sorted(map(str, DC.markdown_lines(grid).collect()))
    got = seen()
    monkeypatch.setattr(DC, "short_sheets", lambda *a: False)
    assert got == seen() and len(got) == 5
