"""CSV exports in files that stay small, and their width found record by record."""

import uuid

import pytest

from tallybook.operators import grid as G
from tallybook.plans import q_store as Q
from tallybook.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex[:8]}"


def written(spark, folder, text):
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder, lineSep="\n")
    return folder


def test_width_without_whole_files(spark, folder, monkeypatch):
    text = 'a\n"x, ""y"", z\n,,,,",b,c\n\n1,2\n"only, one"'
    path = written(spark, folder, text)

    def refused(*a, **b):
        raise AssertionError("a whole file as one value")
    monkeypatch.setattr(type(spark.read), "text", refused)
    assert G.csv_width(spark, path) == 3
    assert [r.cells for r in G.grid_scan(spark, path).orderBy("row_idx").collect()] == [
        ["a"], ['x, "y", z\n,,,,', "b", "c"], ["1", "2"], ["only, one"]]


def test_quote_inside_a_field_hides_no_separator(spark, folder):
    rows = G.grid_scan(spark, written(spark, folder, '5" pipe,6" pipe,7\nx,y')).orderBy("row_idx").collect()
    assert [r.cells for r in rows] == [['5" pipe', '6" pipe', "7"], ["x", "y"]]


@pytest.mark.parametrize("key", ["wide_grid_scan", "grid_scan", "file_catalog"])
def test_more_rows_more_files(spark, folder, monkeypatch, key):
    query = getattr(Q, key)
    monkeypatch.setattr(Q, "stored_path", lambda spark, name, sf_dir: f"{folder}-one")
    want = sorted(map(str, query(spark, SF).collect()))
    monkeypatch.setattr(Q, "stored_path", lambda spark, name, sf_dir: f"{folder}-many")
    monkeypatch.setattr(G, "CSV_ROWS", 50)
    assert sorted(map(str, query(spark, SF).collect())) == want
    scan = G.grid_scan(spark, f"{folder}-many")
    per_file = [r["count"] for r in scan.groupBy("file").count().collect()]
    assert max(per_file) <= 50 and sum(per_file) > 50 * 48
    assert len(per_file) > 48


def test_empty_folder_of_rows(spark, folder):
    assert G.csv_width(spark, written(spark, folder, "")) == 1
