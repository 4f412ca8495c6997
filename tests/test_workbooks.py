"""The workbooks are rendered, filled and searched once."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallybook.operators import grid as G
from tallybook.plans import q_store
from tallybook.sources import sheets as SH
from tallybook.sources import stored

SHEET = [("f", "s", 0, r, c) for r, c in enumerate([["t", None], [None, "b"], ["c", "d"], [None, None]])]


def _grid(spark, rows):
    return spark.createDataFrame(rows, "file string, sheet string, sheet_idx int, row_idx long, cells array<string>")



def test_rendering_reads_line_items_once(spark, tmp_path):
    line = dict(l_orderkey=2, l_linenumber=1, l_partkey=1, l_suppkey=1, l_extendedprice=5.0, l_quantity=1.0, l_discount=0.0,
                l_shipdate="2024-01-02", l_returnflag="N", l_linestatus="F")
    lines = [Row(**line), Row(**line | {"l_orderkey": None}), Row(**line | {"l_linenumber": 3, "l_orderkey": 5}), Row(**line | {"l_linenumber": None})]
    tables = {"lineitem": lines, "part": [Row(p_partkey=1, p_name="p", p_type="t", p_retailprice=2.0)], "supplier": [Row(s_suppkey=1, s_name="s")],
              "orders": [Row(o_orderkey=2, o_custkey=1, o_orderstatus="P")], "customer": [Row(c_custkey=1, c_name="c")]}
    for name, rows in tables.items():
        spark.createDataFrame(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    g = SH.render_grid(spark, str(tmp_path))
    assert g._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    rows = g.collect()
    got = {(r.file, r.sheet_idx, r.row_idx): r.cells for r in rows}
    assert len(rows) == 3 + 2 + 2 + 2
    assert got["Project#2.xlsx", 0, 0][0] == "ค่าแรง Project#2.xlsx"
    assert got["Project#2.xlsx", 0, 1][0] == "ชื่อ" and got["Project#2.xlsx", 0, 2][0] == "Worker#1"
    assert got["Project#5.xlsx", 2, 0][0] == "ชื่องวด" and got["Project#5.xlsx", 2, 1][0] == "M3"
    assert got["Project#2.xlsx", 3, 1] == ["ลูกค้า", "c"]


@pytest.mark.parametrize("block", [2, 4096])
def test_fill_of_short_sheets_carries_nothing(spark, block):
    f = G.fill_down(_grid(spark, SHEET), block)
    assert [r.cells for r in f.orderBy("row_idx").collect()] == [["t", None], ["t", "b"], ["c", "d"], ["c", "d"]]
    assert ("Join" in f._jdf.queryExecution().optimizedPlan().toString()) == (block == 2)


@pytest.mark.parametrize("query", ["map_override", "mapping_json"])
def test_headers_are_filled_once(spark, monkeypatch, query):
    fills, fill = [], G.grid_fill
    monkeypatch.setattr(q_store, "_grid", lambda *_: _grid(spark, [("Project#2.xlsx", "ค่าแรง", 0, 0, ["Worker", "Type", "Date"]), ("Project#2.xlsx", "ค่าแรง", 0, 1, ["a", "b", "c"])]))
    monkeypatch.setattr(G, "grid_fill", lambda *a, **k: fills.append(1) or fill(*a, **k))
    assert getattr(q_store, query)(spark, "").count() > 0
    assert len(fills) == 1


def test_widened_columns_are_written_but_not_dealt(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 2).alias("bucket"), F.col("id").alias("_k"))
    G.write_csv(rows, str(tmp_path / "w"), ["bucket"], F.col("_k"), [], 50, 2, [(F.col("_k") + i).alias(f"c{i}") for i in range(3)], "gzip")
    g = G.grid_scan(spark, str(tmp_path / "w"))
    assert sorted((r.bucket, r.cells) for r in g.collect()) == sorted((i % 2, [str(i + k) for k in range(3)]) for i in range(50))
    assert all(r.file.endswith(".csv.gz") for r in g.collect())


def test_slices_are_written_without_a_copy_of_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "stored_path", lambda spark, name, sf_dir: f"{tmp_path}/{name}")
    path, _ = stored.stored_slices(spark, "s", "", lambda: spark.range(100), "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(100))
    assert not stored._fs_exists(spark, f"{path}-whole")


def test_an_array_of_numbers_is_written_as_lines(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 2).alias("bucket"), F.when(F.col("id") > 0, F.col("id")).alias("_k"))
    G.write_csv(rows, str(tmp_path / "w"), ["bucket"], F.col("_k"), [], 50, 2, compression="gzip",
                numbers=F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("_k") + i))
    back = spark.read.csv(str(tmp_path / "w"), schema="c0 long, c1 long, c2 long, bucket int").collect()
    assert sorted((r.c0 or 0, r.c1 or 0, r.c2 or 0, r.bucket) for r in back) == [(k, k + bool(k), k + 2 * bool(k), k % 2) for k in range(50)]
