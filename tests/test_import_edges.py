"""Table types outside the three, empty uploads."""

from pyspark.sql import functions as F

from tallybook import schemas as S
from tallybook.operators import ingest


def test_a_type_outside_the_three_is_a_table_of_its_name(spark):
    fields = [F.lit(None).cast("string").alias(n) for n in S.ALL_FIELDS if n != "item_name"]
    typed = spark.createDataFrame([("f", "s", 4, "crane", "equipment"), ("f", "s", 5, "truck", "labor")], "file string, sheet string, row_idx long, item_name string, table_type string")
    typed = typed.select("*", *fields, F.array(F.lit("item_name")).alias("mapped"), F.lit(0).alias("n_bad"))
    imports = spark.createDataFrame([("f", "p1", "u1")], "file string, project_id string, user_id string")
    rows = ingest.ledger_rows(typed, imports, "equipment").collect()
    assert [(r.project_id, r.user_id, r.item_name, r.source) for r in rows] == [("p1", "u1", "crane", "excel_import")] and rows[0].id
    assert [r.worker_name for r in ingest.ledger_rows(typed, imports, "labor").collect()] == [None]


def test_files_without_data(spark):
    grid = spark.createDataFrame([("a", ["x"]), ("b", [None, None]), ("b", None), ("c", [None, "y"])], "file string, cells array<string>")
    imports = spark.createDataFrame([(f, "p", "u") for f in "abcd"], "file string, project_id string, user_id string")
    rows = ingest.file_errors(grid, imports).collect()
    assert sorted((r.file, r.status, r.reason) for r in rows) == [("b", "error", ingest.EMPTY_REASON), ("d", "error", ingest.EMPTY_REASON)]
