"""Co-partitioned ledgers: no exchange, and plain files where a project is hot."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallybook.plans import q_ledger as Q
from tallybook.session import checkpoint_dir
from tallybook.sources import bucketed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["project_summary_colocated", "project_list_colocated", "project_list_reference_colocated"])
def test_no_exchange(spark, key):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # as at scale, where no ledger is small
    try:
        df = getattr(Q, key)(spark, SF)
        assert "Exchange" not in plan(df) and plan(df).count("Bucketed: true") >= 4 and "Union" not in plan(df)
        assert df.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_project_is_read_as_plain_files(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("project_id"), F.lit(1).alias("v"))
    path = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex[:8]}"
    bucketed.write_bucketed({"labor_costs": rows}, path, 16)
    back = bucketed.read_bucketed(spark, path, {"labor_costs": rows.schema})["labor_costs"]
    assert "Bucketed" not in plan(back.groupBy("project_id").count()) or "Bucketed: true" not in plan(back.groupBy("project_id").count())
    assert back.groupBy("project_id").count().filter("project_id = 'hot'").first()["count"] == 6667 and back.count() == 20_000


def test_buckets_grow_with_rows():
    assert [bucketed.bucket_count(n) for n in (0, 1, 8_000_000, 9_000_000, 10**11)] == [8, 8, 8, 16, 131072]


def test_empty_ledger(spark):
    rows = spark.createDataFrame([], "project_id string, v int")
    path = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex[:8]}"
    bucketed.write_bucketed({"labor_costs": rows}, path)
    assert bucketed.read_bucketed(spark, path, {"labor_costs": rows.schema})["labor_costs"].count() == 0
