"""Ledger-shaped inputs derived from the given tables.

The reference ships no data, so its five business tables are stood in by
columns of the TPC-H-like tables (mapping in FIXTURES.md).  These functions
only rename and type columns; every computation on the ledgers lives in
the operators.  The DuckDB twin of each is in :mod:`tallybook.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook import schemas as S
from tallybook.session import dealt
from tallybook.sources.tables import table


def _dec(c, t):
    return F.col(c).cast(t)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    start = F.col("o_orderdate").cast("date")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
             .select(F.col("o_orderkey").cast("string").alias("id"),
                     F.col("o_custkey").cast("string").alias("user_id"),
                     F.concat(F.lit("Project#"), F.col("o_orderkey").cast("string")).alias("name"),
                     F.col("c_name").alias("client_name"),
                     F.col("n_name").alias("location"),
                     _dec("o_totalprice", S.CONTRACT).alias("contract_value"),
                     start.alias("start_date"),
                     F.date_add(start, 90).alias("end_date"),
                     F.when(F.col("o_orderstatus") == "O", "active")
                      .when(F.col("o_orderstatus") == "F", "completed")
                      .when(F.col("o_orderstatus") == "P", "pending").alias("status")))


def _lines(spark: SparkSession, sf_dir: str, numbers) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").isin(*numbers))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = table(spark, sf_dir, "lineitem").count()
    li, o = dealt(li, n, "l_orderkey"), dealt(o, n, "o_orderkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "left")
              .withColumn("project_id", F.col("l_orderkey").cast("string"))
              .withColumn("user_id", F.col("o_custkey").cast("string"))
              .withColumn("source", F.when(F.col("l_orderkey") % 3 == 0, "manual")
                                     .when(F.col("l_orderkey") % 3 == 1, "excel_import")
                                     .otherwise("line")))


def labor_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    li = _lines(spark, sf_dir, (1, 4, 7))
    total = _dec("l_extendedprice", S.MONEY)
    paid = (total * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast(S.PAID)
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
              .select("project_id", "user_id",
                      F.concat(F.lit("Worker#"), F.col("l_suppkey").cast("string")).alias("worker_name"),
                      F.col("l_returnflag").alias("worker_type"),
                      _dec("l_quantity", S.DAYS).alias("work_days"),
                      _dec("p_retailprice", S.PRICE).alias("daily_rate"),
                      total.alias("total_amount"),
                      F.when(F.col("l_discount") != 0, paid).alias("paid_amount"),
                      F.col("l_shipdate").cast("date").alias("work_date"),
                      F.lit(None).cast("string").alias("note"),
                      "source"))


def material_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    li = _lines(spark, sf_dir, (2, 5))
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
              .join(s, li.l_suppkey == s.s_suppkey, "left")
              .select("project_id", "user_id",
                      F.col("p_name").alias("item_name"),
                      _dec("l_quantity", S.PRICE).alias("quantity"),
                      F.col("p_type").alias("unit"),
                      _dec("p_retailprice", S.PRICE).alias("unit_price"),
                      _dec("l_extendedprice", S.MONEY).alias("total_amount"),
                      F.col("s_name").alias("supplier"),
                      F.col("l_shipdate").cast("date").alias("purchase_date"),
                      F.lit(None).cast("string").alias("note"),
                      "source"))


def payment_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir, (3, 6))
    received = F.col("l_linestatus") == "F"
    return li.select("project_id", "user_id",
                     F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("milestone_name"),
                     _dec("l_extendedprice", S.MONEY).alias("amount"),
                     F.col("l_shipdate").cast("date").alias("due_date"),
                     F.when(received, F.col("l_shipdate").cast("date")).alias("received_date"),
                     F.when(received, "received").when(F.col("l_linestatus") == "O", "pending")
                      .alias("status"),
                     F.lit(None).cast("string").alias("note"),
                     "source")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    m = F.col("user_id") % 4
    return e.select(F.col("user_id").cast("string").alias("id"),
                    F.when(m == 0, "pro").otherwise("starter").alias("plan"),
                    F.when(m == 1, F.lit(None)).when(m == 2, F.lit(0)).otherwise(F.lit(60))
                     .cast("int").alias("plan_limit"),
                    F.lit(0).alias("usage_count"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metered call per event: (event_id, ts, user_id)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"))


def ledgers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"projects": projects(spark, sf_dir),
            "labor_costs": labor_costs(spark, sf_dir),
            "material_costs": material_costs(spark, sf_dir),
            "payment_milestones": payment_milestones(spark, sf_dir),
            "users": users(spark, sf_dir)}
