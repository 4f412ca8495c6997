"""Co-partitioned ledgers: projects and their three child ledgers bucketed by project.

Rows of a project lie in the same bucket of every ledger, so the summary and the project list join and aggregate where the
data lies, with no exchange.  The price is that a project is one task's work.  Row counts of the
buckets are stored beside the files; where the largest bucket is far over the median (a hot project) the same files are
read as plain ones, and Spark's shuffle with map-side sums takes over.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"projects": "id", "labor_costs": "project_id", "material_costs": "project_id", "payment_milestones": "project_id"}
#: Rows of an average bucket of the largest ledger, and how far over the average a bucket may be.
BUCKET_ROWS, MOST_SKEW = 1_000_000, 4


def bucket_count(rows: int) -> int:
    """A power of two, so that tables of different sizes can still be read together."""
    return 1 << max(3, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))) if rows > 0 else 8


def write_bucketed(ledgers: dict[str, DataFrame], location: str, buckets: int | None = None) -> None:
    """Writes every ledger in as many buckets by project, each in one sorted file, and the rows of each bucket."""
    n = buckets or bucket_count(max(df.count() for df in ledgers.values()))
    stats = None
    for name, df in ledgers.items():
        key, table = KEYS[name], f"bucketed_{uuid.uuid4().hex}"
        # the exchange deals rows as buckets do, so each task writes one bucket
        (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{location}/{name}").format("parquet").saveAsTable(table))
        df.sparkSession.sql(f"DROP TABLE {table}")    # the files stay
        stored = df.sparkSession.read.schema(df.schema).parquet(f"{location}/{name}")
        rows = stored.groupBy(F.pmod(F.hash(key), F.lit(n)).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).withColumn("ledger", F.lit(name))
        stats = rows if stats is None else stats.unionByName(rows)
    stats.withColumn("buckets", F.lit(n)).coalesce(1).write.parquet(f"{location}/_stats.parquet")


def read_bucketed(spark: SparkSession, location: str, schemas: dict[str, object]) -> dict[str, DataFrame]:
    """The ledgers with their buckets known to Spark, or as plain files where one bucket is far larger than the average."""
    most = spark.read.parquet(f"{location}/_stats.parquet").groupBy("ledger").agg(
        F.max("rows").alias("most"), F.sum("rows").alias("rows"), F.max("buckets").alias("buckets")).collect()
    n = max((r["buckets"] for r in most), default=0)
    even = n and all(r["most"] <= MOST_SKEW * max(1000, r["rows"] / n) for r in most)
    out = {}
    for name, schema in schemas.items():
        if not even:
            out[name] = spark.read.schema(schema).parquet(f"{location}/{name}")
            continue
        table = f"bucketed_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEYS[name]}) SORTED BY ({KEYS[name]}) INTO {n} BUCKETS "
                  f"LOCATION '{location}/{name}'")
        out[name] = spark.table(table)
    return out
