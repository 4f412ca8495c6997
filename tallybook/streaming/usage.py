"""ST5: running per-user usage and quota decisions on a stream of calls, for good or by month.

Each micro-batch is ranked per user (and month) by the batch rule's skew-safe rank, shifted
by the calls made in earlier batches, and decided by :mod:`tallybook.operators.quota`; no user's
calls meet in one task.  The running counts are a merge-on-read table in the job's folder: a batch adds the
counts of its own calls under its own number, so a retried batch replaces its own rows, and every
``merge_every`` batches they are summed with the last base into a new base.  A batch thus writes as
much as it holds, not as much as all users.  By month, a call counts for the month of its own time, so that a
reset needs no clock and late calls of a closed month still meet that month's count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import quota as Q
from tallybook.operators.common import ordered_rank
from tallybook.streaming.runner import MERGE_EVERY, base_before, found

COUNTS_SCHEMA = "user_id string, month date, seen long"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "month").agg(F.sum("seen").alias("seen"))


def _counts(spark: SparkSession, out_dir: str, batch_id: int, every: int) -> DataFrame:
    """The counts after the batches before ``batch_id``: the base and what was added since."""
    base = base_before(batch_id, every)
    paths = [f"{out_dir}/base/{base}"] if base >= 0 else []
    paths += [f"{out_dir}/counts/{b}" for b in range(base + 1, batch_id)]
    if not paths:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in COUNTS_SCHEMA.split(", "))])
    return _summed(spark.read.schema(COUNTS_SCHEMA).parquet(*paths))


def start(spark: SparkSession, calls_dir: str, schema, users: DataFrame, out_dir: str, files_per_batch: int = 64,
          monthly: bool = False, merge_every: int = MERGE_EVERY):
    """The metering job; ``monthly`` starts every user's count anew with each month (the stored usage then applies to none)."""
    asked, noted = (monthly, merge_every), settings(spark, out_dir)
    if noted not in (None, asked):
        raise ValueError(f"the table counts {'by month' if noted[0] else 'for good'}, merged every {noted[1]} batches: {out_dir}")
    if noted is None:
        spark.range(1).select(F.lit(monthly).alias("monthly"), F.lit(merge_every).alias("every")).write.parquet(f"{out_dir}/settings")
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(calls_dir)
    month = F.trunc(F.col("ts").cast("date"), "MM") if monthly else F.lit(None).cast("date")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        before = _counts(batch.sparkSession, out_dir, batch_id, merge_every)
        ranked = ordered_rank(batch.withColumn("month", month), ["user_id", "month"], ["ts", "event_id"])
        old = before.select(F.col("user_id").alias("_user"), F.col("month").alias("_month"), "seen")
        running = (ranked.join(old, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("month").eqNullSafe(F.col("_month")), "left")
                         .withColumn("rn", F.col("rn") + F.coalesce("seen", F.lit(0))).drop("_user", "_month", "seen"))
        planned = Q.user_plan(running, users)
        planned = planned.withColumn("usage0", F.lit(0)) if monthly else planned
        (Q.decide(planned).select("event_id", "user_id", "rn", "allowed", "message")
          .write.mode("overwrite").parquet(f"{out_dir}/gated/batch_id={batch_id}"))
        new = ranked.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("seen"))
        if (batch_id + 1) % merge_every == 0:
            # before the batch's own counts, so that a batch that counts as done has its base
            _summed(before.unionByName(new)).write.mode("overwrite").parquet(f"{out_dir}/base/{batch_id}")
        new.write.mode("overwrite").parquet(f"{out_dir}/counts/{batch_id}")

    return (calls.writeStream.foreachBatch(each_batch)
                 .option("checkpointLocation", f"{out_dir}/_checkpoint")
                 .trigger(availableNow=True).start())


def settings(spark: SparkSession, out_dir: str) -> tuple[bool, int] | None:
    """``monthly`` and ``merge_every`` of the table, noted when its stream first starts; None before."""
    if not found(spark, f"{out_dir}/settings"):
        return None
    row = spark.read.schema("monthly boolean, every int").parquet(f"{out_dir}/settings").first()
    return row.monthly, row.every


def seen(spark: SparkSession, out_dir: str) -> DataFrame:
    """``user_id, month, seen``: the calls counted so far (read between batches); ``month`` is null in a table for good."""
    _, every = settings(spark, out_dir) or (False, MERGE_EVERY)
    done = max((int(name) + 1 for name in found(spark, f"{out_dir}/counts/*")), default=0)
    return _counts(spark, out_dir, done, every)
