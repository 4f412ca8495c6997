"""ST6: per-conversation history on a stream, the last ``k`` messages: a merge-on-read table of tails.

A micro-batch writes the last ``k`` turns that it holds of each conversation, under its own
batch number, so a retried batch replaces its own rows.  A conversation's tail is the last
``k`` of what its batches wrote: the tail of a union lies in the union of tails.  Every
``merge_every`` batches the rows written since are merged with the last base into a new base,
so that a reader opens one base and fewer than ``merge_every`` batches, and no state grows in memory.
All steps are the skew-safe first-k of the batch query; Python sees no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.chatlog import HISTORY_KEPT, history_tail
from tallybook.streaming.runner import MERGE_EVERY, base_before, found

OUT_SCHEMA = "conv_id long, turn long, role string, text string"


def _merged(spark: SparkSession, out_dir: str, batch_id: int, every: int, k: int) -> DataFrame:
    """The tails after the batches before ``batch_id``: the base and what was written since."""
    base = base_before(batch_id, every)
    paths = [f"{out_dir}/base/{base}"] if base >= 0 else []
    paths += [f"{out_dir}/tails/{b}" for b in range(base + 1, batch_id)]
    rows = spark.read.schema(OUT_SCHEMA).parquet(*paths) if paths else spark.range(0).select(
        *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in OUT_SCHEMA.split(", "))])
    return rows if len(paths) < 2 else history_tail(rows, k)


def start(spark: SparkSession, conv_dir: str, schema, out_dir: str, k: int = HISTORY_KEPT, files_per_batch: int = 64,
          merge_every: int = MERGE_EVERY):
    asked, noted = (k, merge_every), settings(spark, out_dir)
    if noted not in (None, asked):
        raise ValueError(f"the table holds the last {noted[0]} messages, merged every {noted[1]} batches: {out_dir}")
    if noted is None:
        spark.range(1).select(F.lit(k).alias("k"), F.lit(merge_every).alias("every")).write.parquet(f"{out_dir}/settings")
    conv = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(conv_dir)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
        if (batch_id + 1) % merge_every == 0:
            # before the batch's own rows, so that a batch that counts as done has its base
            old = _merged(session, out_dir, batch_id, merge_every, k)
            history_tail(old.unionByName(history_tail(rows, k)), k).write.mode("overwrite").parquet(f"{out_dir}/base/{batch_id}")
        history_tail(rows, k).write.mode("overwrite").parquet(f"{out_dir}/tails/{batch_id}")

    return (conv.writeStream.foreachBatch(each_batch)
                .option("checkpointLocation", f"{out_dir}/_checkpoint")
                .trigger(availableNow=True).start())


def settings(spark: SparkSession, out_dir: str) -> tuple[int, int] | None:
    """``k`` and ``merge_every`` of the table, noted when its stream first starts; None before."""
    if not found(spark, f"{out_dir}/settings"):
        return None
    row = spark.read.schema("k int, every int").parquet(f"{out_dir}/settings").first()
    return row.k, row.every


def batches_done(spark: SparkSession, out_dir: str) -> int:
    """How many micro-batches were written whole; they are numbered from 0 without gaps."""
    return max((int(name) + 1 for name in found(spark, f"{out_dir}/tails/*")), default=0)


def tails(spark: SparkSession, out_dir: str) -> DataFrame:
    """The current tail of every conversation (read between batches); empty where no stream has run."""
    k, every = settings(spark, out_dir) or (HISTORY_KEPT, MERGE_EVERY)
    return _merged(spark, out_dir, batches_done(spark, out_dir), every, k)
