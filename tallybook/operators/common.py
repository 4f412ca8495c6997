"""Shared plan pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import store


def first_k(df: DataFrame, keys: list[str], order_col: str, k: int, *,
            descending: bool = False, tie: list[str] | None = None,
            block: int = 1024, rank_col: str | None = None) -> DataFrame:
    """Rows with the ``k`` smallest (or largest) integer ``order_col`` per ``keys``.

    Skew-safe: rows are bucketed into blocks of ``block`` order values; block
    counts (small) locate the leading blocks of each group, a semi-join keeps
    only rows of those blocks, and only then is a window ranked.  No task ever
    ranks more than about ``k + block`` rows of one group, however large the
    group is, and no group is collected.
    """
    o = -F.col(order_col) if descending else F.col(order_col)
    d = df.withColumn("_fk_o", o.cast("long")).withColumn("_fk_b", F.floor(F.col("_fk_o") / block))
    counts = d.groupBy(*keys, "_fk_b").agg(F.count(F.lit(1)).alias("_fk_n"))
    wc = Window.partitionBy(*keys).orderBy("_fk_b").rowsBetween(Window.unboundedPreceding, 0)
    lead = (counts.withColumn("_fk_before", F.sum("_fk_n").over(wc) - F.col("_fk_n"))
                  .filter(F.col("_fk_before") < k).select(*keys, "_fk_b"))
    cand = d.join(lead, [*keys, "_fk_b"], "left_semi")
    w = Window.partitionBy(*keys).orderBy("_fk_o", *(tie or []))
    name = rank_col or "_fk_rn"
    out = cand.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    out = out.drop("_fk_o", "_fk_b")
    return out if rank_col else out.drop(name)


def nonnull_count(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x.isNotNull()))


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], rank_col: str = "rn",
                 num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank of each row within ``keys`` by ``order``, skew-safe.

    A plain ``row_number()`` window sorts a whole key in one task, so a key
    holding a third of the rows stalls on one executor.  Here the rows are
    range-partitioned and sorted on ``keys + order`` (sampled boundaries split a
    hot key across many partitions) and stored once with their partition
    and running number; ranks come from the stored numbers and the row
    counts of the same key in earlier partitions (a row per key and
    partition).  Only the stored assignment is read afterwards: a second
    evaluation could sample other boundaries.  A NULL key is a key like others.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = store(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                .withColumn("_or_pid", F.spark_partition_id())
                .withColumn("_or_place", F.monotonically_increasing_id()), "ordered-rank")
    counts = r.groupBy(*keys, "_or_pid").agg(F.count(F.lit(1)).alias("_or_n"), F.min("_or_place").alias("_or_first"))
    before = Window.partitionBy(*keys).orderBy("_or_pid").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.select(*[F.col(k).alias(f"_or_k_{k}") for k in keys], F.col("_or_pid").alias("_or_p"),
                       (F.coalesce(F.sum("_or_n").over(before), F.lit(0)) - F.col("_or_first") + 1).alias("_or_shift"))
    same = F.col("_or_pid") == F.col("_or_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_or_k_{k}"))
    return (r.join(at, same, "inner")
             .withColumn(rank_col, (F.col("_or_place") + F.col("_or_shift")).cast("long"))
             .drop("_or_pid", "_or_place", "_or_shift", "_or_p", *[f"_or_k_{k}" for k in keys]))
