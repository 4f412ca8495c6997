"""Weighted rendezvous sharding of records by a stable key (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep_placed, number_rows


def rendezvous_score(key: Column, shard: int, weight: float) -> Column:
    """``-weight / ln(u)`` with ``u`` in (0, 1) from the md5 of key and shard number."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    return F.lit(-float(weight)) / F.log(u)


def pick(key: Column, weights: list[float]) -> Column:
    """Shard with the highest score; of equal scores the lowest shard number.

    Shards with weight 0 get nothing.  A score depends on key, shard number and
    that shard's weight alone, so adding a shard moves a row only into the new
    shard, and about ``w_new / sum(w)`` of the rows in all.
    """
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and not all 0")
    tries = [F.struct(rendezvous_score(key, i, w).alias("score"), F.lit(-i).alias("at"))
             for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*tries) if len(tries) > 1 else tries[0]
    return (-best["at"]).cast("int")


def shard_rows(df: DataFrame, weights: list[float], grown_weight: float = 1.0, *,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with its shard, its slot there, and its shard after growth by one.

    Columns: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    ``size`` is UTF-8 bytes of the text (null: none) plus 1; ``text_crc32`` of a
    null text is 0.  A null key is the key ``null``; repeated rows each get a slot of
    their own in their common shard.  Other columns of ``df`` are not read.
    An empty table gives an empty result.

    The scan computes md5 scores and stores one narrow row per record; slots come
    from counts per input split, so no row is shuffled and no shard or key gathered in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        pick(key, weights).alias("shard"),
        pick(key, [*weights, grown_weight]).alias("grown_shard"))
    kept = keep_placed(rows, ["shard"], "shards")
    return number_rows(kept, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, weights: list[float], path: str, *, id_col: str = "doc_id") -> None:
    """Writes all columns of ``df`` under ``path/shard=<n>/``; each task writes its own files of each shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    if "shard" in (c.lower() for c in df.columns):
        raise ValueError("a column named shard would clash with the folder key")
    df.withColumn("shard", pick(key, weights)).write.partitionBy("shard").parquet(path)
