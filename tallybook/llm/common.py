"""Shared pieces of the operators in this subpackage."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_BLANKS = " \t\n\x0b\x0c\r"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))


def id_mod(k: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo ``k``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


#: Rows per written file where a table's size is known beforehand.
ROWS_PER_FILE = 200_000


def keep(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back.

    Cuts lineage and fixes values such as row numbers of a scan; lost executors
    read the files again.  The files stay until the shared folder is cleared.
    With a bound on its rows the table is written by as many tasks as the bound needs.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // ROWS_PER_FILE)
    df.write.parquet(path)
    if _scope:
        _scope[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def let_go(*frames: DataFrame) -> None:
    """Deletes tables of :func:`keep` that no later step reads; others are left alone."""
    for df in frames:
        path = vars(df).get("kept_path")
        if path:
            drop_kept(df.sparkSession, [path])
            for paths in _scope:
                if path in paths:
                    paths.remove(path)


def keep_pieces(spark, frames: Iterable[DataFrame], ddl: str, name: str) -> DataFrame:
    """The frames, one after the other, written into one table as :func:`keep` does; none gives an empty table."""
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    if _scope:
        _scope[-1].append(path)
    spark.createDataFrame([], ddl).coalesce(1).write.parquet(path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(ddl).parquet(path)


_scope: list[list[str]] = []


@contextmanager
def keeping(paths: list[str]):
    """Notes in ``paths`` the tables that :func:`keep` writes meanwhile, for :func:`drop_kept`."""
    _scope.append(paths)
    try:
        yield
    finally:
        _scope.pop()


def drop_kept(spark, paths: list[str]) -> None:
    """Deletes tables of :func:`keep` that nothing reads any more, and empties the list."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def keep_placed(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """``df`` stored with ``piece`` (input split) and ``place`` (growing inside a split).

    Each split is sorted by ``group`` first, so a group's rows of one split have
    consecutive places.  Later steps use the stored numbers, never a second evaluation.
    """
    return keep((df.sortWithinPartitions(*group) if group else df).withColumn("piece", F.spark_partition_id())
                .withColumn("place", F.monotonically_increasing_id()), name)


#: Rows of a small table that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 50_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """Hints a broadcast for a stored table whose counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bits of the filter that spares other rows a shuffle: a fixed size.
FILTER_BITS = 22


def likely_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose 64-bit name ``h`` is one of ``wanted``, and a few others.

    A bit filter of fixed size (2 ** FILTER_BITS bits, a scalar subquery); it lets more others through when more names are wanted.
    """
    residue = F.pmod(F.col("h"), F.lit(1 << FILTER_BITS))
    bit = residue + 1
    made = wanted.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    every = F.expr(f"sequence(1, {(1 << FILTER_BITS) // 32768})")
    whole = made.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("m")).select(
        F.transform(every, lambda b: F.element_at("m", b.cast("bigint"))).alias("bits"))
    whole = keep(whole, "filter", 1)
    block = F.element_at(whole.scalar(), (F.floor(residue / 32768) + 1).cast("int"))
    byte = F.conv(F.hex(F.substring(block, (F.floor(residue % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, (residue % 8).cast("int")) == 1)


def number_rows(kept: DataFrame, group: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 inside ``group`` in the order (piece, place).

    ``kept`` comes from :func:`keep_placed` with the same ``group``.  A row's number is its distance from
    the group's first place in its piece plus the counts of earlier pieces: one join with
    a table of a row per (group, piece), no shuffle or sort of the rows, whatever a
    group's size.
    """
    counts = kept.groupBy(*group, "piece").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("piece").alias("_g_piece"),
                                (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    same = F.lit(True)
    for c in [*group, "piece"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (kept.join(small_or_shuffled(starts), same, "inner")
            .withColumn(out, (F.col("place") + F.col("_shift")).cast("long"))
            .drop("_shift", "_g_piece", *[f"_g_{g}" for g in group]))


def literal_table(spark, rows: list[dict], ddl: str) -> DataFrame:
    """A small table made by the driver, as a plan without Python."""
    text = json.dumps(rows)
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def batches(rows, budget: int):
    """Slices of an iterable of texts whose characters sum to about ``budget``."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r) + 64
        if size >= budget:
            yield out
            out, size = [], 0
    if out:
        yield out
