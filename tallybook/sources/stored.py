"""Derived inputs written once as parquet tables in the shared checkpoint folder.

Stand-in inputs (rendered workbooks, webhook payloads, CSV exports) are data,
not part of a job; writing them once keeps each job's plan to a scan and
cuts lineage so a lost executor never recomputes the rendering.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import checkpoint_dir, shuffles_dropped

VERSION = "3"


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input files, so that changed data gets new derived tables."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p)]
    return "|".join([str(fs.makeQualified(p)), *sorted(files)])


def stored_path(spark: SparkSession, name: str, sf_dir: str) -> str:
    key = hashlib.sha1(f"{name}|{_stamp(spark, sf_dir)}|{VERSION}".encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark).rstrip('/')}/derived/{name}-{key}"


def stored(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table ``name`` derived from ``sf_dir``, writing it first if absent."""
    path = stored_path(spark, name, sf_dir)
    if not _fs_exists(spark, path + "/_SUCCESS"):
        with shuffles_dropped(spark):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: Rows of one file of a slice: a slice has as many files, and so tasks, as its table's size asks for.
SLICE_ROWS = 200_000


def _n_files(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(p))


def stored_slices(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame], order_col: str, n: int = 4) -> tuple[str, int]:
    """Folder of ``n`` slices written one after the other in the order of ``order_col``, and the number of
    files in each: a stream that reads so many files per batch gets the slices in that order.

    ``build`` gives rows that are stored already, so they are read where they lie and not copied first; a slice is written by
    many tasks, and every slice has the same number of files (empty ones where a slice has too few rows)."""
    path = stored_path(spark, name, sf_dir)
    if not _fs_exists(spark, f"{path}-done/_SUCCESS"):
        df = build()
        each = -(-df.count() // (SLICE_ROWS * n)) or 1
        timed = df.schema[order_col].dataType.typeName().startswith("timestamp")
        at = (F.unix_micros(F.col(order_col).cast("timestamp")) if timed else F.col(order_col)).cast("double")
        cuts = df.select(F.percentile_approx(at, [i / n for i in range(1, n)]).alias("c")).first()["c"] or []
        edges = [None, *sorted(set(cuts)), None]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = df if lo is None else df.filter(at > lo)
            part = part if hi is None else part.filter((at <= hi) | (at.isNull() if lo is None else F.lit(False)))
            with shuffles_dropped(spark):
                part.repartition(each).write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(path)
            for _ in range(_n_files(spark, path), each * (i + 1)):
                df.limit(0).coalesce(1).write.mode("append").parquet(path)
        spark.range(1).select(F.lit(each).alias("files")).write.mode("overwrite").parquet(f"{path}-done")
    return path, spark.read.parquet(f"{path}-done").first()["files"]
