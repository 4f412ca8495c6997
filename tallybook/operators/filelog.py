"""A catalog of uploaded CSV files that is kept up to date by reading changed files only.

The catalog is a table in numbered versions, a row per file: path, size and time name a file's state, and its rows, widest
row, header, status and the version that read it follow.  An update lists the folder (no content is read), keeps
the rows of files whose state is known, drops those of files that are gone, and scans the others.  A file without data
gets the import's error row.  A version counts once it was written whole; an update that fails leaves the last one in place.
One update runs at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.grid import file_facts, grid_scan
from tallybook.operators.ingest import EMPTY_REASON
from tallybook.session import store
from tallybook.streaming.runner import found

STATE = ["path", "size", "uploaded_at"]
SCHEMA = ("path string, size long, uploaded_at timestamp, rows long, columns int, header array<string>, "
          "status string, reason string, read_in long")
#: Changed files of one scan: their names pass through the driver, which lists the folder for the reader as well.
FILES_PER_SCAN = 10_000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, uploaded_at, file`` of every CSV file below ``folder``; ``file`` is the path as scans name it.

    Readers pass over files of no bytes; those come from the reader's own list of files, without a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    facts = files.select(F.col("_metadata.file_path").alias("_file"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at"))
    jvm = spark.sparkContext._jvm
    names = DataFrame(spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles()),
                                                         jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")  # noqa: E731  both spellings of no host
    path = F.url_decode(F.replace(plain("_name"), F.lit("+"), F.lit("%2B")))
    return (names.toDF("_name").join(facts, plain("_name") == plain("_file"), "left")
                 .select(path.alias("path"), F.coalesce("size", F.lit(0)).alias("size"), "uploaded_at", F.coalesce("_file", "_name").alias("file")))


def _same_state(x: str, y: str) -> Column:
    at = "uploaded_at"
    return (F.col(f"{x}.path") == F.col(f"{y}.path")) & (F.col(f"{x}.size") == F.col(f"{y}.size")) & F.col(f"{x}.{at}").eqNullSafe(F.col(f"{y}.{at}"))


def last_version(spark: SparkSession, catalog: str) -> int:
    """The number of the last whole version; 0 before the first."""
    return max((int(name[1:]) for name in found(spark, f"{catalog}/v*")), default=0)


def read(spark: SparkSession, catalog: str, version: int | None = None) -> DataFrame:
    """The catalog after its last update, or after an earlier one; empty before the first."""
    n = last_version(spark, catalog) if version is None else version
    if not n:
        return spark.range(0).select(F.from_json(F.lit(""), SCHEMA).alias("r")).select("r.*")
    return spark.read.schema(SCHEMA).parquet(f"{catalog}/v{n}")


def _plain(path: str) -> str:
    """A path whose letters mean themselves to the reader, which takes patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _groups(files: DataFrame) -> Iterator[list[str]]:
    group: list[str] = []
    for r in files.select("path").toLocalIterator():
        group.append(_plain(r.path))
        if len(group) == FILES_PER_SCAN:
            yield group
            group = []
    if group:
        yield group


def update(spark: SparkSession, folder: str, catalog: str) -> DataFrame:
    """Brings the catalog up to date with ``folder``: the rows of the files that were read now.

    Nothing is written when no file is new, changed or gone."""
    n = last_version(spark, catalog)
    old = read(spark, catalog, n)
    now = store(listing(spark, folder), "file-listing")
    changed = store(now.alias("now").join(old.alias("old"), _same_state("now", "old"), "left_anti"), "changed-files")
    kept = old.alias("old").join(now.alias("now"), _same_state("now", "old"), "left_semi")
    if changed.isEmpty() and kept.count() == old.count():
        return old.limit(0)
    scanned = None
    for paths in _groups(changed.filter("size > 0")):
        facts = file_facts(grid_scan(spark, paths))
        scanned = facts if scanned is None else scanned.unionByName(facts)
    none = changed.limit(0).select("file", F.lit(0).cast("long").alias("rows"), F.lit(0).alias("columns"), F.array().cast("array<string>").alias("header"))
    empty = F.col("rows").isNull()
    fresh = changed.join(none if scanned is None else scanned, "file", "left").select(
        *STATE, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"), "header",
        F.when(empty, "error").otherwise("success").alias("status"), F.when(empty, F.lit(EMPTY_REASON)).alias("reason"),
        F.lit(n + 1).cast("long").alias("read_in"))
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{catalog}/v{n + 1}")
    return read(spark, catalog, n + 1).filter(F.col("read_in") == n + 1)
