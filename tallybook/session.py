"""Spark session settings and the shared checkpoint folder.

Settings favour large data: adaptive execution re-plans joins and
partition counts at run time (a join side that turns out small is
broadcast only after its measured size is under the threshold), skewed
join partitions are split, and the UI server stays off.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tallybook") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own.

    The package's folder is put on the Python workers' path; on a cluster install the
    package (``pyproject.toml``) or ship it with ``--py-files``.  The checkpoint folder is
    set here only when neither the environment's Spark defaults nor a running session name one.
    """
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TALLYBOOK_DRIVER_MEM", "16g"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = builder.config("spark.executorEnv.PYTHONPATH", root)
    spark = builder.getOrCreate()
    if not spark.conf.get(CHECKPOINT_CONF, None):
        spark.stop()
        spark = builder.config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="tallybook-local-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is static and must be given when the session is built: on a
    cluster by the cluster, in tests by :func:`build_session`.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows that a task sorts or groups at most, where a table's rows are counted beforehand.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to as many tasks as its rows ask for, so that a task's share does not grow
    with the table; left alone where the session's number of partitions suffices."""
    n = -(-rows // ROWS_PER_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that a finished SQL execution deletes its shuffle files.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a write deletes its shuffle files when it ends: else they lie on the executors' disks until the driver happens to
    collect its garbage, and a query of many steps holds those of all its steps at once."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Unlike a checkpoint it keeps columnar pruning and filters; the files stay
    until the shared folder is cleared, the shuffle files of the write do not.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tallybook/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
