"""Session helpers: tables, and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a part, by what Spark knows of a scan; the columns taken hold about twice as many.
PART = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables below ``sf_dir``."""
    # Python workers import the library from where the driver has it, wherever they start.
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder; it goes when the session's JVM ends, since what
    reads it may be lazy."""
    name = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a frame that reads it.

    Used for narrow frames that several branches of a plan need: they are computed once,
    and a lost executor costs no recomputation of what lies before.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df``, materialized, and marked for broadcast if it has at most ``rows`` rows.

    For narrow frames that are joined with wide ones; with more rows the join shuffles.
    """
    df = materialize(df)
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files are too small to keep them busy.

    A file of one row group is read by one task, however many cores there are. Beyond a scan
    split's bytes for each core the scan fills the cores by itself and nothing is shuffled.
    For narrow frames of an id and a text.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 128 << 20  # the default bytes of a scan task
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * split else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of a bounded size, however large it is.

    What is grouped by ``keys`` and more columns below needs no further shuffle, and a task's
    groups are those of one part. For narrow frames of an id and a text.
    """
    n = parts(df)
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def parts(df: DataFrame) -> int | None:
    """How many parts of a bounded size ``df`` has; None if its size is not known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 50 else max(df.sparkSession.sparkContext.defaultParallelism, size // PART + 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
