"""Intermediate tables in the folder that the driver and all executors share.

A table written here replaces a lineage, so a lost executor never costs more than the step that is
running, and the planner knows the table's real size: it broadcasts one that is small and shuffles one
that is not.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that a Python worker gets at once: a few of them, with what is made of them, must fit beside the executor's own memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a task reads of a file, and of a shuffle, at most about. Rows of keys and numbers take some sixty times their bytes in a shuffle where they are sorted and counted.
_TASKS = {"spark.sql.files.maxPartitionBytes": str(32 << 20), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 << 20)}
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this context the package, wherever they run and whatever their path is. Once is enough.

    Rows go to them in batches of at most BATCH_BYTES, one row at least, unless the context's configuration says otherwise.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_has_lectern", False):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"  # Spark's file server hands it on
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._has_lectern = True


def bound_tasks(spark: SparkSession, folder: str, size: int = 4 << 20) -> None:
    """Deal shuffles of the queries that follow to a partition for each `size` bytes of the folder's tables, so that a task's memory doesn't grow with them.

    Adaptive execution puts small partitions together again. What the context's configuration says stays, and there are never fewer
    partitions than it asks for, nor more than 10,000 for the folder's size.
    """
    conf = spark.sparkContext.getConf()
    for key, value in _TASKS.items():
        if not conf.contains(key):
            spark.conf.set(key, value)
    if not conf.contains(_PARTITIONS):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        spark.conf.set(_PARTITIONS, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, held // size))))


def unbound_tasks(spark: SparkSession) -> None:
    """Undo bound_tasks()."""
    conf = spark.sparkContext.getConf()
    for key in (*_TASKS, _PARTITIONS):
        if not conf.contains(key):
            spark.conf.unset(key)


def release_memory() -> None:
    """Give back to the system what a Python worker doesn't hold any more: workers live on, idle, beside those of the next step."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and there is one machine only, as in tests, a folder of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a shared table and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._shared_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shared(spark: SparkSession) -> None:
    """Remove every table that materialise() and the operators have left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """df, hinted for broadcast if it has at most so many rows (counted now; df should be a table) of at most so many bytes in all.

    Bytes are those of the rows' values as text, an upper bound of most of them in memory. Beyond either bound the join is
    left to the planner, which shuffles: the result is the same.
    """
    few = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if few[0] <= rows and few[1] <= size else df
