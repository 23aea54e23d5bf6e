"""Shared storage: checkpoint folder, materialised tables and files written by tasks."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Written tables by the DataFrame that reads them.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session hand rows to Python in batches of at most 4 MB: whole texts in batches of its usual 64 MB cost a
    worker several times that.  It stays so, as results are read later."""
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all is one machine."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The reread relation carries its file size, so the planner can choose a
    broadcast only where the written table is really small.  The shuffles of
    the write are deleted when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def frugal(run):
    """``run`` over batches, after which the worker gives freed memory back: workers are kept, and what they hold adds up over stages."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library's
                trim(0)

    return over


def release(*tables: DataFrame) -> None:
    """Delete written tables that no result reads any more, through Hadoop's file system API."""
    for table in tables:
        spark, path = table.sparkSession, _written.pop(table)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(path: str):
    """pyarrow file system and inner path for a URI; usable on executors."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)
