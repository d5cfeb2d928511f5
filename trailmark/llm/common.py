"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch, where a session leaves Spark's own 64 MB: a batch of whole texts exists in
#: the JVM and in Python at once, in every task.
BATCH = 8 << 20
_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Whether Spark removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ours: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder, read only by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset in a local session (as in tests) a folder of our own is taken; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), f"trailmark-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "settled") -> str:
    """Path of a folder that does not exist yet, in the shared folder; :func:`sweep` removes it."""
    to = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _ours.setdefault(spark.sparkContext.applicationId, []).append(to)
    return to


def exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends there and the files outlive any executor, so what was shuffled to make them is removed as
    soon as they are written.  :func:`sweep` removes them.  ``options`` are the Parquet writer's.
    """
    spark = df.sparkSession
    to = new_folder(spark)
    write_clean(spark, lambda: df.write.options(**options).parquet(to))
    return spark.read.schema(df.schema).parquet(to)


def settle_blocks(df: DataFrame) -> DataFrame:
    """:func:`settle` for rows of megabytes: each is a row group of its own.

    A task that writes or reads the table then holds one of its rows.  Otherwise Parquet's writer would not look at its memory
    before 100 rows, and its reader would unpack the rows of a whole row group at once: as many as a task has.
    """
    return settle(df, compression="zstd", **{"parquet.block.row.count.limit": "1"})


def write_clean(spark: SparkSession, write) -> None:
    """Runs ``write`` and removes what it shuffled."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        write()
    finally:
        spark.conf.set(_CLEAN, before)
        release()  # the driver's own Python
        collect_garbage(spark)


def bounded(small: DataFrame, most: int = 1 << 18) -> DataFrame:
    """A settled table with the hint to broadcast it, if it has no more than ``most`` rows (of a few numbers); else as
    it is, for a join by shuffling."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Remove the settled tables that ``df`` reads directly; call only when nothing needs it."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/settled-" in f:
            delete(spark, f)


def sweep(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the tables that :func:`settle` wrote in this application: all, or those after the first ``since`` and
    before the last ``but``.  Call only when nothing reads them any more."""
    ours = _ours.get(spark.sparkContext.applicationId, [])
    gone = ours[since : len(ours) - but]
    for at in gone:
        delete(spark, at)
    ours[since : len(ours) - but] = []


def written(spark: SparkSession) -> int:
    """How many tables :func:`settle` has written and nothing has swept."""
    return len(_ours.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, at: str) -> None:
    """Remove a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, factor: int = 1) -> int:
    """Partitions for an explicit exchange: a multiple of the session's setting."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release() -> None:
    """Hands memory that nothing uses back to the system: allocators keep it, and Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage where its heap has grown beyond half of its limit.

    What queries leave there when they end (plans, broadcasts, states of tasks) would otherwise be kept until the heap is
    full, and the heap would not shrink again.
    """
    run = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * run.totalMemory() > run.maxMemory():
        spark.sparkContext._jvm.java.lang.System.gc()


def released(run):
    """``run``, a function from batches to batches, with :func:`release` when it ends."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH bytes; a setting of the session's own is left alone.  A worker's memory goes
    back when its task ends."""
    conf = df.sparkSession.conf
    if conf.get(_SIZE, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        conf.set(_SIZE, str(BATCH))
    return df.mapInArrow(released(run), schema)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null taken as empty."""
    return F.coalesce(df[column], F.lit(""))
