"""Intermediate tables in the folder that driver and executors share: written, kept, removed."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of files to a partition of an exchange whose number of partitions grows with its input.
PORTION = 4 << 20
_ours: dict[str, list[str]] = {}


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A local session without that setting gets a folder of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), f"trailmark-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends, it outlives executors, and what was
    shuffled to make it is removed.  :func:`sweep` or :func:`forget` removes it."""
    spark = df.sparkSession
    to = folder(spark)
    write(df, to)
    return spark.read.schema(df.schema).parquet(to)


def folder(spark: SparkSession, kind: str = "table") -> str:
    """Path of a new folder in the shared one; :func:`sweep` removes it."""
    to = f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"
    _ours.setdefault(spark.sparkContext.applicationId, []).append(to)
    return to


def write(df: DataFrame, to: str, partition_by: Iterable[str] = ()) -> None:
    """Writes ``df`` as Parquet and removes what it shuffled."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(to)
    finally:
        conf.set(_CLEAN, before)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Removes what :func:`settled` wrote in this application, but for the first ``since`` tables.  Call only when nothing
    reads them any more."""
    ours = _ours.get(spark.sparkContext.applicationId, [])
    for at in ours[since:]:
        delete(spark, at)
    del ours[since:]


def written(spark: SparkSession) -> int:
    """How many tables :func:`settled` has written and nothing has removed."""
    return len(_ours.get(spark.sparkContext.applicationId, []))


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        ours = _ours.get(spark.sparkContext.applicationId, [])
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            for mine in [x for x in ours if x.rsplit("/", 1)[-1] == at.rsplit("/", 1)[-1]]:
                delete(spark, mine)
                ours.remove(mine)


def kept(spark: SparkSession, name: str, sources: Iterable[str], make: Callable[[str], None]) -> str:
    """The folder of a table derived from ``sources`` (paths), made by ``make`` (into a folder) where it does not exist for
    the sources as they are: their sizes, numbers of files and times of change are part of its name.

    It is made beside its place and moved there when it is whole, so a reader never sees half of it.
    """
    stamps = []
    for source in sources:
        fs, path = _place(spark, source)
        held, status = fs.getContentSummary(path), fs.getFileStatus(path)
        stamps.append(f"{status.getPath().toString()}|{held.getLength()}|{held.getFileCount()}|{status.getModificationTime()}")
    mark = hashlib.sha256("\n".join(stamps).encode()).hexdigest()[:24]
    to = f"{shared(spark)}/{name}-{mark}"
    fs, path = _place(spark, to)
    if not fs.exists(path):
        made = f"{to}-{uuid.uuid4().hex}"
        make(made)
        if fs.exists(path) or not fs.rename(_place(spark, made)[1], path):  # another session was quicker
            delete(spark, made)
    return to


def portions(spark: SparkSession, *sources: str) -> int:
    """Partitions for an exchange of what is read from ``sources`` (paths): as many as they have PORTION bytes, at least one a
    core.  So what a task sorts does not grow with the tables."""
    held = sum(fs.getContentSummary(path).getLength() for fs, path in (_place(spark, source) for source in sources))
    return max(spark.sparkContext.defaultParallelism, -(-held // PORTION))


def exists(spark: SparkSession, at: str) -> bool:
    fs, path = _place(spark, at)
    return fs.exists(path)


def delete(spark: SparkSession, at: str) -> None:
    fs, path = _place(spark, at)
    fs.delete(path, True)


def _place(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
