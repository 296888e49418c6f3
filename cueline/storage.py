"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written by this process that nobody has released yet, oldest first.
_WRITTEN: list[str] = []
#: With this setting Spark deletes the shuffle files of an action at its end; else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it has none, a folder of this machine is set if the master is local, as in tests; on a
    cluster that is an error, since other machines wouldn't see the files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cueline-checkpoint-"))
        found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet, which :func:`release` and :func:`scratch` can take away."""
    path = f"{shared_dir(spark).rstrip('/')}/cueline-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files on the executors' disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives lost executors; the files stay until they are released.
    ``file_rows``: rows of a file at most, where a row is much work for the tasks that read it.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one task, for functions on tasks that need them there.

    Dealt by a hash of the keys: a plain ``repartition`` is left out of the plan where a join
    below deals by the same keys, and adaptive execution, which can't see what such a function
    needs, may then turn that join into a broadcast one that reads rows where they lie.
    """
    return df.repartition(F.xxhash64(*[F.col(f"`{k}`") for k in keys]))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.remove(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialise`; nothing may read it any more."""
    path = getattr(df, "written_to", None)
    if path in _WRITTEN:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at the end what is written inside, but for the tables that are put in the list given."""
    before, kept = set(_WRITTEN), []
    try:
        yield kept
    finally:
        stay = before | {getattr(df, "written_to", None) for df in kept}
        for path in [p for p in _WRITTEN if p not in stay]:
            _delete(spark, path)
