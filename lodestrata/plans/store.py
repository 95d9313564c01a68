"""Intermediate data: folders that driver and executors share, checkpoints in them, and their deletion."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folders that each application has written, and local roots of applications that have one machine.
_written: dict[str, list[str]] = {}
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a local one if all runs on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
    return _local[sc.applicationId]


def shared_dir(spark: SparkSession, prefix: str = "") -> str:
    """The path of a new folder that driver and executors share; release() deletes it."""
    path = f"{shared_root(spark)}/{prefix}{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(spark: SparkSession) -> list[str]:
    """The folders that this application has been given and that are not yet released."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete folders of shared_dir(), all or those in `paths`; gives their number.

    Call it once their results are saved: results that are not yet computed read these files.
    """
    own = _written.get(spark.sparkContext.applicationId, [])
    gone = [p for p in own if paths is None or p in paths]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    own[:] = [p for p in own if p not in gone]
    return len(gone)


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file; False, and nothing written, if it is there already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(at):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def get(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, in order; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def _release_at_exit() -> None:
    if not any(_written.values()):
        return
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            release(spark)
    except (Py4JError, OSError):  # the JVM has ended before
        pass


atexit.register(_release_at_exit)


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
