"""Shared-folder scratch tables: the way every operator here cuts lineage.

A written Parquet table in the cluster's shared folder survives the loss of
any executor, is column-pruned on rereading and, unlike a checkpointed RDD,
keeps Catalyst's statistics. A table that later steps don't read is released
as soon as they are written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Parquet row group: what a writing task holds at once.
ROW_GROUP = 16 << 20
_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LIVE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local folder on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    atexit.register(drop, spark, path)
    _LIVE.add(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, with the folder made for it, that nothing reads any more."""
    if path not in _LIVE:
        return
    _LIVE.discard(path)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the JVM may have ended before; the folder is scratch
        pass


def materialise(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back."""
    path = scratch_path(spark, name)
    frame.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that no later step reads."""
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path:
            drop(frame.sparkSession, path)


def live() -> frozenset[str]:
    """Scratch tables that are there now."""
    return frozenset(_LIVE)


def sweep(spark: SparkSession, before: frozenset[str], kept: DataFrame) -> None:
    """Delete the scratch tables made since ``before``, but the one that ``kept`` reads: for a caller that has written its result."""
    for path in live() - before - {_PATHS.get(kept, "")}:
        drop(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
