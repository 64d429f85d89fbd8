"""Intermediate tables: written once to the folder that driver and executors share, read back, and removed after use."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a new temporary folder, as its driver and executors are one process; a cluster is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark then removes the shuffle files of phases that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Scopes that are open, the innermost last: (session, path) of what was made within each.
_scopes: list[list[tuple[SparkSession, str]]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder. What is written there goes when the scope around ends, or else when the driver ends."""
    path = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            remove(spark, path)

    atexit.register(drop)
    return path


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables written within go at the end: `with scope(): near_dup(docs).write.parquet(...)` leaves nothing behind in a driver that lives on.

    Results must be written or collected inside, as they read these tables. Scopes may be nested; a thread of its own needs one of its own.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet below the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so a lost executor costs no recomputation.
    The files go by discard(), at the end of a scope(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    release(spark)  # before: what made the tables written earlier is out of reach only now
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a written table that nothing needs any more, and the shuffles of what made it."""
    remove(df.sparkSession, df.written_at)
    release(df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """df itself where it has a partition for every core, as large tables have; one of fewer, such as a single file of one row group, is dealt over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
