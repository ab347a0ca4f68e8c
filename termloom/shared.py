"""The folder that the driver and every executor share, for checkpoints and written intermediate tables.

The cluster names it in spark.checkpoint.dir. Only where that is unset is one
set here: on a single machine in its temporary folder, on a cluster beside
the warehouse, which its machines share too.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder as a URI; sets the session's checkpoint folder where there is none."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if made := sc.getCheckpointDir():
            at = os.path.dirname(made.rstrip("/"))
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            import tempfile

            at = os.path.join(tempfile.gettempdir(), "spark-checkpoints")
        else:
            at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


_MADE: list[tuple[int, str]] = []  # process and URI


def folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder's URI in the shared folder; Spark makes it when it writes.

    It holds what this application reads again, and goes when the driver's
    process ends.
    """
    if not _MADE:
        atexit.register(_remove)
    at = f"{root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((os.getpid(), at))
    return at


def _remove() -> None:
    for pid, at in _MADE:
        if pid != os.getpid():
            continue
        if at.startswith("file:"):
            shutil.rmtree("/" + at[5:].lstrip("/"), ignore_errors=True)
            continue
        try:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(at)
            store.delete_dir(path)
        except Exception:  # the store is gone or not within Arrow's reach; what is left is the cluster's to clear
            pass


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files when the query is over, not only when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        had = spark.conf.get(name)
    except Exception:  # an older Spark
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def cut(df: DataFrame) -> DataFrame:
    """The frame without its lineage, kept in the shared folder, so that a lost executor costs no recomputation."""
    root(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)
