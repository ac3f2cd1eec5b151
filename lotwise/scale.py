"""Tables that are computed once and kept in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Paths that this process has handed out and not deleted yet.
_KEPT: list[str] = []
# Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _private_dir(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="lotwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def share_package(spark: SparkSession) -> None:
    """Python workers of a local session look for the library where the driver found it, whatever folder they start in. On
    a cluster the library is installed or sent with --py-files."""
    folder, environment = str(Path(__file__).parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if spark.sparkContext.master.startswith("local") and folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([folder, *filter(None, known)])


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, where driver and executors are one process, may do
    without; it gets a folder of its own that goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _private_dir(spark.sparkContext.applicationId)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _KEPT.append(path)
    return path


def release(spark: SparkSession, start: int = 0, n: int | None = None) -> None:
    """Delete the tables kept so far (from the `start`th on, `n` at most). Frames that read them cannot be read any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    end = len(_KEPT) if n is None else start + n
    for path in _KEPT[start:end]:
        folder = hadoop.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _KEPT[start:end]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside the block are deleted at its end: write or collect its results within."""
    start = len(_KEPT)
    try:
        yield
    finally:
        release(spark, start)


def settle(df: DataFrame) -> DataFrame:
    """Compute now, keep as a table in the shared folder, and read it from there.

    Cuts the lineage like a checkpoint and survives the loss of executors. Being
    files, the result has a known size: the planner can broadcast it when it is
    small, so that rows it is joined to are not shuffled, and later readers can
    prune its columns. Shuffle files of the computation go once it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, "table"), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete one table that `settle` gave; nothing may read it any more."""
    path = next(p for p in _KEPT if any(f"/{p.rsplit('/', 1)[1]}/" in file for file in table.inputFiles()))
    release(table.sparkSession, _KEPT.index(path), 1)
