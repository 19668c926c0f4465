"""Writing intermediate tables where every executor can read them again.

Lineage is cut with written tables, never with blocks held by one executor: a lost executor then
costs a re-read and not a recomputation or a failed job.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: A written table is the only reader of the shuffles that made it; else their files stay until the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one JVM (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    The files go when the driver's JVM ends, those of a ``scratch`` with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    files.deleteOnExit(target)
    if (made := _SCRATCH.get()) is not None:
        made.append((files, target))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at its end, but for those that the function it gives has staged."""
    outer, made = _SCRATCH.get(), []
    token = _SCRATCH.set(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return stage(df, name)
        finally:
            _SCRATCH.reset(inner)

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for files, target in made:
            files.delete(target, True)
