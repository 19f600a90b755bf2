"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution carries the runtime decisions this library relies on: join
# strategy from measured sizes, skewed-partition splitting, partition coalescing.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # column building without a captured Python stack per expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# For writes of large joins: adaptive execution starts from as many partitions, so that no task has to spill what it sorts, and puts small ones together.
SMALL_TASKS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512"}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "terraspan", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run. Done once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_terraspan_shipped", False):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="terraspan-package-"), "terraspan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("terraspan", os.path.relpath(full, home)))
    context.addPyFile(path)  # the driver serves it to every executor
    context._terraspan_shipped = True
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="terraspan-"))
    return context.getCheckpointDir()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs started inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_scopes = threading.local()  # folders to delete, per thread and open scope
_writes_lock = threading.Lock()
_writes: dict[int, list] = {}  # per session: writes under way and the setting before them


def scratch_folder(spark: SparkSession) -> str:
    """Name of a new folder in the scratch area, deleted with the innermost open scope or when the application ends."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    open_ = getattr(_scopes, "stack", [])
    if open_:
        open_[-1].append(path)
    else:
        system, target = _located(spark, path)
        system.deleteOnExit(target)
    return path


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what :func:`materialize` and :func:`scratch_folder` made in it, in this thread.

    Frames made inside must not be read afterwards. A stream opens one for each micro-batch,
    so that its scratch does not grow with the time it runs.
    """
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    _scopes.stack.append([])
    try:
        yield
    finally:
        for path in _scopes.stack.pop():
            system, target = _located(spark, path)
            system.delete(target, True)


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Free the shuffle files of the writes inside as soon as they are done; safe for several threads of a session."""
    key = id(spark._jsparkSession)
    with _writes_lock:
        state = _writes.setdefault(key, [0, spark.conf.get(CLEANUP)])
        state[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _writes_lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, _writes.pop(key)[1])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch area and read it back.

    The result has no lineage, survives executor loss and can be read several
    times with column pruning; values such as row positions are fixed by the write.
    The files are deleted with the innermost open scope or when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    with shuffle_files_freed(spark):  # nothing reads them again
        df.write.option("compression", "zstd").parquet(path)  # ids and digests take half the space
    return spark.read.schema(df.schema).parquet(path)
