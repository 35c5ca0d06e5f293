"""Session settings, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: What a session of our own sets; on a cluster the caller's session stays as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_RUNS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a local master can share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="emberline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it goes with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/emberline-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS[path] = spark
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended already
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table through Spark's reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back(spark: SparkSession) -> bool:
    """Memory that the driver's JVM no longer uses goes back to the system; whether the JVM can do that for memory outside its heap.

    A heap that grew with plans shrinks at a full collection only. What planning and
    compiling on hundreds of threads has freed stays in the C library's arenas, which
    no collection returns.
    """
    sc = spark.sparkContext
    sc._jvm.System.gc()
    try:
        jvm, args = sc._jvm, sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # through the interface, as the server's own class is closed to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # other JVMs than HotSpot on Linux have no such command
        return False
    return True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a wide table: written as Parquet to the shared folder and read again. The shuffles behind it go with the write, and so does memory that the driver no longer uses."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for frame in frames:
        path = _STORED.pop(frame, None)
        if path:
            _delete(frame.sparkSession, path)
