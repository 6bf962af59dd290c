"""Session helpers: reading the tables of a folder, and giving executors this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Seconds between two times that the driver's JVM is trimmed for written tables.
TRIM_S = 2.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, by whatever file system Spark reads it through."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_photonlake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="photonlake-")) / "photonlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._photonlake_shipped = True


def release(spark: SparkSession) -> None:
    """Gives memory of the driver that earlier queries no longer use back to the system, in Python and in the JVM (compiled plans included)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)
    spark._jvm.java.lang.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession, every: float = 0.0) -> str | None:
    """Gives memory that the driver's JVM took outside its heap (to compile plans, mostly) and freed back to the system; its answer, or None.

    The allocator keeps what each of the JVM's threads has freed: 190 MB after line dedup. Not done if it was less than `every` seconds ago; JVMs
    without the command are left as they are.
    """
    sc, now = spark.sparkContext, time.monotonic()
    if now - getattr(sc, "_photonlake_trimmed", -every) < every:
        return None
    sc._photonlake_trimmed = now
    jvm = spark._jvm
    try:
        # by the interface, as the server's own class is closed to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = sc._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # JDK 17.0.9 and later on glibc have it
        return None
