"""Tables that cut lineage, kept in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from photonlake.session import TRIM_S, trim_jvm

#: Up to which size a side of fixed-width columns may be broadcast.
BROADCAST_BYTES = 32 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="photonlake-checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialise(df: DataFrame | list[DataFrame], name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that a lost executor costs no recomputation.

    The shuffle files of the write are of no use after it and are deleted with it. Several tables of one schema are written one after
    another and read as one, so that the shuffle files of one of them are there at a time.
    """
    parts = df if isinstance(df, list) else [df]
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{checkpoint_dir(spark)}/photonlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        for part in parts:
            part.write.mode("append").option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    trim_jvm(spark, TRIM_S)
    table = spark.read.schema(schema).parquet(path)
    table._pl_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote; nothing that is still to run may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._pl_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_bytes(schema: StructType) -> int | None:
    """Bytes of a row of fixed-width columns, nested ones included, as a broadcast holds it; None if a column has no fixed width."""
    sizes = [row_bytes(f.dataType) if isinstance(f.dataType, StructType) else 8 if isinstance(f.dataType, (NumericType, BooleanType)) else None for f in schema.fields]
    return None if None in sizes else 24 + sum(sizes)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if df, a materialised table of fixed-width columns, has at most `limit` bytes; else df for a shuffled join."""
    width = row_bytes(df.schema)
    return F.broadcast(df) if width and df.count() * width <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out
