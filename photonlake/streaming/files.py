"""Raw files as they arrive. An extension: the batch operators are the engine's own, and any row-wise one applies to a stream as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new files, at most max_files in a batch."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(path)
