"""Raw files as rows, and images written out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import metadata


def read_files(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = 512 << 20) -> DataFrame:
    """(path, modificationTime, length, content); the size limit is a filter of the scan, and content is read only if used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)


def with_container(files: DataFrame) -> DataFrame:
    """files with the container by their magic, so that other files never reach a parser."""
    return files.withColumn("container", metadata.container(F.col("content")))


def plane_bytes(px: DataFrame) -> DataFrame:
    """(image_id, plane, y, bytes): each scanline as little-endian 16-bit samples."""
    low, high = F.col("code").bitwiseAND(F.lit(255)), F.shiftright("code", 8)
    cell = F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(high), 2, "0"))
    rows = px.groupBy("image_id", "plane", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("h")))).alias("cells"))
    return rows.select("image_id", "plane", "y", F.unhex(F.array_join(F.transform("cells", lambda c: c["h"]), "")).alias("bytes"))


def pfm_parts(px: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, ord, bytes): a PFM file of each image of r, g, b pixels in parts: the header, then the rows bottom up as little-endian floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.asarray([c for p in line for c in p["c"]], "<f4").tobytes() for line in pdf["line"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "ord": height - pdf["y"], "bytes": rows})

    lines = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.array("r", "g", "b").alias("c")))).alias("line"))
    body = lines.select("image_id", F.col("y").cast("long").alias("y"), "line").mapInPandas(run, "image_id int, ord long, bytes binary")
    head = px.select("image_id").distinct().select(F.col("image_id").cast("int").alias("image_id"), F.lit(0).cast("long").alias("ord"), F.encode(F.lit(f"PF\n{width} {height}\n-1.0\n"), "UTF-8").alias("bytes"))
    return head.unionByName(body)


def pfm(px: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, content): the whole file of each image in one value, for small images; write_new streams the parts of large ones."""
    parts = pfm_parts(px, height, width).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("bytes").alias("h")))).alias("p"))
    return parts.select("image_id", F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "")).alias("content"))


def plane_parts(px: DataFrame) -> DataFrame:
    """(name, ord, bytes): each plane as a file of little-endian 16-bit samples, by rows."""
    return plane_bytes(px).select(F.format_string("image-%d-layer-%d.u16le", "image_id", "plane").alias("name"), F.col("y").cast("long").alias("ord"), "bytes")


def write_new(parts: DataFrame, folder: str) -> list[str]:
    """Writes files out of (name, ord, bytes) to a folder of any file system of Spark's, one part after another; an existing file is an error.

    The parts come through the driver one by one, in order; a file is never whole in memory.
    """
    spark = parts.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    names, stream = [], None
    try:
        for r in parts.select("name", "ord", "bytes").orderBy("name", "ord").toLocalIterator():
            if not names or names[-1] != r["name"]:
                if stream is not None:
                    stream.close()
                path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
                stream = path.getFileSystem(conf).create(path, False)
                names.append(r["name"])
            stream.write(bytes(r["bytes"]))
    finally:
        if stream is not None:
            stream.close()
    return names
