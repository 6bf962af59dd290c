"""The virtual sensor: a deterministic 12-bit image read out of the `embeddings` table.

Row y is vec_id, column x the place in the vector, and the code floor((v + 1) * 2048). `top` (plane 2) is the whole image;
the half-size planes are its right half above (bottom, plane 0) and its left half below (middle, plane 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.session import table

WIDTH, DEPTH = 64, 12


def top(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, plane, y, x, code) of the full-size plane."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("y"), F.posexplode("embedding").alias("x", "v"))
    code = F.floor((F.col("v").cast("double") + 1.0) * 2048).cast("long")
    return e.select(F.lit(0).alias("image_id"), F.lit(2).alias("plane"), "y", "x", code.alias("code"))


def height(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "embeddings").agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0] + 1


def planes(spark: SparkSession, folder: str) -> DataFrame:
    """All three planes; the half-size ones are cut out of the image in one pass, without a shuffle."""
    image, half = top(spark, folder), height(spark, folder) // 2
    part = F.when((F.col("y") < half) & (F.col("x") >= 32), F.array(F.lit(2), F.lit(0))).when((F.col("y") >= half) & (F.col("y") < 2 * half) & (F.col("x") < 32), F.array(F.lit(2), F.lit(1)))
    cut = image.withColumn("plane", F.explode(F.coalesce(part, F.array(F.lit(2)))))
    y = F.when(F.col("plane") == 1, F.col("y") - half).otherwise(F.col("y"))
    x = F.when(F.col("plane") == 0, F.col("x") - 32).otherwise(F.col("x"))
    return cut.select("image_id", "plane", y.alias("y"), x.alias("x"), "code")


def interleaved(spark: SparkSession, folder: str) -> DataFrame:
    """The image as 21 columns of 3 channels: (image_id, y, x, channel, code)."""
    image = top(spark, folder).filter("x < 63")
    return image.select("image_id", "y", F.expr("x div 3").cast("int").alias("x"), F.expr("x % 3").alias("channel"), "code")
